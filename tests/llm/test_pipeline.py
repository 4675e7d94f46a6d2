"""The pipeline, stage by stage, and the SQL-backed queries, against brute force on the smallest tables."""

import collections

import duckdb
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from crumbtrail.llm import decontaminate, lines, quality, registry
from crumbtrail.llm.common import new_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        path = new_path(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_columns(stages):
    assert all(r.__fields__ == pipeline.COLUMNS for rows in stages[1:-1] for r in rows)


def test_quality_stage(spark, stages):
    scored = quality.classify(spark.createDataFrame(stages[0]), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids(stages[1]) == ids([r for r in scored if r.predicted == 1])
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    assert len(good - set(ids(stages[1]))) <= 0.05 * len(good)


def test_line_stage(stages):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = collections.defaultdict(set)
    for r in stages[1]:
        for x in (r.text or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(r.doc_id)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    want = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if common.get(key(x), r.doc_id) == r.doc_id) for r in stages[1]}
    assert {r.doc_id: r.text or "" for r in stages[2]} == want


def test_near_duplicate_stage(stages):
    sets = {}
    for r in stages[2]:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for n, i in enumerate(order):
        for j in order[:n]:
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert ids(stages[3]) == sorted({find(i) for i in sets})


def test_decontamination_stage(spark, stages):
    items = [[w for w in decontaminate.plain_words(r.text) if w] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    hit = set()
    for r in stages[3]:
        words = [w for w in decontaminate.plain_words(r.text or "") if w]
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        for item in items:
            if item and decontaminate.myers([number.get(w, -1 - i) for i, w in enumerate(item)], [number[w] for w in words])[0] <= len(item) // 5:
                hit.add(r.doc_id)
    assert ids(stages[4]) == sorted(set(ids(stages[3])) - hit)


def test_encoding_stage(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=__import__("public_tokenizers").path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in stages[4]}
    assert ids(stages[5]) == sorted(texts)
    for r in stages[5]:
        assert list(r.ids) == sp.encode(texts[r.doc_id]) and r.decoded == sp.decode(list(r.ids))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.SQL[name])
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(got.select(*want.columns).collect()) == key(want.fetchall())


def test_bitmaps_are_small(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in lines.keep_bitmaps(docs).collect():
        assert 0 < len(r.keep) < 2000 and r.n_drop > 0


ROWS = [
    (1, None), (2, ""), (2, ""), (3, "long " * 60000), (4, "same words in this text here now"), (4, "same words in this text here now"),
    (5, "same words in this text here now"), (None, "same words in this text here now"), (7, "first own text of number seven here"),
    (7, "second and other text of number seven"), (None, "only a null id has this text here"), (None, "only a null id has this text here"), (8, "\n\n"),
]


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_edges_of_stages(spark, name, stage):
    """Nulls, empty and long texts, repeated rows, an empty table and further columns, for every stage."""
    docs = spark.createDataFrame([(i, t, None, "s", 1, 0.5, "x") for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, score double, th string")
    got = stage(spark, docs, SF).collect()
    last = stage is pipeline.STAGES[-1][1]
    assert last or all(r.__fields__ == pipeline.COLUMNS for r in got)
    if last:
        assert len(got) == len(ROWS) and all(r.n_tokens == len(r.ids) for r in got)
    if name == "n-gram Jaccard join":
        key = lambda rows: sorted(((i is None, i or 0, t or "") for i, t in rows))
        want = [ROWS[i] for i in (0, 1, 2, 3, 4, 8, 9, 10, 12)]
        assert key((r.doc_id, r.text) for r in got) == key(want)
    if name in ("line dedup", "benchmark decontamination"):
        assert len(got) == len(ROWS)
    assert stage(spark, docs.where("false"), SF).count() == 0
