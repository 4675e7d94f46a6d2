"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crumbtrail.llm import decontaminate, jaccard, langid, lines, mixing, outliers, pieces, quality, tokens, warc
from crumbtrail.llm.common import new_path

MODEL = __import__("public_tokenizers").path("piece_bpe_32k.model")
WORDS = __import__("public_tokenizers").path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 997}" for i in range(30000))
ROWS = [(1, None, "en"), (2, "", None), (3, LONG, "de"), (4, "a b", "en"), (4, "a b", "en"), (None, "The quick brown fox. " * 5, "en"), (5, "\n\n \t", "de"), (6, "Ünïcode ▁ 中文 😀\nnext", None)]
SCHEMA = "doc_id long, text string, lang string, score double, ids string, kept string, n_tokens string, stats string, node string, row string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1.0, "x", "x", "x", "x", "x", "x") for r in ROWS], SCHEMA).withColumn("source", F.lit("s"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_pieces(spark, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {(r.doc_id, i): r for i, r in enumerate(pieces.encode(docs, MODEL).collect())}
    assert len(got) == len(ROWS)
    for (_, i), r in got.items():
        ids = sp.encode(ROWS[i][1] or "")
        assert list(r.ids) == ids and r.decoded == sp.decode(ids) and r.n_tokens == len(ids)
    assert pieces.encode(none, MODEL).count() == 0


def test_tokens(spark, docs, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(WORDS)
    path = new_path(spark, "t")
    tokens.write_tokens(docs, path, WORDS, end_id=1, shard_tokens=1000)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = sorted(((r[0] if r[0] is not None else -1, tk.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in ROWS), key=lambda x: x[0])
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [w[0] for w in want]
    start = 0
    for r, (_, ids) in zip(got, want):
        raw = np.array(ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    for s in tokens.shards(spark, path).collect():
        for i, d in enumerate(s.doc_ids):
            assert tokens.document_ids(s, i).tolist() in [w[1] for w in want if w[0] == (d if d is not None else -1)]
    empty = new_path(spark, "t")
    tokens.write_tokens(none, empty, WORDS)
    assert tokens.read_tokens(spark, empty).count() == 0


def test_warc(spark):
    body = "x" * 200
    rows = [(1, "http://a", None), (2, "http://b\r\nX: y", body), (3, None, body), (3, None, body), (None, "u", body), (5, "u", "short"), (6, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = new_path(spark, "w")
    warc.write_archive(pages, path)
    got = sorted(warc.digests(warc.read_archive(spark, path)).collect(), key=lambda r: (r.page_id is not None, r.page_id))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(None, "revisit", 2), (1, "response", None), (2, "response", None), (3, "revisit", 2), (3, "revisit", 2), (5, "response", None), (6, "response", None)]
    assert got[1].payload_digest == hashlib.sha256(b"").hexdigest() and got[3].payload_bytes == 200
    for r in warc.read_archive(spark, path).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
        assert rest[length:] == b"\r\n\r\n" and b"\nX: y" not in head
    empty = new_path(spark, "w")
    warc.write_archive(pages.where("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_lines(spark, docs, none):
    assert lines.dedup_lines(none).count() == 0
    got = lines.dedup_lines(docs).collect()
    assert len(got) == len(ROWS) and all(r.n_dropped == 0 for r in got)
    common = "This Line Is Long Enough To Count As A Common Line."
    rows = [(i, f"own {i}\n {common.upper() if i % 2 else common} \n{common}") for i in range(9)] + [(8, "other text\n" + common), (None, common)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_dropped, r.kept) == ((0, r.text) if r.doc_id == 8 else (2, f"own {r.doc_id}") if r.doc_id is not None else (1, ""))


def test_lines_stream(spark):
    """Keys over batches and partitions of all sizes, against a plain count."""
    import collections

    rng = np.random.default_rng(8)
    line = [f"{'abcdefghij' * 4} line number {i}" for i in range(30)]
    rows = []
    for i in range(400):
        own = [line[min(int(rng.zipf(1.4)) - 1, 29)] for _ in range(int(rng.integers(0, 12)))]
        rows.append((int(rng.integers(0, 300)), "\n".join(own + ([line[0]] * 50 if i == 7 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            if x:
                holders[x].add(i)
    want = collections.Counter((i, "\n".join(x for x in t.split("\n") if not x or len(holders[x]) < 5 or max(holders[x]) == i)) for i, t in rows)
    for size in (1, 7, 100, 512):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        before, lines.small_batches = lines.small_batches, lambda s: None
        try:
            got = lines.dedup_lines(docs).collect()
        finally:
            lines.small_batches = before
        assert collections.Counter((r.doc_id, r.kept) for r in got) == want, size


def test_jaccard(spark, docs, none):
    assert jaccard.near_duplicates(none).count() == 0
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and sum(r.doc_id == 4 and r.class_id == 4 for r in got) == 2
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows, n = [], 0
    for g in range(40):  # a group larger than a block, of near but unequal texts
        words = list(base)
        words[int(rng.integers(0, 300))] = f"odd{g}"
        rows.append((n, " ".join(words)))
        n += 1
    rows += [(n + i, " ".join(f"z{x}" for x in rng.integers(0, 5000, int(rng.integers(1, 80))))) for i in range(60)]
    rows += [(200, rows[0][1]), (201, rows[41][1].upper()), (202, None), (203, "")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    firsts = {}
    for i in sorted(sets):
        firsts.setdefault(frozenset(sets[i]) or i, i)
    reps = sorted(firsts.values())
    links = {i: {j for j in reps if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in reps}
    got = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()}
    for i, _ in rows:
        rep = firsts[frozenset(sets[i]) or i]
        seen, todo = {rep}, [rep]
        while todo:
            todo += (fresh := links[todo.pop()] - seen)
            seen |= fresh
        assert (got[i].text_class, got[i].n_links, got[i].class_id) == (rep, len(links[rep]), min(seen)), i


def test_decontaminate(spark, docs, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, item)], "item_id long, text string")
    assert decontaminate.find_items(none, items).count() == 0
    assert decontaminate.find_items(docs, items.where("false")).count() == 0
    texts = [(1, f"x y {item.upper()}! z"), (2, item.replace("gamma", "gumma").replace("iota ", "")), (3, item.replace("beta", "b").replace("delta", "d").replace("zeta", "z")), (4, None), (5, item[:20]), (6, "it is Too short.")]
    got = decontaminate.find_items(spark.createDataFrame(texts, "doc_id long, text string"), items, block_chars=40).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(1, 1, 0), (1, 4, 0), (2, 1, 2), (2, 4, 2), (6, 3, 0)]
    assert {(r.start_word, r.end_word) for r in got if r.doc_id == 1} == {(2, 12)}


def test_langid(spark, docs, none):
    filters = langid.learn(docs, min_count=1)
    got = langid.identify(docs, filters).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 5)] == ["und"] * 3
    assert langid.identify(none, filters).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(none)).collect()} == {"und"}


def test_bloom_slices_hold_all_grams(spark):
    import pyarrow as pa

    df = spark.createDataFrame([(1, "abcdef ghijk", "x"), (2, "lmnop qrstu", "y")], "doc_id long, text string, lang string")
    filters = langid.learn(df, min_count=1)
    total, found = filters.counts(langid.letters(pa.array(["abcdef ghijk", "lmnop qrstu"])))
    assert found[filters.langs.index("x")][0] == total[0] and found[filters.langs.index("y")][1] == total[1]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (6, 1), (99, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {1.0}
    assert quality.classify(none, labels).count() == 0


def test_isotonic():
    y = np.array([1.0, 0.0, 0.5, 0.4, 2.0])
    got = quality.isotonic(y, np.ones(5))
    assert (np.diff(got) >= 0).all() and abs(got.sum() - y.sum()) < 1e-12 and got[-1] == 2


def test_outliers(spark, docs, none):
    assert outliers.judge(none).count() == 0
    got = outliers.judge(docs).collect()
    assert len(got) == len(ROWS) and all(r.base_failed and not r.kept for r in got)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("abcdefghij"[: rng.integers(3, 8)] + str(rng.integers(0, 10**6)) for _ in range(200)), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(f"$$#{rng.integers(0, 10**6)}||%%" for _ in range(200)), "en") for i in range(20)]
    got = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


def test_mixing(spark, docs, none):
    fold = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 1
    got = mixing.score_texts(docs, fold).collect()
    assert len(got) == len(ROWS) and all(np.isfinite(r.score) and r.score <= 0 and r.base_score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 5)} == {1}
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert mixing.score_texts(none, F.lit(True)).count() == 0
    assert mixing.score_texts(docs, F.lit(False)).where("score IS NULL OR base_score IS NULL").count() == 0


def test_code_is_complete():
    for counts in ([5, 3, 1], [1], list(range(400, 0, -1))):
        code = mixing.Code([f"w{i}" for i in range(len(counts))], np.array(counts), sum(counts) + 7, 9)
        assert abs((0.5**code.length).sum() - 1) < 1e-12
        paths = {tuple(code.bits[s : s + n]) for s, n in zip(code.start, code.length)}
        assert len(paths) == len(counts) + 1
