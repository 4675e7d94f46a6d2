"""Rules against plain expressions, the models on held-out strings, and texts in segments."""

import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from crumbtrail.llm import secret_scan

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
PIECES = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apı_key", "ſecret", "toKen", " ", '"', "'", ":", "=", "é", "\n", "AKIA", "AKIAABCDEFGH", "0123456789abcdef", "deadbeef", "abc", "Z9", "+/", "_.-", "😀"]


def base(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


@pytest.fixture(scope="module")
def ratios(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return secret_scan.model(secret_scan.corpus_counts(docs).unionByName(secret_scan.sample_counts(secret_scan.random_samples(spark))))


def test_rules_equal_plain_expressions(spark, ratios):
    pick = random.Random(2)
    texts = [None, "", "\n\n"] + ["".join(pick.choices(PIECES, k=pick.randrange(1, 40))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, found_ string")
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 10000).alias("doc_id"), "text", F.lit("x").alias("spans"), F.lit("y").alias("found_")))
    some = 0
    for r in secret_scan.scan(docs.withColumn("whole", F.col("text")), ratios).collect():
        want = base(r.whole or "")
        kinds = [k for k, *_ in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, ("assign", "access", "hex"))), r.whole
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        mine = [x.split(":") for x in r.spans.split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in mine if k != "random"] == want
        assert sum(k == "random" for k, *_ in mine) == r.n_random
        taken = {p for _, a, b in want for p in range(a, b)}
        assert all(not taken & set(range(int(a), int(b))) for k, a, b in mine if k == "random")
        some += len(want)
    assert some > 1000


def test_models_on_held_out_strings(spark, ratios):
    pick = random.Random(9)
    alphabets = {"base62": string.ascii_letters + string.digits, "url": string.ascii_letters + string.digits + "-_", "upper": string.ascii_uppercase + string.digits, "base36": string.ascii_lowercase + string.digits}
    keys = {n: ["".join(pick.choices(a, k=32)) for _ in range(200)] for n, a in alphabets.items()}
    docs = spark.createDataFrame([(n, f"the of {k} and thing") for n, own in keys.items() for k in own], "kind string, text string")
    found = {r.kind: r.n for r in secret_scan.scan(docs, ratios).groupBy("kind").agg(F.avg((F.col("n_random") == 1).cast("double")).alias("n")).collect()}
    assert min(found.values()) > 0.95, found
    whole = docs.where("kind = 'base62'")
    got = [r.spans for r in secret_scan.scan(whole, ratios).collect()]
    assert sum(s == "random:7:39" for s in got) > 0.9 * len(got)
    # Held-out documents have words, names, numbers and addresses: none looks random.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("half", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2)
    counts = secret_scan.corpus_counts(docs.where("half = 0")).unionByName(secret_scan.sample_counts(secret_scan.random_samples(spark)))
    assert secret_scan.scan(docs.where("half = 1"), secret_scan.model(counts)).agg(F.sum("n_random")).first()[0] == 0
    plain = ["user_session_identifier_value", "https://www.example.com/articles/the-thing-and-other", "INTERNATIONALIZATION_ENABLED"]
    assert secret_scan.scan(spark.createDataFrame([(x,) for x in plain], "text string"), ratios).agg(F.sum("n_random")).first()[0] <= 1


def test_segments_change_nothing(spark, ratios, monkeypatch):
    pick = random.Random(3)
    data = " ".join("".join(pick.choices(string.ascii_letters + string.digits, k=pick.randrange(1, 60))) for _ in range(3000)).encode()
    rules = secret_scan.base_spans(data)
    whole = secret_scan.random_spans(data, rules, ratios, 16, 24.0)
    monkeypatch.setattr(secret_scan, "_SEGMENT", 777)
    pieces = secret_scan.random_spans(data, rules, ratios, 16, 24.0)
    assert [x[:2] for x in pieces] == [x[:2] for x in whole] and len(whole) > 1000


def test_long_repeated_and_no_rows(spark, ratios):
    key = "qX7" + "vB9kZ2mT5wR8" * 2
    docs = spark.createDataFrame([(None, "word " * 1_000_000 + key), (1, key), (1, key)], "doc_id long, text string")
    got = {(r.doc_id, r.spans) for r in secret_scan.scan(docs, ratios).collect()}
    assert got == {(None, f"random:5000000:{5000000 + len(key)}"), (1, f"random:0:{len(key)}")}
    assert secret_scan.scan(docs.where("false"), ratios).collect() == []
    none = secret_scan.model(secret_scan.corpus_counts(docs.where("false")))
    assert secret_scan.scan(docs, none).agg(F.sum("n_random")).first()[0] == 0
