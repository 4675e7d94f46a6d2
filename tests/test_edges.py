"""Layouts, sketches, draws, files of odd shapes, and strings, against plain rules."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crumbtrail.functions import domains as D
from crumbtrail.operators import banner, extras, privacy, sketches, studies
from crumbtrail.plans import store
from crumbtrail.sources import readers


def test_tables_of_one_layout_join_without_a_shuffle(spark):
    own = lambda c: store.bucketed(spark.range(500).select(F.concat(F.lit("d"), "id").alias("domain"), F.col("id").alias(c)), c, "domain")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = {c: own(c) for c in ("success", "has_reject", "overall", "names", "n_pre", "trackers", "tcf")}
        sites = made["success"].withColumn("cmp", F.lit("x"))
        banners = made["has_reject"].withColumn("reject_clicks", F.lit(1))
        scores, patterns = made["overall"].withColumn("grade", F.lit("A")), made["names"].withColumn("n_patterns", F.lit(1))
        states, signals = (made[c].withColumnRenamed("domain", "site") for c in ("n_pre", "trackers"))
        joined = studies.cmp_sites(sites, banners, scores, patterns, states, signals, made["tcf"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 6
        assert joined.count() == 500 and joined.where("n_pre = trackers AND trackers = tcf").count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_draws_of_counts_are_binomial(spark):
    rng = np.random.default_rng(1)
    for n, p in ((7, 0.3), (1000, 0.52), (10**6, 0.9)):
        got = np.array([privacy._quantile(n, p, u) for u in rng.random(4000)])
        assert abs(got.mean() - n * p) < 5 * math.sqrt(n * p * (1 - p) / 4000) and abs(got.std() / math.sqrt(n * p * (1 - p)) - 1) < 0.06
    assert [privacy._quantile(3, 0.5, u) for u in (0.1, 0.125 + 1e-9, 0.51, 0.9)] == [0, 1, 2, 3] and privacy._quantile(0, 0.5, 0.5) == 0
    # The same mean and spread as with a hashed answer for each row.
    rows = spark.range(3000).select(F.col("id").cast("string").alias("domain"), (F.col("id") % 3 == 0).alias("yes"))
    key = privacy.Key("s", "t")
    whole = {r.epsilon: r for r in privacy.counted_trials(rows, ["yes"], key, times=60).collect()}
    single = {r.epsilon: r for r in privacy.response_trials(rows, "domain", ["yes"], key, times=60).collect()}
    for e, r in whole.items():
        p = math.exp(e) / (1 + math.exp(e))
        deviation = math.sqrt(p * (1 - p) / 3000) / (2 * p - 1)
        assert r.n == 3000 and abs(r.truth - 1 / 3) < 1e-9
        if deviation < 0.1:
            assert abs(r.estimate - single[e].estimate) < 6 * deviation / math.sqrt(60) and 0.7 < r.spread / deviation < 1.35


def test_sketches_merge(spark):
    rows = spark.range(120_000).select((F.col("id") % 4).alias("batch"), F.when(F.col("id") % 7 < 5, "a").otherwise("b").alias("k"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 50_000).alias("v"))
    parts = [sketches.sketched(rows.where(F.col("batch") == i), ["k"], "v", "batch") for i in range(4)]
    every = parts[0]
    for other in parts[1:]:
        every = every.unionByName(other)
    got = {r.k: r["distinct"] for r in sketches.united(every, ["k"]).collect()}
    exact = {r.k: r.n for r in rows.groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
    assert all(abs(got[k] - n) < 0.02 * n for k, n in exact.items()) and every.count() == 8


def test_result_files_of_any_shape(spark):
    files = [
        '[{"domain": "a.com", "n": 1, "source_mode": "x"}, 5, null, {"domain": "b.com", "deep": {"n": 2}}]',
        '{"run_id": "r1", "site_list_source": "s1", "results": [{"domain": "c.com", "n": 3.0}]}',
        '{"run_id": " r1 ", "site_list_source": "nan", "results": [{"n": "4"}]}',
        '{"other": [1]}', "7", "not json", "", "[]", None,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(files)], "file int, json string")
    got = readers.merged_results(docs, {"domain": "string", "n": "int"}, "real").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(d, n, "real", "r1", "s1") for d, n in (("a.com", 1), ("b.com", None), ("c.com", 3), (None, 4))], key=str)
    more = docs.unionByName(spark.createDataFrame([(9, '{"run_id": "r2", "results": []}')], docs.schema))
    assert {r.run_id for r in readers.merged_results(more, {"domain": "string"}, "real").collect()} == {None}
    items = readers.result_items(docs).select("file", "run_id").collect()
    assert sorted((r.file, r.run_id) for r in items if r.file) == [(1, "r1"), (2, " r1 ")] and len(items) == 4


def test_services_by_variant_equal_the_typed_reader(spark):
    doc = '{"categories": {"Ads": [{"One": {"https://one.com/": ["one.com", "One.net"], "dnt": "w3c"}}, {"Two": {"https://two.org/": ["two.org"], "performance": "true"}}], "Social": [{"One": {"https://one.com/": ["one.com"]}}]}}'
    docs = spark.createDataFrame([(doc,), ("broken",), (None,)], "json string")
    made = readers.services_by_variant(docs).groupBy("domain").agg(F.max_by(F.struct("vendor", "category"), "place").alias("x")).select("domain", "x.*")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, readers.tracker_services(docs).collect())) == [("one.com", "One", "Social"), ("one.net", "One", "Ads"), ("two.org", "Two", "Ads")]


def test_files_of_banners_and_old_lists(spark, tmp_path):
    for name, html in (("a.com.html", "<p>one\n</p>"), ("b.org.htm", "<b>")):
        (tmp_path / name).write_text(html)
    got = {r.domain: r.html for r in readers.read_banner_html(spark, str(tmp_path)).collect()}
    assert got["a.com"] == "<p>one\n</p>" and got["b.org"] == "<b>"
    os.utime(tmp_path / "b.org.htm", (1_700_000_000, 1_700_000_000))
    os.utime(tmp_path / "a.com.html", (1_700_500_000, 1_700_500_000))
    old = readers.stale_files(spark, str(tmp_path), "2023-11-22 00:00:00", days=7)
    assert [r.path.rsplit("/", 1)[1] for r in old.collect()] == ["b.org.htm"]


def bits(s):
    """The rule, character by character."""
    units = len(s.encode("utf-16-be")) // 2
    if units > 256:
        return float(units)
    t = s.lower() if s in (s.lower(), s.upper()) else s
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for group in ("01", digits, "abcdef" + digits, low, low + digits, low + digits + low.upper() + "/+", low + digits + low.upper() + "~%"):
        if set(t) <= set(group + "._-x"):
            return math.log2(len(group)) * units
    raw = t.encode("utf-16-be")
    codes = [raw[i] * 256 + raw[i + 1] for i in range(0, len(raw), 2)]
    return math.log2(max(codes) - min(codes) + 1) * units


def test_string_bits(spark):
    pick = random.Random(1)
    pools = ["01x", "0123456789.-", "abcdef0123", "ABCDEF01", "abcXYZ", "xyz0189", "aZ9/+", "aZ9~%", "aZ9~+", "äöÜ a", "😀a\U0010ffff", "z"]
    strings = ["14103492.1964907", "a" * 300, "x", "1", "ABC", "Abc"] + ["".join(pick.choices(p, k=pick.randrange(1, 40))) for p in pools for _ in range(40)]
    got = spark.createDataFrame([(s,) for s in strings], "s string").select("s", extras.string_bits(F.col("s")).alias("b")).collect()
    assert all(r.b == pytest.approx(bits(r.s)) for r in got)
    assert {r.s: r.b for r in got}["14103492.1964907"] == pytest.approx(16 * math.log2(10)) and {r.s: r.b for r in got}["a" * 300] == 300
    assert spark.sql("SELECT '' AS s").select(extras.string_bits(F.col("s"))).first()[0] is None


def test_base_domains(spark):
    rules = spark.createDataFrame([(x,) for x in ("com", "co.uk", "uk", "*.ck", "!www.ck")], "suffix string")
    want = {"a.b.example.com": "example.com", "com": "com", "x.co.uk": "x.co.uk", "co.uk": "co.uk", "b.uk": "b.uk", "a.b.c.ck": "b.c.ck", "c.ck": "c.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "p.q.unknown": "q.unknown", "localhost": "localhost", "10.1.2.3": "10.1.2.3", "2001:db8::1": "2001:db8::1", "trail.com": "trail.com"}
    hosts = spark.createDataFrame([(h.upper() if h == "x.co.uk" else h + "." if h == "trail.com" else h,) for h in want] + [("",), (None,)], "host string")
    assert {r.host: r.base for r in D.base_domains(hosts, rules).collect()} == want
    chain = {}
    for r in D.explode_subdomains(hosts, rules).orderBy("pos").collect():
        chain.setdefault(r.host, []).append(r.parent)
    assert chain["a.b.example.com"] == ["a.b.example.com", "b.example.com", "example.com"] and chain["10.1.2.3"] == ["10.1.2.3"] and chain["x.co.uk"] == ["x.co.uk"]
    whole = [r.parent for r in D.explode_subdomains(hosts, rules, whole=True).where("host = 'x.co.uk'").orderBy("pos").collect()]
    assert whole == ["x.co.uk", "co.uk", "uk"]


def test_compare_previews(spark):
    rows = [
        ("a", "accept", 100.0, 40.0, 16.0, 700, False, None), ("a", "settings", 90.0, 40.0, 12.0, 400, True, 2), ("b", "accept", 100.0, 40.0, 16.0, 400, False, None),
        ("c", "accept", 100.0, 40.0, 16.0, 400, False, None), ("c", "reject", 50.0, 40.0, 16.0, 400, False, 1), ("c", "settings", 10.0, 1.0, 1.0, 100, True, 2), ("d", "reject", 1.0, 1.0, 1.0, 1, False, 1),
    ]
    df = spark.createDataFrame(rows, "domain string, role string, width double, height double, font_size double, font_weight int, plain_link boolean, clicks int")
    got = {r.domain: (r.source, r.issues) for r in banner.compare_previews(df).collect()}
    assert got == {
        "a": ("settings", ["reject only behind settings (2 clicks)", "reject has a smaller font", "accept is bolder", "reject looks like a plain link"]),
        "b": ("missing", ["no reject button"]), "c": ("direct", ["reject is smaller"]),
    }
