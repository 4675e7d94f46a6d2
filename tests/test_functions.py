"""Hand-computed cases of the column functions."""

from pyspark.sql import functions as F

from crumbtrail.functions import domains as D
from crumbtrail.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()
    return row.x


def test_registered_domain(spark):
    cases = {".stats.g.doubleclick.net": "doubleclick.net", "a.b.co.uk": "b.co.uk", "localhost": "localhost", "WWW.Example.COM": "example.com", "shop.com.eg": "shop.com.eg", "a.shop.com.pe": "shop.com.pe"}
    for host, want in cases.items():
        assert one(spark, D.registered_domain(F.col("h")), h=host) == want


def test_url_host_strips_a_prefix_not_letters(spark):
    assert one(spark, D.url_host(F.col("u")), u="https://www.wikipedia.org/x?y#z") == "wikipedia.org"
    assert one(spark, D.url_host(F.col("u")), u="https://wow.example.org/") == "wow.example.org"
    assert one(spark, D.page_key(F.col("u")), u="https://a.org/p/q?x=1#f") == "https://a.org/p/q"


def test_parent_domains(spark):
    chain = lambda h, base: one(spark, D.parent_chain(F.col("h"), F.col("b")), h=h, b=base)
    assert chain("a.b.c.org", "c.org") == ["a.b.c.org", "b.c.org", "c.org"]
    assert chain("a.b.co.uk", "b.co.uk") == ["a.b.co.uk", "b.co.uk"]
    assert chain("c.org", "org") == ["c.org", "org"] and chain("10.0.0.1", "10.0.0.1") == ["10.0.0.1"]


def test_expiration(spark):
    days = D.expiration_days(F.col("e"), F.lit(1000.0))
    assert [one(spark, days, e=v) for v in (-1.0, 1000.0 + 86400 * 30, 500.0)] == [0, 30, 0]


def test_css(spark):
    assert one(spark, X.parse_px(F.col("v")), v="12.5px") == 12.5
    assert [one(spark, X.font_weight(F.col("v")), v=v) for v in ("bold", "650", "odd")] == [700, 650, 400]
    assert abs(one(spark, X.contrast(F.lit("#000"), F.col("v")), v="white") - 21) < 1e-9
    assert one(spark, X.contrast(F.lit("nonsense"), F.col("v")), v="white") is None


def test_text(spark):
    assert one(spark, X.normalize(F.col("t")), t="  Paramètres \n Refusés ") == "parametres refuses"
    assert one(spark, X.normalize(F.col("t")), t="\u1e9e \uff21\uff22 Ά e\u0301") == "ß ab α e"
    assert [one(spark, X.null_like(F.col("t")), t=t) for t in (" x ", "", " NaN", "None", "null")] == ["x", None, None, "None", "null"]
    assert one(spark, X.words_per_sentence(F.col("t")), t="One two. Three! ?") == 1.5
    assert one(spark, F.array_compact(F.array(*X.double_negatives(F.col("t")))), t="Please DON'T reject us, nicht ablehnen") == ["DON'T reject", "nicht ablehnen"]
    assert [one(spark, X.grade(F.col("s")), s=s) for s in (90.0, 89.99, 60.0, 0.0)] == ["A", "B", "C", "F"]


def test_registered_by_list(spark):
    suffixes = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",), ("ck",)], "suffix string")
    want = {"https://a.b.co.uk/x": "b.co.uk", ".a.b.com": "b.com", "co.uk": "co.uk", "x.y.z.ck": "y.z.ck", "a.www.ck": "www.ck", "host": "host", "p.q": "q", "b.uk": "b.uk"}
    got = D.registered_by_list(spark.createDataFrame([(h,) for h in want], "host string"), suffixes).collect()
    assert {r.host: r.registered for r in got} == want
