"""Steps that reports share do their work once: requests are read once, names, texts and markup looked at once."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from crumbtrail.functions import domains as D
from crumbtrail.operators import banner, classify
from crumbtrail.plans import more, params, queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_registered_domain_of_odd_hosts(spark):
    hosts = ["", ".", "..", "a", "a.", "a..b", "..a.B.Co.Uk", "co.uk", ".co.uk.", "x.co.uk", "Ä.example.com", "1.2.3.4", "a.b.c.d.e", None]

    def want(host):
        if host is None:
            return None
        parts = host.lstrip(".").lower().split(".")
        return ".".join(parts[-3:] if ".".join(parts[-2:]) in params.TWO_LABEL_SUFFIXES else parts[-2:])

    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", D.registered_domain(F.col("h")).alias("r"))
    assert {r.h: r.r for r in df.collect()} == {h: want(h) for h in hosts}
    assert "split(" not in plan(df)


def test_names_are_tried_once(spark):
    cookies = spark.range(3).selectExpr("id AS seq", "'site.com' AS site", "'pre' AS state", "concat('_g', id) AS name", "'.other.net' AS cookie_domain", "1L AS as_of", "2L AS expires")
    made = classify.classify_cookies(cookies, classify.tracker_map(spark), classify.block_lists(spark), classify.fallback_map(spark))
    assert plan(made).count("(?i)") == len(params.HEURISTICS)


def test_markup_of_a_batch_is_read_once(monkeypatch):
    seen, read = [], banner._read
    monkeypatch.setattr(banner, "_read", lambda h: seen.append(h) or read(h))
    pages = pa.array(["<p id=a>x</p>", None, "<a href=/>y</a>", "<p id=a>x</p>", "", "<p id=a>x</p>"])
    got = banner._read_all(pages).to_pylist()
    assert sorted(seen) == sorted({h or "" for h in pages.to_pylist()})
    assert [len(e) for e in got] == [1, 0, 1, 1, 0, 1] and dict(got[3][0]["attrs"]) == {"id": "a"} and got[2][0]["text"] == "y"


def test_visible_text_is_made_once(spark):
    banners = spark.createDataFrame([("d", "<p>no thanks</p>", True, True, 1, 1)], "domain string, html string, found boolean, has_reject boolean, accept_clicks int, reject_clicks int")
    buttons = spark.createDataFrame([], "domain string, pos int, kind string, width string, height string, font_size string, font_weight string, color string, background string, display string, visibility string")
    assert plan(banner.dark_patterns(banners, buttons)).count("(script|style)[^>]*>.*?") == 1


def test_signals_read_no_requests_again(spark):
    made = classify.pre_consent_signals(queries.classified(spark, SF), queries.third_parties(spark, SF))
    assert not re.search(r"\b(host|url)#", plan(made))


def test_study_figures_read_no_requests_again(spark):
    """Once the steps that they share with other reports are stored."""
    queries.report_sites(spark, SF)
    assert not re.search(r"\b(host|url)#", plan(more.study_figures(spark, SF)))
