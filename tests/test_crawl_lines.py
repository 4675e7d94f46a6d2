"""Crawl documents as lines: files do not grow in number with the sites, and what cannot be read is left out."""

import pathlib

from crumbtrail.plans import edges
from crumbtrail.sources import readers


def test_documents_share_files(spark):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("crawl-*"))
    sites = edges.crawl_states(spark, "/root/testdata/sf0.01").select("domain").distinct().count()
    (made,) = set(shared.glob("crawl-*")) - before
    assert sites > 100 and len(list(made.glob("*.json"))) < sites / 5


def test_unreadable_lines_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"domain": "x.com", "success": true}\n{"domain": \n{"domain": "y.com"}\n{"success": true}\n')
    got = readers.read_crawl(spark, str(tmp_path), lines=True).select("domain").collect()
    assert sorted(str(r.domain) for r in got) == ["None", "x.com", "y.com"]
