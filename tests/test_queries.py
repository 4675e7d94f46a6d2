"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = sorted(entry.core.SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(pdf):
    def value(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 5) if isinstance(v, float) else v

    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return sorted((tuple(value(v) for v in r) for r in pdf.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    got, want = entry.core.QUERIES[name](spark, SF).toPandas(), duck.sql(entry.core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
