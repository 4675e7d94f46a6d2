"""Tables written once and read many times, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, in local mode only."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="crumbtrail-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table, reread: evaluated once, and safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As stored(), laid out by a key: tables of the same number of buckets join and group by it without a shuffle."""
    spark = df.sparkSession
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = re.sub(r"\W", "_", f"{name}_{uuid.uuid4().hex}")
    out = df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
    out.option("path", new_folder(spark, name)).saveAsTable(table)
    return spark.table(table)


#: Tables of this process, by application, input folder and name.
_known: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The table of that name over the input folder, made and written at its first use; with ``by`` in buckets of that column. Inputs
    must not change while an application runs; forget() drops what is known otherwise."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _known:
        _known[key] = bucketed(make(), name, by) if by else stored(make(), name)
    return _known[key]


def forget(*, inputs: bool = True) -> None:
    """Drops what is known of stored tables; without inputs the canonical tables (a_...) stay."""
    for key in [k for k in _known if inputs or not k[2].startswith("a_")]:
        del _known[key]
