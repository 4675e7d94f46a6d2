"""What the training-data operators share: table access, the shared folder, batch sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers live on between tasks: this allocator gives memory back, the default one keeps the most that it ever had.
pa.set_memory_pool(pa.system_memory_pool())

#: The ASCII white space that separates words and surrounds lines (fixed value).
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular-expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, a temporary one, in local mode only."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="crumbtrail-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where written() notes its paths, if a caller collects them.
_collected: ContextVar[list[str] | None] = ContextVar("collected", default=None)


@contextmanager
def collected(paths: list[str]) -> Iterator[None]:
    """What written() makes inside is noted in paths, for drop_tables()."""
    token = _collected.set(paths)
    try:
        yield
    finally:
        _collected.reset(token)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if (paths := _collected.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Removes collected tables. For callers whose results are all stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while paths:
        at = hadoop(paths.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class KeyFilter:
    """A test of longs that never says no to one of the keys, and seldom yes to others.

    Rows that fail it need not be shuffled to meet the keys. What is broadcast is a bitmap of at
    most 2^27 bits, whatever the number of keys; beyond about 10^8 keys it lets most rows pass,
    and only the volume of the shuffle behind it grows.
    """

    def __init__(self, keys: DataFrame) -> None:
        """keys: one long column."""
        (name,) = keys.columns
        self.bits = min(27, max(13, (16 * keys.count()).bit_length()))
        at = keys.select(F.expr(f"`{name}` & {(1 << self.bits) - 1}L").alias("p"))
        words = at.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toPandas()
        table_ = np.zeros(1 << (self.bits - 6), np.int64)
        table_[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
        self.shared = keys.sparkSession.sparkContext.broadcast(table_)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        p = h & ((1 << self.bits) - 1)
        return (self.shared.value[p >> 6] >> (p & 63) & 1).astype(bool)

    def column(self, key: Column) -> Column:
        """The test as a column."""
        return F.pandas_udf(lambda h: pd.Series(self(h.to_numpy(np.int64))), "boolean")(key)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bounds what a Python worker holds at once: a batch is at most so many rows or 2 MB, or one longer text. What
    operators make of a batch is many times its size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
