"""The last or the next value of a key's rows in order, without a window over a key's whole history.

Rows are range-partitioned by key and order, so a long history spreads over partitions. Windows run within a key's stretch of
one partition; what reaches over the edge comes from one row for each stretch. Only the first (or last) stretch of a partition
can go on from another one, so what is sent to the rows has at most one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.plans.store import stored


def ordered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with ``part_``, the number of the range that a row lies in, written. Null keys are keys like others."""
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(df.repartitionByRange(parts, *keys, *order).withColumn("part_", F.spark_partition_id()), "ordered")


def _joined(df: DataFrame, edge: DataFrame, keys: list[str]) -> DataFrame:
    """df with what edge has for its stretch. edge has at most one row for each range, so it may be broadcast."""
    names = ["part_", *keys]
    other = edge.select(*[F.col(c).alias(f"{c}_e") for c in names], *[c for c in edge.columns if c not in names])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_e")) for c in names]
    return df.join(F.broadcast(other), same, "left").drop(*[f"{c}_e" for c in names])


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, *, ahead: bool = False) -> DataFrame:
    """df, of ordered(), with the last non-null value of the key's rows before each row (ahead: the first after it), null if there is
    none. The columns of order together tell all rows of a key apart."""
    way = [F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    own = Window.partitionBy("part_", *keys).orderBy(*way).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if ahead else F.max_by
    # Rows without a value have no place in the order, and so are not picked.
    ends = df.groupBy("part_", *keys).agg(pick(value, F.when(value.isNotNull(), F.struct(*order))).alias("end_"))
    across = Window.partitionBy(*keys).orderBy(F.desc("part_") if ahead else F.asc("part_")).rowsBetween(Window.unboundedPreceding, -1)
    edge = ends.select("part_", *keys, F.last("end_", ignorenulls=True).over(across).alias("edge_")).where("edge_ IS NOT NULL")
    near = df.withColumn("near_", F.last(value, ignorenulls=True).over(own))
    return _joined(near, edge, keys).withColumn(name, F.coalesce("near_", "edge_")).drop("near_", "edge_")


def counted(df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """df, of ordered(), with the number of the key's rows up to and with each row whose flag (0 or 1) is set."""
    own = Window.partitionBy("part_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("part_", *keys).agg(F.sum(flag).alias("sum_"))
    edge = sums.select("part_", *keys, F.sum("sum_").over(across).alias("edge_")).where("edge_ IS NOT NULL")
    near = df.withColumn("near_", F.sum(flag).over(own))
    return _joined(near, edge, keys).withColumn(name, F.col("near_") + F.coalesce("edge_", F.lit(0))).drop("near_", "edge_")
