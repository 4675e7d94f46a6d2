"""Values carried over the edges of ranges equal windows over whole keys."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from crumbtrail.operators import asof


def test_equals_windows_over_whole_keys(spark):
    pick = random.Random(7)
    # Most rows are of one key, which spreads over ranges; one key is null.
    rows = [(i, pick.choice(["hot"] * 8 + ["a", "b", None]), pick.randrange(300), pick.choice([None, None, None, i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v long")
    placed = asof.ordered(df, ["k"], ["t", "id"])
    assert placed.where("k = 'hot'").select("part_").distinct().count() > 3
    for ahead in (False, True):
        got = asof.carried(placed, ["k"], ["t", "id"], F.col("v"), "x", ahead=ahead)
        w = Window.partitionBy("k").orderBy(*([F.desc("t"), F.desc("id")] if ahead else ["t", "id"])).rowsBetween(Window.unboundedPreceding, -1)
        want = df.withColumn("x", F.last("v", ignorenulls=True).over(w))
        assert sorted((r.id, r.x) for r in got.collect()) == sorted((r.id, r.x) for r in want.collect())
    got = asof.counted(placed.withColumn("one", F.when(F.col("v").isNull(), 0).otherwise(1)), ["k"], ["t", "id"], F.col("one"), "n")
    want = df.withColumn("n", F.count("v").over(Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted((r.id, r.n) for r in got.collect()) == sorted((r.id, r.n) for r in want.collect())
    assert asof.carried(asof.ordered(df.where("false"), ["k"], ["t", "id"]), ["k"], ["t", "id"], F.col("v"), "x").count() == 0
