"""Aggregates over sites, cookies and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.functions.text import safe_pct
from crumbtrail.plans import params as P


def crawl_summary(banners: DataFrame) -> DataFrame:
    ok = F.col("success")
    return banners.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
        F.count_if(ok & F.col("found")).alias("with_banner"), F.count_if(ok & ~F.col("found")).alias("without_banner"),
    )


def violations(sites: DataFrame, signals: DataFrame) -> DataFrame:
    """Sites with signals before consent, over all (category null, overall true) and by category, in one pass."""
    n = F.coalesce(F.col("trackers") + F.col("third_parties"), F.lit(0))
    df = sites.where("success").join(signals.withColumnRenamed("site", "domain"), "domain", "left")
    df = df.select(F.coalesce(F.nullif("category", F.lit("")), F.lit("Unknown")).alias("category"), n.alias("n"))
    out = df.rollup("category").agg(F.grouping("category").alias("g"), F.count("*").alias("sites"), F.count_if(F.col("n") > 0).alias("violating"), F.avg("n").alias("mean_signals"), F.median("n").alias("median_signals"))
    return out.select("category", (F.col("g") == 1).alias("overall"), "sites", "violating", safe_pct(F.col("violating"), F.col("sites")).alias("pct"), "mean_signals", "median_signals")


def vendor_prevalence(classified: DataFrame, n_sites: DataFrame, top: int) -> DataFrame:
    """The vendors on most sites, with their share of all crawled sites; a top-k report. n_sites: one row, column n."""
    out = classified.where("is_tracker").groupBy("vendor").agg(F.count_distinct("site").alias("sites"), F.count("*").alias("cookies"))
    head = out.orderBy(F.desc("sites"), F.desc("cookies"), "vendor").limit(top)
    # One row beside the few of the report.
    return head.crossJoin(F.broadcast(n_sites.select("n").limit(1))).select("vendor", "sites", "cookies", safe_pct(F.col("sites"), F.col("n")).alias("pct"))


def with_others(counts: DataFrame, key: str, value: str, top: int) -> DataFrame:
    """The ``top`` largest keys and the sum of the rest as Others."""
    head = counts.orderBy(F.desc(value), key).limit(top).select(F.col(key).alias("k_"))
    named = counts.join(head, counts[key] == F.col("k_"), "left").select(F.coalesce("k_", F.lit("Others")).alias(key), value)
    return named.groupBy(key).agg(F.sum(value).alias(value))


def share(df: DataFrame, key: str) -> DataFrame:
    out = df.groupBy(key).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def before_after(requests: DataFrame, third: Column, host: Column) -> DataFrame:
    """Distinct third parties per site and state, side by side, and their means."""
    per = requests.where(third).groupBy("site").pivot("state", ["pre", "accept", "reject"]).agg(F.count_distinct(host))
    return per.agg(
        F.count("*").alias("sites"), F.avg("pre").alias("mean_pre"), F.avg("accept").alias("mean_accept"), F.avg("reject").alias("mean_reject"),
        F.count_if(F.col("reject") < F.col("pre")).alias("reduces"), F.count_if(F.coalesce("reject", F.lit(0)) == 0).alias("eliminates"),
    )


def after_rejecting(states: DataFrame) -> DataFrame:
    """Sites, and those with fewer and with no third parties after rejecting. states: as from plans.queries.states()."""
    return states.agg(F.count("*").alias("sites"), F.count_if(F.col("n_reject") < F.nullif("n_pre", F.lit(0))).alias("reduces"), F.count_if(F.col("n_reject").isNull()).alias("eliminates"))


def banner_analysis(banners: DataFrame) -> DataFrame:
    b = banners.where("success AND found")
    reach = lambda c: F.when(F.col(c) < 999, F.col(c))
    return b.agg(
        F.count("*").alias("banners"), F.count_if("has_reject").alias("with_reject"), F.avg(reach("accept_clicks")).alias("mean_accept_clicks"),
        F.avg(reach("reject_clicks")).alias("mean_reject_clicks"), F.count_if((F.col("reject_clicks") < 999) & (F.col("accept_clicks") == F.col("reject_clicks"))).alias("equal_effort"),
    )


def pattern_prevalence(patterns: DataFrame) -> DataFrame:
    """Sites by pattern; the share is of all sites looked at."""
    total = patterns.agg(F.count("*").alias("total"))
    each = patterns.select(F.explode("names").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("sites"))
    return each.crossJoin(F.broadcast(total)).select("pattern", "sites", safe_pct(F.col("sites"), F.col("total")).alias("pct"))


def pattern_totals(patterns: DataFrame) -> DataFrame:
    """Sites looked at, those with any pattern, their share, and the mean number."""
    out = patterns.agg(F.count("*").alias("sites"), F.count_if(F.col("n_patterns") > 0).alias("any_pattern"), F.avg("n_patterns").alias("mean_patterns"))
    return out.withColumn("pct", safe_pct(F.col("any_pattern"), F.col("sites")))


def score_stats(scores: DataFrame, key: str | None = None) -> DataFrame:
    s = "overall"
    aggs = [F.count(s).alias("n"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("sd"), F.min(s).alias("least"), F.max(s).alias("most")]
    return scores.groupBy(key).agg(*aggs) if key else scores.agg(*aggs)


def grade_distribution(scores: DataFrame) -> DataFrame:
    """All five grades, with zeros."""
    all_grades = scores.sparkSession.sql(P.values([(g,) for _, g in P.GRADES], "grade"))
    return all_grades.join(scores.groupBy("grade").agg(F.count("*").alias("n")), "grade", "left").select("grade", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(scores: DataFrame, bins: int = 20, hi: float = 100.0) -> DataFrame:
    b = F.least(F.floor(F.col("overall") / (hi / bins)).cast("int") + 1, F.lit(bins))
    return scores.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def density(scores: DataFrame, points: int = 200, hi: float = 100.0) -> DataFrame:
    """Gaussian kernel density on a fixed grid; scores are counted by value first, so the grid meets distinct values only."""
    spark = scores.sparkSession
    by_value = scores.groupBy("overall").agg(F.count("*").alias("w"))
    band = scores.agg((0.3 * F.stddev_samp("overall")).alias("h"), F.count("*").alias("n"))
    grid = spark.range(points).select(F.col("id").cast("int").alias("i"), (F.col("id") * hi / (points - 1)).alias("x"))
    met = by_value.crossJoin(F.broadcast(band)).crossJoin(F.broadcast(grid))
    z = (F.col("x") - F.col("overall")) / F.col("h")
    term = F.col("w") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * F.sqrt(F.lit(2) * F.pi()))
    return met.groupBy("i").agg(F.sum(term).alias("density"))


def pivot_mean(df: DataFrame, row: str, col: str, value: str, columns: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, columns).agg(F.avg(value))


def pivot_regions(df: DataFrame, row: str, region: str, cmp: str, value: str, regions: list[str], platforms: list[str]) -> DataFrame:
    """Means by row and region, or by row and platform where there are fewer than three regions. Counts the regions, in a job
    of its own, when it is called."""
    n = df.agg(F.count_distinct(region).alias("n")).first().n
    return pivot_mean(df, row, region, value, regions) if n >= 3 else pivot_mean(df, row, cmp, value, platforms)


def ends(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n best and the n worst rows; a top-k report."""
    best = df.orderBy(F.desc(value), key).limit(n).select(F.lit("top").alias("end"), key, value)
    return best.unionByName(df.orderBy(value, key).limit(n).select(F.lit("bottom").alias("end"), key, value))


def run_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each of several columns, in one pass: name of the column, value, n."""
    sets = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x"))
    return sets.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
