"""Differential privacy with noise from keyed hashes: the same under any partitioning and on a retried task.

Every draw is a function of a secret, the name of the release, the metric, the whole epsilon and the
number of the draw. Who does not hold the secret cannot compute the noise; two budgets or two
releases share no draw. The secret must be random, kept apart, and used for no second data set under
the same release name, as equal noise on changed data would show the change.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.functions.labels import epsilon_note
from crumbtrail.plans import params as P


@dataclass(frozen=True)
class Key:
    """The secret of a release and its name."""

    secret: str
    release: str

    def __post_init__(self) -> None:
        if not self.secret or not self.release:
            raise ValueError("a release needs a secret and a name")

    def of(self, *parts: Column) -> Column:
        return F.concat_ws("|", F.lit(self.secret), F.lit(self.release), *[p.cast("string") for p in parts])


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the hash of a key."""
    return (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 13), 16, 10).cast("bigint") + 0.5) / float(2**52)


def laplace(value: Column, sensitivity: Column, epsilon: Column, key: Column) -> Column:
    u = uniform(key) - 0.5
    return value - sensitivity / epsilon * F.signum(u) * F.log(1 - 2 * F.abs(u))


def gaussian(value: Column, sensitivity: Column, epsilon: Column, key: Column, delta: float = 1e-5) -> Column:
    sigma = sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon
    radius = F.sqrt(-2 * F.log(uniform(F.concat(key, F.lit("|a")))))
    return value + sigma * radius * F.cos(2 * F.pi() * uniform(F.concat(key, F.lit("|b"))))


def randomized_response(truth: Column, epsilon: Column, key: Column) -> Column:
    return F.when(uniform(key) < F.exp(epsilon) / (1 + F.exp(epsilon)), truth).otherwise(~truth)


def epsilons(df: DataFrame) -> DataFrame:
    """Each row with each budget."""
    return df.withColumn("epsilon", F.explode(F.array(*[F.lit(float(e)) for e in P.EPSILONS])))


def _noisy(key: Key, draw: Column, mechanism: str = "laplace") -> Column:
    """One draw for a row of queries: a count as percentage of its total, from a count clamped and rounded to a tenth; a mean
    clamped to its range and rounded to a hundredth."""
    noise = laplace if mechanism == "laplace" else gaussian
    k = key.of(F.col("metric"), F.col("epsilon"), F.lit(mechanism), draw)
    count = F.col("kind") == "count"
    sensitivity = F.when(count, F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / F.greatest("n", F.lit(1)))
    x = noise(F.col("value"), sensitivity, F.col("epsilon"), k)
    pct = F.coalesce(F.try_divide(100.0 * F.round(F.greatest(F.lit(0.0), F.least(x, F.col("n").cast("double"))), 1), F.col("n")), F.lit(0.0))
    return F.when(count, pct).otherwise(F.round(F.greatest(F.col("lo"), F.least(x, F.col("hi"))), 2))


def true_value() -> Column:
    return F.when(F.col("kind") == "count", F.coalesce(F.try_divide(100.0 * F.col("value"), F.col("n")), F.lit(0.0))).otherwise(F.col("value"))


def release(queries: DataFrame, key: Key, mechanism: str = "laplace") -> DataFrame:
    """queries: metric, kind (count or mean), value, n (total, or number of values), lo, hi. One draw per metric and budget:
    publishing one budget's rows spends that budget once per metric."""
    df = epsilons(queries)
    return df.select("metric", "epsilon", true_value().alias("truth"), _noisy(key, F.lit(0), mechanism).alias("noisy"))


def trials(queries: DataFrame, key: Key, times: int = 100) -> DataFrame:
    """Mean, deviation, error and empirical 95 % interval of repeated draws: a study of utility. Spends times x epsilon if its
    means are published."""
    df = epsilons(queries).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(times))))
    df = df.select("metric", "epsilon", "t", true_value().alias("truth"), _noisy(key, F.col("t")).alias("x"))
    df = df.withColumn("r", F.row_number().over(Window.partitionBy("metric", "epsilon").orderBy("x", "t")))
    lo, hi = int(0.025 * times), min(int(0.975 * times), times - 1)
    return df.groupBy("metric", "epsilon").agg(
        F.max("truth").alias("truth"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.avg(F.abs(F.col("x") - F.col("truth"))).alias("mae"),
        F.max(F.when(F.col("r") == lo + 1, F.col("x"))).alias("ci_lo"), F.max(F.when(F.col("r") == hi + 1, F.col("x"))).alias("ci_hi"),
    )


#: Metrics that the budget is chosen by (fixed value).
KEY_METRICS = ["pre_consent_tracker_percentage", "sites_with_reject_button_percentage", "sites_with_dark_patterns_percentage", "avg_compliance_score", "avg_pre_consent_trackers"]


def recommend_epsilon(stats: DataFrame, share: float = 0.6) -> DataFrame:
    """The least budget at which most key metrics have little error; 1 if there is none."""
    good = F.when(F.col("truth") > 0, F.col("mae") / F.col("truth") < 0.05).otherwise((F.col("truth") == 0) & (F.col("mae") < 1))
    ok = stats.where(F.col("metric").isin(KEY_METRICS)).groupBy("epsilon").agg(F.avg(good.cast("double")).alias("part")).where(F.col("part") >= share)
    return ok.agg(F.coalesce(F.min("epsilon"), F.lit(1.0)).alias("epsilon"))


def protected(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """The means at the recommended budget. chosen: one row, column epsilon."""
    return stats.join(F.broadcast(chosen.limit(1)), "epsilon").select("metric", "epsilon", F.round("mean", 2).alias("protected"))


def cost(stats: DataFrame) -> DataFrame:
    return stats.groupBy("epsilon").agg(F.avg("mae").alias("mean_mae"), F.count("*").alias("queries"))


def error_matrix(stats: DataFrame) -> DataFrame:
    """Errors by metric and budget, side by side."""
    named = stats.withColumn("e", F.concat(F.lit("e"), F.regexp_replace(F.col("epsilon").cast("string"), r"\.", "_")))
    return named.groupBy("metric").pivot("e", [f"e{e}".replace(".", "_") for e in P.EPSILONS]).agg(F.max("mae"))


def trade_off(stats: DataFrame) -> DataFrame:
    """The error of each metric over the budgets with a band of 0.3 deviations, and the first budget with an error below 5."""
    first = stats.groupBy("metric").agg(F.min(F.when(F.col("mae") < 5, F.col("epsilon"))).alias("enough"))
    band = 0.3 * F.col("sd")
    return stats.join(first, "metric").select("metric", "epsilon", "mae", F.greatest(F.lit(0.0), F.col("mae") - band).alias("low"), (F.col("mae") + band).alias("high"), "enough")


def response_trials(rows: DataFrame, id_col: str, attributes: list[str], key: Key, times: int = 20) -> DataFrame:
    """Randomized response of each row's attributes, with the share of truths recovered from it: per attribute and budget the
    mean estimate over the draws, clamped to 0..1, and its error."""
    each = rows.select(id_col, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("truth")) for a in attributes])).alias("x")).select(id_col, "x.*")
    df = epsilons(each).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(times))))
    said = randomized_response(F.col("truth"), F.col("epsilon"), key.of(F.col("attribute"), F.col(id_col), F.col("epsilon"), F.col("t")))
    per = df.groupBy("attribute", "epsilon", "t").agg(F.count("*").alias("n"), F.count_if("truth").alias("true_n"), F.count_if(said).alias("said"))
    p = F.exp("epsilon") / (1 + F.exp("epsilon"))
    per = per.withColumn("estimate", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("said") / F.col("n") - (1 - p)) / (2 * p - 1))))
    out = per.groupBy("attribute", "epsilon").agg(F.max("n").alias("n"), F.max(F.col("true_n") / F.col("n")).alias("truth"), F.avg("estimate").alias("estimate"))
    return out.withColumns({"error": F.abs(F.col("estimate") - F.col("truth")), "note": epsilon_note(F.col("epsilon"))})


def _quantile(n: int, p: float, u: float) -> int:
    """The least k at which the binomial distribution function reaches u. Weights follow from the mode by their ratios; beyond 40
    deviations they are zero in doubles."""
    if n <= 0:
        return 0
    mode = min(int((n + 1) * p), n)
    reach = int(40 * math.sqrt(n * p * (1 - p))) + 40
    lo, hi = max(0, mode - reach), min(n, mode + reach)
    k = np.arange(lo, hi)
    up = np.cumsum(np.log((n - k) / (k + 1)) + math.log(p / (1 - p)))
    logs = np.r_[0.0, up]
    weights = np.exp(logs - logs.max())
    cdf = np.cumsum(weights)
    return lo + min(int(np.searchsorted(cdf, u * cdf[-1])), hi - lo)


def binomial(n: Column, p: Column, key: Column) -> Column:
    """One draw of the number of successes among n, a function of the key: the distribution's quantile of the key's uniform number.
    Work grows with the root of n."""
    draw = F.pandas_udf(lambda n, p, u: pd.Series([_quantile(*x) for x in zip(n.tolist(), p.tolist(), u.tolist())], dtype="int64"), "long")
    return draw(n.cast("long"), p, uniform(key))


def counted_trials(rows: DataFrame, attributes: list[str], key: Key, times: int = 20) -> DataFrame:
    """As response_trials(), with the number of rows that say yes drawn as a whole: those whose truth is yes and those whose truth
    is no are each one binomial draw. The rows are only counted, once, so draws cost the same whatever their number."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(a).alias(a) for a in attributes])
    each = counts.select("n", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("true_n")) for a in attributes])).alias("x")).select("n", "x.*")
    df = epsilons(each).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(times))))
    p = F.exp("epsilon") / (1 + F.exp("epsilon"))
    k = lambda part: key.of(F.col("attribute"), F.lit(part), F.col("epsilon"), F.col("t"))
    df = df.withColumn("said", binomial(F.col("true_n"), p, k("yes")) + binomial(F.col("n") - F.col("true_n"), 1 - p, k("no")))
    df = df.withColumn("estimate", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.try_divide(F.col("said"), F.col("n")) - (1 - p)) / (2 * p - 1))))
    out = df.groupBy("attribute", "epsilon").agg(F.max("n").alias("n"), F.max(F.try_divide("true_n", "n")).alias("truth"), F.avg("estimate").alias("estimate"), F.coalesce(F.stddev_samp("estimate"), F.lit(0.0)).alias("spread"))
    return out.withColumns({"error": F.abs(F.col("estimate") - F.col("truth")), "note": epsilon_note(F.col("epsilon"))})
