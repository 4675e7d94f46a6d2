"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Each document gets word, symbol and repetition counts; four statistics made of them are
transformed and compared with the minimum-covariance-determinant estimate of the document's
language and source. A document far from it by Mahalanobis distance, or failing the base
rule, is not kept. The estimate comes from C-steps: again and again the share ``support`` of a
group with the least distances gives the next mean and covariance. Three deterministic starts
take two steps each; the one with the least determinant goes on until that stops falling.
All of it is per-group aggregation with partial sums, so a group that holds a third of the rows
is no more work for any one task than another.

Defined cases: a null text has no words and fails the base rule; null languages and sources
are groups of their own; a group with fewer than ``min_group`` documents that pass the base
rule is judged by the estimate of its whole language, a language with fewer by that of all
documents; with fewer in all nothing is estimated and the base rule alone decides; constant statistics are held off singularity by ``FLOORS``; equal
rows get equal verdicts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail.llm.common import SPACE_CLASS, SPACES, table, written

#: Characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
#: The transformed statistics, and the least standard deviation assumed for each. Smaller ones make outliers
#: of sound documents in groups where most repeat nothing: see the README.
FLOORS = {"x0": 0.06, "x1": 0.05, "x2": 0.15, "x3": 0.15}
XS = list(FLOORS)
DIMS = len(XS)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed added."""
    keep = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*keep, text.alias("t_")).withColumn("s_", F.btrim("t_", F.lit(SPACES)))
    df = df.withColumn("w_", F.when(F.col("s_") == "", F.array().cast("array<string>")).otherwise(F.split("s_", SPACE_CLASS + "+")))
    df = df.withColumn("l_", F.filter(F.split("t_", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    df = df.select(
        *keep,
        F.size("w_").cast("long").alias("n_words"),
        F.char_length(F.translate("s_", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("t_") - F.char_length(F.translate("t_", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
        F.size("l_").cast("long").alias("n_lines"),
        # A hash for each window of three words.
        F.expr("CASE WHEN size(w_) >= 3 THEN transform(sequence(0, size(w_) - 3), i -> xxhash64(w_[i], w_[i + 1], w_[i + 2])) END").alias("h_"),
    )
    # Most texts repeat no window; only the others are sorted by (hash, position).
    df = df.withColumn("p_", F.expr("CASE WHEN size(array_distinct(h_)) < size(h_) THEN sort_array(transform(h_, (h, i) -> struct(h, i))) END"))
    twice = "filter(p_, (x, i) -> (i > 0 AND p_[greatest(i - 1, 0)].h = x.h) OR (i < size(p_) - 1 AND p_[least(i + 1, size(p_) - 1)].h = x.h))"
    df = df.withColumn("p_", F.expr(f"sort_array(transform({twice}, x -> x.i))"))
    # A repeated window adds its words up to the next repeated one.
    covered = "aggregate(transform(p_, (x, i) -> if(i < size(p_) - 1, least(3, p_[least(i + 1, size(p_) - 1)] - x), 3)), 0L, (a, x) -> a + x)"
    df = df.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("p_", "h_")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _statistics(df: DataFrame) -> DataFrame:
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return df.withColumns(
        {
            "x0": F.log(chars / words),
            "x1": F.sqrt(F.col("n_symbols") / chars),
            "x2": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
            "x3": F.sqrt(F.col("n_repeat_words") / words),
        }
    )


def _below4(q: float) -> float:
    """The chi-squared distribution with DIMS = 4 degrees of freedom."""
    return 1 - math.exp(-q / 2) * (1 + q / 2)


def _quantile(share: float) -> float:
    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _below4(mid) < share else (lo, mid)
    return lo


def _consistency(support: float) -> float:
    """What the covariance of the inner share of a normal sample is short of, for DIMS = 4."""
    below6 = lambda q: 1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8)
    return support / below6(_quantile(support))


#: A squared distance that one sound document in a thousand goes beyond, were its statistics normal: 18.47.
CUTOFF = _quantile(0.999)


def _cholesky(params: DataFrame, *keys: str) -> DataFrame:
    """m0.. and the lower Cholesky factor l00, l10, .. of the covariances c00, c10, .. , and ln of their determinant."""
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(f"l{i}{i}") for i in range(DIMS)), F.lit(0.0))
    return params.select(*keys, *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in PAIRS], det.alias("log_det"))


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    total: Column = F.lit(0.0)
    for i in range(DIMS):
        rest = F.col(XS[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return df.withColumn("d2", total)


def _moments(rows: DataFrame, factor: float, *keys: str) -> DataFrame:
    """Mean and covariance of each group, the latter enlarged by what trimming took off, and held off singularity."""
    means = [F.avg(x).alias(f"m{i}") for i, x in enumerate(XS)]
    prods = [F.covar_pop(XS[i], XS[j]).alias(f"v{i}{j}") for i, j in PAIRS]
    covs = [(F.col(f"v{i}{j}") * factor + (FLOORS[XS[i]] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    return rows.groupBy(*keys).agg(*means, *prods).select(*keys, *[f"m{i}" for i in range(DIMS)], *covs)


def _starts(rows: DataFrame) -> DataFrame:
    """Three first estimates for each group, by s_: medians with quartile ranges alone; with the correlations of the
    hyperbolic tangents of the scaled values; mean and covariance of the half nearest to the medians."""
    quartiles = rows.groupBy("g_").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(f"q_{x}") for x in XS])
    scale = lambda x: F.sqrt(F.pow((F.col(f"q_{x}")[2] - F.col(f"q_{x}")[0]) / 1.349, 2) + FLOORS[x] ** 2)
    centre = written(quartiles.select("g_", *[F.col(f"q_{x}")[1].alias(f"m{i}") for i, x in enumerate(XS)], *[scale(x).alias(f"s{i}") for i, x in enumerate(XS)]), "mcd")
    scaled = rows.join(centre, "g_").withColumns({f"u{i}": (F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(XS)})
    scaled = scaled.withColumn("norm", sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(DIMS)), F.lit(0.0)))
    half = written(scaled.groupBy("g_").agg(F.percentile_approx("norm", 0.5, 2000).alias("half")), "mcd")
    means = [f"m{i}" for i in range(DIMS)]
    plain = centre.select("g_", F.lit(0).alias("s_"), *means, *[(F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])
    tanh = lambda i: F.tanh(f"u{i}")
    alike = lambda i, j: F.try_divide(F.covar_pop(tanh(i), tanh(j)), F.stddev_pop(tanh(i)) * F.stddev_pop(tanh(j)))
    # A constant statistic goes with no other.
    like = scaled.groupBy("g_").agg(*[F.coalesce(alike(i, j), F.lit(0.0)).alias(f"r{i}{j}") for i, j in PAIRS if i != j])
    # A little less than the correlations found, so that the matrix has an inverse.
    shaped = centre.join(like, "g_").select(
        "g_", F.lit(1).alias("s_"), *means, *[(F.col(f"s{i}") * F.col(f"s{j}") * (1.0 if i == j else 0.95 * F.col(f"r{i}{j}"))).alias(f"c{i}{j}") for i, j in PAIRS]
    )
    near = _moments(scaled.join(half, "g_").where("norm <= half"), _consistency(0.5), "g_").withColumn("s_", F.lit(2))
    return written(_cholesky(plain.unionByName(shaped).unionByName(near), "g_", "s_"), "mcd")


def _step(rows: DataFrame, params: DataFrame, support: float) -> DataFrame:
    """One C-step of each estimate: the share ``support`` of its group with the least distances gives the next one."""
    seen = _distance(rows.join(params, "g_"))
    # Written, so that its size is known: Spark broadcasts it as long as that is small.
    inner = written(seen.groupBy("g_", "s_").agg(F.percentile_approx("d2", support, 2000).alias("r2")), "mcd")
    subset = seen.join(inner, ["g_", "s_"]).where(F.col("d2") <= F.col("r2"))
    return written(_cholesky(_moments(subset, _consistency(support), "g_", "s_"), "g_", "s_"), "mcd")


def mcd(rows: DataFrame, *, support: float = 0.75, max_steps: int = 12, tolerance: float = 1e-3) -> DataFrame:
    """A row per group g_ with the mean and Cholesky factor of its minimum-covariance-determinant estimate.

    Two C-steps from each of three starts; then each group goes on from the one with the least determinant, until no
    group's logarithm of it falls by more than the tolerance.
    """
    params = _starts(rows)
    for _ in range(2):
        params = _step(rows, params, support)
    names = [c for c in params.columns if c != "g_"]
    best = params.groupBy("g_").agg(F.min_by(F.struct(*names), F.struct("log_det", "s_")).alias("b"))
    params = written(best.select("g_", "b.*"), "mcd")
    for _ in range(2, max_steps):
        after = _step(rows, params, support)
        # A number goes to the driver.
        fall = after.join(params.select("g_", F.col("log_det").alias("before")), "g_").agg(F.max(F.col("before") - F.col("log_det"))).first()[0]
        params = after
        if fall is None or fall <= tolerance:
            break
    return params.drop("s_", "log_det")


def judge(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    cutoff: float = CUTOFF,
    support: float = 0.75,
    max_steps: int = 12,
    min_group: int = 50,
) -> DataFrame:
    """docs without the text, with the counts, ``distance2`` (null if nothing was estimated) and ``kept``."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    own = [c for c in docs.columns if c not in (text_col, *added, "distance2", "kept")]
    # The document's own columns travel as one, so that no name can clash.
    row = F.struct(*own) if own else F.struct(F.lit(0).alias("none_"))
    names = [
        F.concat(F.lit("2"), F.to_json(F.struct(F.col(lang_col).alias("l"), F.col(source_col).alias("s")))).alias("g2"),
        F.concat(F.lit("1"), F.to_json(F.struct(F.col(lang_col).alias("l")))).alias("g1"),
        F.lit("0").alias("g0"),
    ]
    stats = written(_statistics(counts(docs.select(row.alias("row_"), *names, F.col(text_col).alias("text_")), "text_")), "doc-stats")
    sound = stats.where(~F.col("base_failed"))
    each = sound.select(F.explode(F.array("g2", "g1", "g0")).alias("g_"), *XS)
    large = written(each.groupBy("g_").agg(F.count("*").alias("size_")).where(F.col("size_") >= min_group).select("g_"), "group-sizes")
    # A document is judged by its language and source, or else its language, or else all.
    grouped = stats
    for g in ("g2", "g1", "g0"):
        grouped = grouped.join(large.select(F.col("g_").alias(g), F.lit(True).alias(f"{g}_")), g, "left")
    grouped = grouped.withColumn("g_", F.coalesce(*[F.when(F.col(f"{g}_"), F.col(g)) for g in ("g2", "g1", "g0")])).drop("g2_", "g1_", "g0_")
    used = written(grouped.select("g_").where("g_ IS NOT NULL").distinct(), "groups-used")
    params = mcd(each.join(used, "g_"), support=support, max_steps=max_steps)
    seen = _distance(grouped.join(params, "g_", "left"))
    return seen.select(
        *[F.col("row_").getField(c).alias(c) for c in own],
        *added,
        F.col("d2").alias("distance2"),
        (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
