"""Smaller operators: candidates and frames, explanations, entropy, findings, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.plans import params as P
from crumbtrail.plans.store import stored


def pick_candidate(candidates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first candidate of each key in an order that ends with a unique column."""
    return candidates.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def best_frames(scans: DataFrame, key: str) -> DataFrame:
    """For each key the frame whose scan has found most: by points, then a button to refuse, then any button, then the lowest frame
    (null last). Frames that failed do not count; where all did, error says why, each reason once. scans: key, frame, error,
    timed_out and the columns of labels.scan_quality(). A key has few frames."""
    from crumbtrail.functions.labels import POINTS, scan_quality

    ok = F.col("error").isNull()
    controls = F.col("has_accept") | F.col("has_reject") | F.col("has_settings")
    order = F.struct(scan_quality().alias("quality"), F.col("has_reject"), controls, -F.coalesce(F.col("frame").cast("long"), F.lit(2**53)))
    pick = F.max_by(F.struct("frame", scan_quality().alias("quality"), *POINTS), F.when(ok, order))
    listed = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("frame"))))
    per = scans.groupBy(key).agg(
        pick.alias("best"), F.count_if(ok).alias("n_ok"), listed(ok).alias("ok_frames"), listed(F.col("timed_out")).alias("timed_out_frames"),
        F.array_sort(F.collect_set("error")).alias("errors"),
    )
    late = F.when(F.size("timed_out_frames") > 0, F.concat(F.lit("timed out in frames "), F.array_join(F.col("timed_out_frames").cast("array<string>"), ", ")))
    why = F.when(F.col("n_ok") == 0, F.concat(F.lit("no frame could be scanned: "), F.array_join(F.array_compact(F.concat("errors", F.array(late))), "; ")))
    return per.select(key, "best.frame", "best.quality", *[F.col("best").getField(c).alias(c) for c in POINTS], "ok_frames", "timed_out_frames", why.alias("error"))


def detect_tcf(banners: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether a site's banner, or else one of its first requests, names the consent framework's interface."""
    from crumbtrail.functions.text import contains_any

    words = [w.lower() for w in P.TCF]
    own = banners.select("domain", contains_any(F.lower(F.concat_ws(" ", "html", "banner_text")), words).alias("own"))
    asked = requests.where("state = 'pre'").where(contains_any(F.lower("url"), words)).select(F.col("site").alias("domain")).distinct().withColumn("asked", F.lit(True))
    return own.join(asked, "domain", "left").select("domain", (F.col("own") | F.coalesce("asked", F.lit(False))).alias("tcf"))


def infer_from_toggles(total: Column, enabled: Column) -> Column:
    """What a saved set of switches amounts to."""
    return F.when(total == 0, "unknown").when(enabled == 0, "reject").when(enabled == total, "accept").otherwise("settings")


#: What may part the characters of an identifier and is left out, the character classes in the order in which
#: they are tried, and the length beyond which one bit is reckoned for each unit.
SEPARATORS = "._-x"
CLASSES = {"01": 2, "0-9": 10, "a-f0-9": 16, "a-z": 26, "a-z0-9": 36, "a-zA-Z0-9/+": 64, "a-zA-Z0-9~%": 64}
MAX_UNITS = 256


def string_bits(s: Column) -> Column:
    """Upper bound of a string's entropy in bits: its length in UTF-16 units times the bits of the first class that all its
    characters, separators aside, belong to; failing that, of the range that its units span. Case counts only in strings of both
    cases. A long string has a bit for each unit. Null for the empty string."""
    units = F.length(F.encode(s, "UTF-16BE")) / 2
    one_case = (F.lower(s) == s) | (F.upper(s) == s)
    t = F.when(one_case, F.lower(s)).otherwise(s)
    code = F.transform(F.split(t, ""), lambda c: F.ascii(c))
    above = lambda c: c > 0xFFFF
    high = F.transform(code, lambda c: F.when(above(c), F.floor((c - 0x10000) / 1024).cast("int") + 0xD800).otherwise(c))
    low = F.transform(code, lambda c: F.when(above(c), (c - 0x10000) % 1024 + 0xDC00).otherwise(c))
    span = F.greatest(F.array_max(high), F.array_max(low)) - F.least(F.array_min(high), F.array_min(low)) + 1
    size = span
    for chars, n in reversed(CLASSES.items()):
        size = F.when(t.rlike(f"^[{chars}._x-]*$"), n).otherwise(size)
    return F.when(units > MAX_UNITS, units).when(s != "", F.log2(size.cast("double")) * units)


def cookie_entropy(values: DataFrame, known: DataFrame, limit: float = 12.0) -> DataFrame:
    """Per request: bits of its values of low entropy, and whether it carries an identifier: any value
    that is not known to be low, or too many bits in all."""
    df = values.join(known, "value", "left").groupBy("event_id").agg(F.coalesce(F.sum("bits"), F.lit(0)).alias("bits"), F.count_if(F.col("bits").isNull()).alias("unknown"))
    return df.select("event_id", "bits", ((F.col("unknown") > 0) | (F.col("bits") > limit)).alias("identifying"))


def relative_to_baseline(runs: DataFrame, baseline: str = "none") -> DataFrame:
    """What is left of the baseline's mean trackers, in percent, with standard errors; failed runs count here."""
    base = runs.where(F.col("pet") == baseline).agg(F.avg("tracker_domains").alias("b"))
    per = runs.groupBy("pet").agg(F.avg("tracker_domains").alias("m"), F.coalesce(F.stddev_samp("tracker_domains"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(base)).select("pet", (100 * F.col("m") / F.col("b")).alias("remaining"), (100 * F.col("sd") / F.sqrt("n") / F.col("b")).alias("error"))


def findings(pets: DataFrame, cmps: DataFrame, combos: DataFrame, budget: DataFrame) -> DataFrame:
    """What follows from the rankings, as rows (place, kind, name, other, value, advice): the best tool and the next one, the best
    platform and the one to be careful with, the best pair of both, and the budget for publication. A row is left out where there is
    nothing to name. pets: pet, request_cut, rank; cmps: cmp, pet_score, rank; combos: pet, cmp, combined; budget: epsilon."""
    last = cmps.agg(F.max_by("cmp", "rank").alias("cmp"), F.max("rank").alias("rank")).join(cmps.select("cmp", "pet_score"), "cmp").where("rank > 1")
    top = combos.orderBy(F.desc("combined"), "pet", "cmp").limit(1)
    none = F.lit(None).cast("string")
    row = lambda df, place, kind, name, other, value, say: df.select(
        F.lit(place).alias("place"), F.lit(kind).alias("kind"), name.alias("name"), other.alias("other"), value.cast("double").alias("value"), say.alias("advice")
    )
    pct = lambda c: F.format_string("%.1f", c)
    parts = [
        row(pets.where("rank = 1"), 1, "best_tool", F.col("pet"), none, F.col("request_cut"), F.concat(F.col("pet"), F.lit(" keeps most requests away: "), pct("request_cut"), F.lit(" % on average."))),
        row(pets.where("rank = 2"), 2, "next_tool", F.col("pet"), none, F.col("request_cut"), F.concat(F.col("pet"), F.lit(" comes next with "), pct("request_cut"), F.lit(" %."))),
        row(cmps.where("rank = 1"), 3, "best_platform", F.col("cmp"), none, F.col("pet_score"), F.concat(F.lit("A refusal works best with "), F.col("cmp"), F.lit(" ("), pct("pet_score"), F.lit(" points)."))),
        row(last, 4, "caution_platform", F.col("cmp"), none, F.col("pet_score"), F.concat(F.lit("A refusal is worth least with "), F.col("cmp"), F.lit(" ("), pct("pet_score"), F.lit(" points)."))),
        row(top, 5, "best_pair", F.col("pet"), F.col("cmp"), F.col("combined"), F.concat(F.col("pet"), F.lit(" on sites with "), F.col("cmp"), F.lit(" does most: "), pct("combined"), F.lit(" % by estimate."))),
        row(budget, 6, "budget", none, none, F.col("epsilon"), F.concat(F.lit("Publish figures with a budget of "), pct("epsilon"), F.lit("."))),
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def state_means(sites: DataFrame, states: DataFrame) -> DataFrame:
    """Mean third parties by category and state; a state without data counts as the one before the choice."""
    df = sites.where("success").join(states.withColumnRenamed("site", "domain"), "domain")
    name = F.coalesce("category", F.lit("Unknown"))
    return df.groupBy(name.alias("category")).agg(F.avg("n_pre").alias("pre"), F.avg(F.coalesce("n_accept", "n_pre")).alias("accept"), F.avg(F.coalesce("n_reject", "n_pre")).alias("reject"))


def renumber(sites: DataFrame) -> DataFrame:
    """Site lists put together: the first entry of a domain counts, and ranks run from one in list order.

    The numbering is a range sort with per-partition offsets, so that no single task holds the list. The sorted table is
    written: its partitions are then the same in both uses.
    """
    first = sites.groupBy("domain").agg(F.min("seq").alias("seq"))
    ranged = stored(first.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("p_", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("p_").agg(F.count("*").alias("c_"))
    before = Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.withColumn("o_", F.coalesce(F.sum("c_").over(before), F.lit(0))).drop("c_")
    inside = Window.partitionBy("p_").orderBy("seq")
    # A row per partition of the sort.
    return ranged.join(F.broadcast(offsets), "p_").select("domain", (F.col("o_") + F.row_number().over(inside)).cast("int").alias("rank"))


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Each value once, with the place where it came first; sort by that."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def top_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; a top-k report."""
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n_") <= n).drop("n_")


def site_snapshot(classified: DataFrame) -> DataFrame:
    """Per site the numbers of cookies, trackers and third-party cookies, the longest life, and maps from category, and from
    vendor of trackers, to numbers."""
    one = classified.groupBy("site").agg(F.count("*").alias("cookies"), F.count_if("is_tracker").alias("trackers"), F.count_if("third_party").alias("third_party"), F.max("age_days").alias("longest"))

    def counts(df: DataFrame, key: str, name: str) -> DataFrame:
        # Counted first: a site has few categories and vendors, however many cookies.
        return df.groupBy("site", key).agg(F.count("*").alias("n")).groupBy("site").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(name))

    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    out = one.join(counts(classified, "category", "categories"), "site").join(counts(classified.where("is_tracker"), "vendor", "vendors"), "site", "left")
    return out.withColumn("vendors", F.coalesce("vendors", empty))


def advice(issues: DataFrame, profiles: DataFrame, top: int = 3) -> DataFrame:
    """For each site the tools that help most with its issues, at most ``top``, with reasons; a top-k report. issues: site,
    issue, points; profiles: tool, issue, ord (place of the issue in the tool's list), weight (of the tool among equals)."""
    from crumbtrail.functions.labels import ISSUES, named, why_helps

    reason = named(F.col("issue"), ISSUES, F.replace("issue", F.lit("_"), F.lit(" ")))
    met = issues.join(profiles, "issue").groupBy("site", "tool").agg(
        F.sum("points").alias("relevance"), F.max("weight").alias("weight"), F.transform(F.sort_array(F.collect_list(F.struct("ord", reason.alias("why")))), lambda r: r["why"]).alias("reasons")
    )
    best = top_per_key(met, "site", [F.desc("relevance"), F.desc("weight"), F.col("tool")], top)
    return best.select("site", "tool", "relevance", why_helps(F.slice(F.array_distinct("reasons"), 1, 3)).alias("why"))
