"""Consent platforms and privacy tools compared; batches merged; captures picked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crumbtrail.functions.text import safe_pct
from crumbtrail.operators import asof

NO_CMP = "No CMP Detected"


def cmp_sites(sites: DataFrame, banners: DataFrame, scores: DataFrame, patterns: DataFrame, states: DataFrame, signals: DataFrame, tcf: DataFrame) -> DataFrame:
    """A row per site with what platforms are compared by; sites without any are a platform of their own."""
    site = lambda df: df.withColumnRenamed("site", "domain")
    return (
        sites.select("domain", "success", F.coalesce("cmp", F.lit(NO_CMP)).alias("cmp"))
        .join(banners.select("domain", "has_reject", "reject_clicks"), "domain", "left")
        .join(scores.select("domain", "overall", "grade"), "domain", "left")
        .join(patterns.select("domain", "n_patterns", "names"), "domain", "left")
        .join(site(states), "domain", "left")
        .join(site(signals), "domain", "left")
        .join(tcf.select("domain", "tcf"), "domain", "left")
    )


def cmp_effectiveness(sites: DataFrame) -> DataFrame:
    """One row per platform, over the rows of cmp_sites()."""
    ok, has = F.col("success"), F.col("success") & F.col("n_reject").isNotNull()
    pre, rej = F.coalesce("n_pre", F.lit(0)), F.col("n_reject")
    cut = F.when(has, F.when(pre > 0, (pre - rej) / pre).otherwise(0.0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    grades = [F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in "ABCDF"]
    out = sites.groupBy("cmp").agg(
        F.count("*").alias("sites"), mean("overall").alias("mean_score"), F.coalesce(F.median("overall"), F.lit(0.0)).alias("median_score"), *grades,
        F.count_if(ok & (pre > 0)).alias("n_tracking"), mean(F.when(ok, F.coalesce("trackers", F.lit(0)))).alias("mean_trackers"), mean(F.when(ok, pre)).alias("mean_domains"),
        F.count_if(ok & F.col("has_reject")).alias("n_reject"), mean(F.when(ok & F.col("has_reject") & (F.col("reject_clicks") < 999), F.col("reject_clicks"))).alias("mean_clicks"),
        F.count_if(has).alias("n_data"), F.count_if(has & (rej < pre)).alias("n_works"), mean(cut).alias("mean_cut"),
        F.count_if(has & (rej == 0)).alias("eliminates"), F.count_if(has & (pre > 0) & (rej >= pre)).alias("no_effect"), mean(F.when(has, rej)).alias("mean_after"),
        F.count_if(F.col("n_patterns") > 0).alias("n_dark"), F.count_if("tcf").alias("n_tcf"),
    )
    pct = lambda n, of="sites": safe_pct(F.col(n), F.col(of))
    shares = {"tracking_pct": pct("n_tracking"), "reject_pct": pct("n_reject"), "works_pct": pct("n_works", "n_data"), "dark_pct": pct("n_dark"), "tcf_pct": pct("n_tcf")}
    return out.withColumns(shares).drop("n_tracking", "n_reject", "n_data", "n_works", "n_dark", "n_tcf")


def cmp_patterns(sites: DataFrame) -> DataFrame:
    """Per platform the most common pattern (by name among equals) and all with their numbers."""
    each = sites.select("cmp", F.explode("names").alias("pattern")).groupBy("cmp", "pattern").agg(F.count("*").alias("n"))
    per = each.groupBy("cmp").agg(F.min_by("pattern", F.struct(-F.col("n"), "pattern")).alias("most_common"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("pattern", "n")))).alias("breakdown"))
    return sites.select("cmp").distinct().join(per, "cmp", "left")


def cmp_table(effect: DataFrame, ranking: DataFrame, common: DataFrame) -> DataFrame:
    """The published table of platforms."""
    cols = ["cmp", "sites", "mean_score", "tracking_pct", "reject_pct", "works_pct", "mean_cut", "dark_pct", "tcf_pct", "most_common", "pet_score", "rank"]
    return effect.join(ranking.select("cmp", "pet_score", "rank"), "cmp").join(common.select("cmp", "most_common"), "cmp").select(*cols)


def enough_sites(effect: DataFrame) -> DataFrame:
    """Platforms with at least three sites if there are more than five platforms, else all; none that is no platform."""
    named = effect.where(F.col("cmp") != NO_CMP)
    # One row per platform, so one window over all is small.
    counted = named.withColumn("n_", F.count("*").over(Window.partitionBy(F.lit(0))))
    return counted.where(F.col("sites") >= F.when(F.col("n_") > 5, 3).otherwise(1)).drop("n_")


def sites_by_cmp(sites: DataFrame) -> DataFrame:
    """Sites of each platform in numbered chunks of at most 1000 names, so that no row grows with the corpus."""
    named = sites.select(F.coalesce("cmp", F.lit(NO_CMP)).alias("cmp"), "domain")
    chunk = F.pmod(F.xxhash64("domain"), F.lit(1 << 20))
    n = named.groupBy("cmp").agg(F.count("*").alias("n"))
    dealt = named.join(n, "cmp").withColumn("chunk", F.floor(chunk * F.ceil(F.col("n") / 500) / (1 << 20)).cast("int"))
    return dealt.groupBy("cmp", "chunk").agg(F.sort_array(F.collect_list("domain")).alias("domains"))


def cmp_ranking(effect: DataFrame) -> DataFrame:
    """Platforms by 30 % score, 25 % rejecting works, 20 % it is offered, 15 % no dark patterns, 10 % reduction."""
    score = 0.30 * F.col("mean_score") + 0.25 * F.col("works_pct") + 0.20 * F.col("reject_pct") + 0.15 * F.greatest(F.lit(0.0), 100 - F.col("dark_pct")) + 0.10 * 100 * F.col("mean_cut")
    df = effect.select("cmp", "sites", F.round(score, 6).alias("pet_score"))
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pet_score"), "cmp")))  # one row per platform


def pet_baseline(runs: DataFrame, baseline: str = "none") -> DataFrame:
    """Per tool: means, and the mean per-site reduction of trackers and of requests that get through, in percent."""
    net = F.col("total_requests") - F.col("blocked_requests")
    ok = runs.where("success").withColumn("net", net)
    base = ok.where(F.col("pet") == baseline).select("domain", F.col("tracker_domains").alias("b_trackers"), F.col("net").alias("b_net"))
    df = ok.where(F.col("pet") != baseline).join(base, "domain", "left")
    cut = lambda a, b: F.avg(F.when(F.col(b) > 0, 100.0 * (F.col(b) - F.col(a)) / F.col(b)))
    return df.groupBy("pet").agg(
        F.count("*").alias("sites"), F.avg("tracker_domains").alias("mean_trackers"), F.avg("net").alias("mean_net"),
        cut("tracker_domains", "b_trackers").alias("tracker_cut"), cut("net", "b_net").alias("request_cut"),
    )


def pet_ranking(stats: DataFrame) -> DataFrame:
    df = stats.select("pet", F.round("request_cut", 6).alias("request_cut"))
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("request_cut"), "pet")))  # one row per tool


def pet_shared_sites(runs: DataFrame, baseline: str = "none") -> DataFrame:
    """Reduction of means over the sites where both the tool and the baseline worked."""
    ok = runs.where("success")
    base = ok.where(F.col("pet") == baseline).select("domain", F.col("tracker_domains").alias("b"))
    df = ok.where(F.col("pet") != baseline).join(base, "domain").groupBy("pet").agg(F.count("*").alias("shared"), F.avg("tracker_domains").alias("mean_pet"), F.avg("b").alias("mean_base"))
    return df.withColumn("cut", safe_pct(F.col("mean_base") - F.col("mean_pet"), F.col("mean_base")))


def pet_cmp_combos(pets: DataFrame, cmps: DataFrame, top: int) -> DataFrame:
    """Tools and platforms together, as 1 - (1 - p)(1 - c); both are short rankings."""
    p = F.greatest(F.coalesce(F.col("request_cut"), F.lit(0.0)), F.lit(0.0)) / 100
    df = pets.crossJoin(F.broadcast(cmps)).select("pet", "cmp", F.round(100 * (1 - (1 - p) * (1 - F.col("pet_score") / 100)), 6).alias("combined"))
    return df.orderBy(F.desc("combined"), "pet", "cmp").limit(top)


def merge_batches(batches: DataFrame, keys: list[str], source_mode: str) -> DataFrame:
    """The last row of each key over all batches, restamped."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"), F.desc("seq"))
    return batches.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_").withColumn("source_mode", F.lit(source_mode))


def single_value(df: DataFrame, col: str) -> DataFrame:
    """The one value of a column, or null if there are several."""
    return df.agg(F.when(F.count_distinct(col) == 1, F.max(col)).alias(col))


def provenance_gate(inputs: list[DataFrame], mode: str) -> DataFrame:
    """Whether all inputs carry one source mode, the one asked for."""
    modes = inputs[0].select("source_mode")
    for other in inputs[1:]:
        modes = modes.unionByName(other.select("source_mode"))
    out = modes.agg(F.count_distinct("source_mode").alias("modes"), F.count_if(F.col("source_mode").isNull()).alias("missing"), F.max("source_mode").alias("mode"))
    return out.select("modes", "missing", F.coalesce((F.col("modes") == 1) & (F.col("missing") == 0) & (F.lower(F.trim("mode")) == mode), F.lit(False)).alias("ok"))


def richest_capture(captures: DataFrame, keys: list[str]) -> DataFrame:
    """The capture with most signals of each key; the latest of equals."""
    worth = 100 * F.col("trackers") + 10 * F.col("third_parties") + F.col("cookies")
    pick = F.max_by(F.struct("event_id", "trackers", "third_parties", "cookies"), F.struct(worth, "ts", "event_id"))
    return captures.groupBy(*keys).agg(pick.alias("c")).select(*keys, "c.*")


_US = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
_BY_TIME = ["ts", "event_id"]


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Runs of a tab's events on one page with no longer pause than the gap; the batch form of the streaming audit."""
    df = asof.ordered(events, ["tab"], _BY_TIME)
    df = asof.carried(df, ["tab"], _BY_TIME, F.struct("ts", "page"), "last")
    new = F.col("last").isNull() | (F.col("ts") - F.col("last.ts") > F.expr(f"INTERVAL {gap}")) | (F.col("last.page") != F.col("page"))
    df = asof.counted(df.withColumn("new", new.cast("int")), ["tab"], _BY_TIME, F.col("new"), "session")
    return df.groupBy("tab", "session").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"), F.count_if(F.col("kind") == "click").alias("clicks"), F.bool_or(F.col("kind") == "banner_seen").alias("armed"))


def baseline_asof(events: DataFrame) -> DataFrame:
    """For each click the last snapshot of its tab and page before it."""
    keys = ["tab", "page"]
    shot = F.when(F.col("kind") == "snapshot", F.struct("event_id", "trackers", "third_parties", "cookies"))
    df = asof.carried(asof.ordered(events.where("kind IN ('click', 'snapshot')"), keys, _BY_TIME), keys, _BY_TIME, shot, "base")
    return df.where("kind = 'click'").select("event_id", "ts", "tab", "page", "label", "trackers", "third_parties", "cookies", "base")


def pending_actions(events: DataFrame, actions: DataFrame, window: float = 2.5) -> DataFrame:
    """Clicks whose action is believed because the banner was gone soon after: the next event of the tab and page, within the
    window, is a snapshot (which only pages without a banner give). Settings and unknown clicks are never pending."""
    keys = ["tab", "page"]
    df = asof.carried(asof.ordered(events, keys, _BY_TIME), keys, _BY_TIME, F.struct("kind", _US("ts").alias("us")), "next", ahead=True)
    clicks = df.where("kind = 'click'").join(actions, "label").where(~F.col("action").isin("settings", "unknown"))
    soon = (F.col("next.kind") == "snapshot") & (F.col("next.us") - _US("ts") <= int(window * 1e6))
    return clicks.select("event_id", "tab", "page", "action", F.coalesce(soon, F.lit(False)).alias("promoted"))


def promotions(events: DataFrame, window: float = 2.5) -> DataFrame:
    """For each hidden page or banner (kind ``hide``) the action that is believed because of it: the choice last confirmed
    (kind ``confirm``) since the one before and within the window, or else the last press (kind ``press``) of a button that
    decides. The batch form of streaming.timed.pending. events: event_id, ts, tab, page, kind, action."""
    keys = ["tab", "page"]
    df = asof.ordered(events, keys, _BY_TIME)
    own = F.struct(_US("ts").alias("us"), F.col("event_id").alias("id"), F.coalesce("action", F.lit("unknown")).alias("action"))
    decides = ~F.coalesce("action", F.lit("unknown")).isin("settings", "unknown")
    for name, what in (("hidden", F.col("kind") == "hide"), ("inferred", F.col("kind") == "confirm"), ("pressed", (F.col("kind") == "press") & decides)):
        df = asof.carried(df, keys, _BY_TIME, F.when(what, own), name)
    since = lambda c: F.col("hidden").isNull() | (F.struct(F.col(f"{c}.us"), F.col(f"{c}.id")) > F.struct("hidden.us", "hidden.id"))
    fresh = lambda c: F.coalesce((_US("ts") - F.col(f"{c}.us") <= int(window * 1e6)) & since(c), F.lit(False))
    pick = lambda f: F.when(fresh("inferred"), f("inferred")).when(fresh("pressed"), f("pressed"))
    names = {"inferred": "confirm", "pressed": "press"}
    return df.where("kind = 'hide'").select(
        "tab", "page", "event_id", pick(lambda c: F.col(f"{c}.id")).alias("source_id"), pick(lambda c: F.lit(names[c])).alias("source"), pick(lambda c: F.col(f"{c}.action")).alias("action")
    )


def armed_outcomes(events: DataFrame, timeout: float = 120.0) -> DataFrame:
    """For each sight of a banner what became of the watch that it armed: the first click of the tab and page within the
    timeout completes it, otherwise it is cleared."""
    keys = ["tab", "page"]
    click = F.when(F.col("kind") == "click", F.struct("event_id", _US("ts").alias("us")))
    df = asof.carried(asof.ordered(events.where("kind IN ('click', 'banner_seen')"), keys, _BY_TIME), keys, _BY_TIME, click, "next", ahead=True)
    hit = F.coalesce(F.col("next.us") - _US("ts") <= int(timeout * 1e6), F.lit(False))
    return df.where("kind = 'banner_seen'").select("event_id", "tab", "page", F.when(hit, F.col("next.event_id")).alias("click"), F.when(hit, "completed").otherwise("cleared").alias("status"))


def captures_after(events: DataFrame, within: float = 3.0, slot: int = 3600) -> DataFrame:
    """The richest snapshot of the tab and page in the seconds after each click. Clicks and snapshots meet within slots of
    time, each click in its own and the next one, so that no tab's whole history meets in one task. within is at most a slot."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    number = F.floor(F.col("us") / (slot * 1_000_000)).cast("bigint")
    clicks = events.where("kind = 'click'").select(F.col("event_id").alias("click"), us("ts").alias("us"), "tab", "page")
    clicks = clicks.withColumn("slot", F.explode(F.array(number, number + 1))).withColumnRenamed("us", "at")
    shots = events.where("kind = 'snapshot'").select("tab", "page", us("ts").alias("us"), "event_id", "trackers", "third_parties", "cookies").withColumn("slot", number)
    worth = 100 * F.col("trackers") + 10 * F.col("third_parties") + F.col("cookies")
    met = clicks.join(shots, ["tab", "page", "slot"]).where((F.col("us") >= F.col("at")) & (F.col("us") <= F.col("at") + int(within * 1_000_000)))
    pick = F.max_by(F.struct("event_id", "trackers", "third_parties", "cookies"), F.struct(worth, "us", "event_id"))
    return met.groupBy("click").agg(pick.alias("c"), F.count("*").alias("captures")).select("click", "captures", "c.*")


STATUSES = {"completed": 4, "observed": 3, "armed": 2, "unknown_current_state": 1}


def best_session(sessions: DataFrame, keys: list[str], last: str) -> DataFrame:
    """The session of each key by status, then an observed action, then the latest, then the lowest frame (null last), then
    a last column that tells all apart."""
    rank = F.lit(0)
    for status, n in STATUSES.items():
        rank = F.when(F.col("status") == status, n).otherwise(rank)
    order = [rank.desc(), F.desc("observed"), F.desc("updated"), F.asc_nulls_last("frame"), F.col(last)]
    return sessions.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def pet_availability(runs: DataFrame, pets: list[str], available: list[str]) -> DataFrame:
    """The runs of the chosen tools that are available, and a failed row, marked SKIPPED, for each site and tool that is not."""
    kept = runs.where(F.col("pet").isin([p for p in pets if p in available])).withColumn("error", F.lit(None).cast("string"))
    gone = [p for p in pets if p not in available]
    sites = runs.select("domain", "category").distinct()
    rows = sites.withColumn("pet", F.explode(F.array(*[F.lit(p) for p in gone]))) if gone else sites.where("false").withColumn("pet", F.lit(""))
    skipped = rows.select("domain", "category", "pet", F.lit(False).alias("success"), F.lit("SKIPPED: tool is not available").alias("error"))
    return kept.unionByName(skipped, allowMissingColumns=True)


def with_category(runs: DataFrame, sites: DataFrame) -> DataFrame:
    """The runs' own categories; where they have none at all, those of the sites. What is still missing is Unknown. Looks for a
    category, in a job of its own, when it is called."""
    if runs.where("category IS NOT NULL").isEmpty():
        lookup = sites.groupBy("domain").agg(F.min("category").alias("category"))
        runs = runs.drop("category").join(lookup, "domain", "left")
    return runs.withColumn("category", F.coalesce("category", F.lit("Unknown")))
