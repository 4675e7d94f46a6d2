"""Cookie and request classification against list tables, and deduplication.

List tables are small by nature, but their size is the caller's: joins carry no hint, so Spark
broadcasts a list only when it is below its own checked threshold and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crumbtrail.functions import domains as D
from crumbtrail.plans import params as P


def tracker_map(spark: SparkSession) -> DataFrame:
    return spark.sql(P.values(P.TRACKERS, "domain, vendor, category"))


def block_lists(spark: SparkSession) -> DataFrame:
    rows = [("easyprivacy", d) for d in P.EASYPRIVACY] + [("easylist", d) for d in P.EASYLIST]
    return spark.sql(P.values(rows, "list, domain"))


def by_name(name: Column) -> Column:
    """Vendor and category, as v and c, of the first name pattern that matches; null if none does."""
    out = F.lit(None).cast("struct<v: string, c: string>")
    for pattern, v, c in reversed(P.HEURISTICS):
        out = F.when(name.rlike("(?i)" + pattern), F.struct(F.lit(v).alias("v"), F.lit(c).alias("c"))).otherwise(out)
    return out


def fallback_map(spark: SparkSession) -> DataFrame:
    return spark.sql(P.values(P.FALLBACK_TRACKERS, "domain, vendor, category"))


def classify_cookies(cookies: DataFrame, trackers: DataFrame, lists: DataFrame, fallback: DataFrame) -> DataFrame:
    """Adds registered, third_party, age_days, vendor, category, is_tracker and source. In this order the first hit counts:
    tracker map by registered domain, then by host; the two block lists by either; fallback map by registered domain; name
    pattern. What is left of a site's own cookies is functional if its host serves files or it ends with the session."""
    hosts = cookies.withColumn("host", F.ltrim("cookie_domain", F.lit("."))).withColumn("registered", D.registered_domain(F.col("cookie_domain")))
    t = trackers.dropDuplicates(["domain"])
    t1 = t.select(F.col("domain").alias("registered"), F.col("vendor").alias("v1"), F.col("category").alias("k1"))
    t2 = t.select(F.col("domain").alias("host"), F.col("vendor").alias("v2"), F.col("category").alias("k2"))
    best = lists.groupBy("domain").agg(F.max("list").alias("l"))  # easyprivacy before easylist
    l1 = best.select(F.col("domain").alias("registered"), F.col("l").alias("l1"))
    l2 = best.select(F.col("domain").alias("host"), F.col("l").alias("l2"))
    f1 = fallback.dropDuplicates(["domain"]).select(F.col("domain").alias("registered"), F.col("vendor").alias("v3"), F.col("category").alias("k3"))
    df = hosts.join(t1, "registered", "left").join(t2, "host", "left").join(l1, "registered", "left").join(l2, "host", "left").join(f1, "registered", "left")
    listed = F.greatest("l1", "l2")
    # Names are looked at once, into a column of their own, and only where no list has the cookie.
    named = F.when(F.coalesce("v1", "v2", listed, "v3").isNull(), by_name(F.col("name")))
    third = F.col("registered") != D.registered_domain(F.col("site"))
    df = df.withColumns({"third_party": third, "age_days": D.expiration_days(F.col("expires"), F.col("as_of")), "named_": named})
    files = F.lower("cookie_domain").rlike("cdn|static|assets")
    own = ~F.col("third_party") & (files | (F.col("age_days") == 0))
    step = (
        F.when(F.coalesce("v1", "v2").isNotNull(), "disconnect").when(listed.isNotNull(), listed).when(F.col("v3").isNotNull(), "fallback")
        .when(F.col("named_").isNotNull(), "name").when(own, "own").otherwise("unknown")
    )
    df = df.withColumn("step", step)
    at = lambda name: F.col("step") == name
    vendor = F.when(at("disconnect"), F.coalesce("v1", "v2")).when(at("fallback"), F.col("v3")).when(at("name"), F.col("named_.v")).otherwise("Unknown")
    category = (
        F.when(at("disconnect"), F.coalesce("k1", "k2")).when(at("easyprivacy"), "Analytics").when(at("easylist"), "Advertising").when(at("fallback"), F.col("k3"))
        .when(at("name"), F.col("named_.c")).when(at("own"), "Functional").otherwise("Unknown")
    )
    return df.select(
        *cookies.columns,
        "registered",
        "third_party",
        "age_days",
        vendor.alias("vendor"),
        category.alias("category"),
        (~F.col("step").isin("own", "unknown")).alias("is_tracker"),
        F.when(F.col("step").isin("name", "own"), "heuristic").otherwise(F.col("step")).alias("source"),
    )


def dedup_cookies(classified: DataFrame) -> DataFrame:
    """One row per site, name and domain: a tracker if any, else one with a source, else the first seen."""
    order = Window.partitionBy("site", "name", "cookie_domain").orderBy(F.desc("is_tracker"), F.desc(F.col("source") != "unknown"), "seq")
    return classified.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def pre_consent_signals(classified: DataFrame, third: DataFrame) -> DataFrame:
    """Per site: distinct tracker cookies and distinct third-party domains before any choice. third: as from third_parties()."""
    cookies = classified.where("state = 'pre' AND is_tracker").groupBy("site").agg(F.count_distinct("name", "cookie_domain").alias("trackers"))
    asked = third.where("pre").groupBy("site").agg(F.count("domain").alias("third_parties"))
    return cookies.join(asked, "site", "full").select("site", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("trackers", "third_parties")])


def new_after_interaction(cookies: DataFrame, state: str) -> DataFrame:
    """Distinct cookies of a later state, by name, domain and path, that were not there before the choice."""
    keys = ["site", "name", "cookie_domain", "path"]
    before = cookies.where("state = 'pre'").select(keys)
    return cookies.where(F.col("state") == state).select(keys).distinct().join(before, keys, "left_anti")


def third_parties(requests: DataFrame) -> DataFrame:
    """Each site's third-party domains, and in which states they were asked for: site, domain, pre, accept, reject."""
    third = requests.where(D.is_third_party(F.col("host"), F.col("site"))).select("site", D.registered_domain(F.col("host")).alias("domain"), "state")
    return third.groupBy("site", "domain").agg(*[F.bool_or(F.col("state") == s).alias(s) for s in ("pre", "accept", "reject")])


def all_lists(trackers: DataFrame, lists: DataFrame, fallback: DataFrame) -> DataFrame:
    """The distinct domains of the tracker map, both block lists and the fallback map."""
    return trackers.select("domain").union(lists.select("domain")).union(fallback.select("domain")).distinct()


def tracker_domains(third: DataFrame, known: DataFrame) -> DataFrame:
    """Per site and state: third parties, and those on any list. third: as from third_parties()."""
    long = third.select("site", "domain", F.explode(F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in ("pre", "accept", "reject")]))).alias("state"))
    met = long.join(known.withColumn("known", F.lit(1)), "domain", "left")
    return met.groupBy("site", "state").agg(F.count("*").alias("third_parties"), F.count("known").alias("tracker_domains"))


def blocked_requests(requests: DataFrame, trackers: DataFrame, lists: DataFrame, fallback: DataFrame) -> DataFrame:
    """Per site: requests, those that a broad list (all four) and a narrow one (one block list and the fallback map) would
    stop, and what is left."""
    broad = all_lists(trackers, lists, fallback).withColumn("broad", F.lit(1))
    narrow = lists.where("list = 'easyprivacy'").select("domain").union(fallback.select("domain")).distinct().withColumn("narrow", F.lit(1))
    df = requests.withColumn("domain", D.registered_domain(F.col("host"))).join(broad, "domain", "left").join(narrow, "domain", "left")
    out = df.groupBy("site").agg(F.count("*").alias("total"), F.count("broad").alias("blocked_broad"), F.count("narrow").alias("blocked_narrow"))
    return out.withColumn("net_broad", F.col("total") - F.col("blocked_broad"))


def adblock_domains(lines: DataFrame, col: str = "line") -> DataFrame:
    """Distinct lower-cased domains of the blocking rules of a filter list."""
    c = F.trim(F.col(col))
    rule = ~c.startswith("!") & ~F.contains(c, F.lit("##")) & ~F.contains(c, F.lit("#@#"))
    found = lines.where(rule).select(F.lower(F.regexp_extract(c, r"^\|\|([A-Za-z0-9._-]+)\^", 1)).alias("domain"))
    return found.where("domain <> ''").distinct()


def classify_labels(labels: DataFrame, vocabulary: DataFrame, two_pass: bool = False) -> DataFrame:
    """Action of each distinct label: of the vocabulary's terms that it equals or contains, the first by action and kind
    (two_pass: by kind, then action; dismissal only by equality). vocabulary: action, kind, ord, term, any number of rows.

    Exact terms meet labels by key; terms to be contained are tried on each distinct label, broadcast while they are few.
    """
    from crumbtrail.functions.text import normalize

    distinct = labels.select("label").distinct().withColumn("text", normalize(F.col("label")))
    terms = vocabulary.select("action", "kind", "ord", normalize(F.col("term")).alias("term")).where("term <> ''")
    exact = distinct.join(terms.where("kind = 'exact'"), F.col("text") == F.col("term"))
    # A term inside a label: broadcast only while small, and tried on distinct labels alone.
    inner = terms.where("kind = 'contains'")
    if two_pass:
        exact, inner = exact.where("action <> 'dismiss'"), inner.where("action <> 'dismiss'")
    n = inner.count()
    side = F.broadcast(inner) if n <= 10_000 else inner
    hits = exact.unionByName(distinct.join(side, F.contains("text", "term")))
    first = F.when(F.col("kind") == "exact", 0).otherwise(1)
    key = F.struct(first, F.col("ord")) if two_pass else F.struct(F.col("ord"), first)
    best = hits.groupBy("label").agg(F.min_by("action", key).alias("action"))
    return distinct.join(best, "label", "left").select("label", F.coalesce("action", F.lit("unknown")).alias("action"))


def classify_interactions(labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """What a click on a label does: dismiss and confirm by their own lists, then in two passes; a refusal that speaks of
    necessary things is ``essential``."""
    from crumbtrail.functions.text import contains_any, folded, normalize

    two = classify_labels(labels, vocabulary, two_pass=True).withColumn("text", normalize(F.col("label")))
    dismiss = vocabulary.where("action = 'dismiss'").select(normalize(F.col("term")).alias("text"), F.lit(True).alias("dismisses")).distinct()
    action = (
        F.when(F.col("dismisses"), "dismiss").when(F.col("text").isin(folded(P.CONFIRM)), "confirm")
        .when((F.col("action") == "reject") & contains_any(F.col("text"), folded(P.NECESSARY)), "essential").otherwise(F.col("action"))
    )
    return two.join(dismiss, "text", "left").select("label", action.alias("action"))


def third_party_prevalence(requests: DataFrame, at_least: int = 3) -> DataFrame:
    """Distinct first parties of each third-party domain, and whether it counts as a tracker."""
    third = requests.where(D.is_third_party(F.col("host"), F.col("site"))).select(D.registered_domain(F.col("host")).alias("domain"), "site")
    return third.groupBy("domain").agg(F.count_distinct("site").alias("first_parties")).withColumn("tracking", F.col("first_parties") >= at_least)


def same_entity(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """Requests by whether host and site are one party, by domain or by common owner."""
    a = entities.select(F.col("domain").alias("d1"), F.col("owner").alias("o1"))
    b = entities.select(F.col("domain").alias("d2"), F.col("owner").alias("o2"))
    df = requests.select("event_id", D.registered_domain(F.col("host")).alias("d1"), D.registered_domain(F.col("site")).alias("d2"))
    same = (F.col("d1") == F.col("d2")) | F.coalesce(F.col("o1") == F.col("o2"), F.lit(False))
    return df.join(a, "d1", "left").join(b, "d2", "left").select("event_id", F.col("d1").alias("domain"), same.alias("same_party"))


def strongest_action(hosts: DataFrame, actions: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The highest action score on each host's chain of parents, no further than its base domain; 0 if none is known. A score
    with ``own`` set counts for its own domain only."""
    chain = D.explode_subdomains(hosts, suffixes).withColumnRenamed("parent", "domain")
    rules = actions if "own" in actions.columns else actions.withColumn("own", F.lit(False))
    counts = ~F.col("own") | (F.col("pos") == 0)
    return chain.join(rules, "domain", "left").groupBy("host").agg(F.coalesce(F.max(F.when(counts, F.col("score"))), F.lit(0)).alias("score"))
