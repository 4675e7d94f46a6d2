"""Queries for reports, lookups and audits, registered beside those of ``queries`` and ``more``."""

from __future__ import annotations

from pyspark.sql import functions as F

from crumbtrail.functions import domains as D
from crumbtrail.functions import labels as L
from crumbtrail.functions import text as X
from crumbtrail.operators import banner as B
from crumbtrail.operators import classify, extras, metrics, scoring, studies
from crumbtrail.plans import oracle as O
from crumbtrail.plans import params as P
from crumbtrail.plans import queries as Q
from crumbtrail.plans.adapters import duck, load
from crumbtrail.plans.queries import query
from crumbtrail.plans.store import new_folder
from crumbtrail.sources import readers, sinks


# Cookies, third parties and lists.
@query(duck("SELECT DISTINCT name || '|' || cookie_domain || '|' || path AS cookie FROM a_cookies"))
def cookie_keys(s, d):
    return load(s, d, "a_cookies").select(D.cookie_key(F.col("name"), F.col("cookie_domain"), F.col("path")).alias("cookie")).distinct()


@query(O.after("signals", "SELECT DISTINCT site, d AS domain FROM o_third WHERE state = 'reject' EXCEPT SELECT site, d FROM o_third WHERE state = 'pre'"))
def new_third_parties(s, d):
    return Q.third_parties(s, d).where("reject AND NOT pre").select("site", "domain")


@query(O.after("signals", "SELECT site, state, count(DISTINCT d) AS third_parties, count(DISTINCT d) FILTER (d IN (SELECT domain FROM tmap) OR d IN (SELECT domain FROM lists) OR d IN (SELECT domain FROM fmap)) AS tracker_domains FROM o_third GROUP BY site, state"))
def tracker_domain_counts(s, d):
    return classify.tracker_domains(Q.third_parties(s, d), classify.all_lists(classify.tracker_map(s), classify.block_lists(s), classify.fallback_map(s)))


@query(O.after("classified", "SELECT DISTINCT registered FROM o_classified WHERE is_tracker"))
def tracker_registered_domains(s, d):
    return Q.classified(s, d).where("is_tracker").select("registered").distinct()


@query(O.after("classified", "SELECT 'category' AS field, category AS value, count(*) AS n FROM o_classified GROUP BY category UNION ALL SELECT 'vendor', vendor, count(*) FROM o_classified GROUP BY vendor UNION ALL SELECT 'source', source, count(*) FROM o_classified GROUP BY source"))
def classification_summary(s, d):
    return metrics.run_summary(Q.classified(s, d), ["category", "vendor", "source"])


@query(duck("SELECT DISTINCT site, min(seq) OVER (PARTITION BY site, name) AS seq, name FROM a_cookies"))
def cookie_names_in_order(s, d):
    """Each site's cookie names once, with the place where they came first."""
    return load(s, d, "a_cookies").groupBy("site", "name").agg(F.min("seq").alias("seq"))


@query(duck("SELECT label, min(event_id) AS event_id FROM a_interactions GROUP BY label"))
def labels_in_order(s, d):
    return extras.ordered_distinct(load(s, d, "a_interactions"), "label", "event_id")


_ODD = "CASE cookies % 7 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'none' WHEN 2 THEN 'null' WHEN 3 THEN '   ' WHEN 4 THEN 'nan' WHEN 5 THEN ' nano' ELSE label END"


@query(duck(f"WITH o AS (SELECT event_id, {_ODD} AS v FROM a_interactions) SELECT event_id, CASE WHEN trim(v) = '' OR trim(lower(v)) = 'nan' THEN NULL ELSE trim(v) END AS label FROM o"))
def null_like_labels(s, d):
    """Blank values and nan of any case are null; the words none and null stay."""
    return load(s, d, "a_interactions").select("event_id", X.null_like(F.expr(_ODD)).alias("label"))


# Banners.
_NORM = O.norm("banner_text")
_LIKE = O.has_any(_NORM, X.folded(P.BANNER_WORDS + P.BANNER_PHRASES))


@query(duck(f"SELECT domain, {_LIKE} AS text_like, template IN (1, 4, 7, 10) AS attrs_like FROM a_banners WHERE found"))
def banner_like(s, d):
    """Whether texts and attributes of banners look like consent."""
    first = F.get(B.elements(F.col("html")), F.lit(0))["attrs"]
    df = load(s, d, "a_banners").where("found").withColumn("attrs", F.concat_ws(" ", F.element_at(first, "id"), F.element_at(first, "class")))
    text, attrs = B.banner_like(F.col("banner_text"), F.col("attrs"))
    return df.select("domain", text.alias("text_like"), attrs.alias("attrs_like"))


_FEATURES = """feat AS (SELECT b.domain, c.c AS candidate, CASE c.c WHEN 0 THEN banner_text ELSE concat(banner_text, ' more') END AS text, CASE c.c WHEN 0 THEN 'cookie-banner' ELSE 'footer' END AS attrs,
    CASE WHEN (site_id + c.c) % 5 = 0 THEN 2 ELSE 0 END AS n_hints, CASE WHEN has_accept THEN 1 ELSE 0 END AS accepts, CASE WHEN has_reject AND c.c = 0 THEN 1 ELSE 0 END AS rejects, CASE WHEN reject_clicks = 2 THEN 1 ELSE 0 END AS settings,
    CASE WHEN has_accept THEN 1 ELSE 0 END + CASE WHEN has_reject AND c.c = 0 THEN 1 ELSE 0 END AS actions, (site_id + c.c) % 3 = 0 AS fixed, (site_id + c.c) % 4 = 1 AS dialog, (site_id + c.c) % 6 = 2 AS edge, (site_id + c.c) % 7 = 3 AS full_screen,
    (site_id + c.c) % 8 = 4 AS nested, CAST(((site_id * 7 + c.c * 13) % 101) AS double) / 100 AS area_ratio, c.c = 1 AS privacy_link
  FROM a_banners b CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) c WHERE b.found)"""
_T = O.norm("text")
_TEXT_LIKE, _TEXT_WORDS, _ATTRS_LIKE = O.has_any(_T, X.folded(P.BANNER_WORDS + P.BANNER_PHRASES)), O.has_any(_T, X.folded(P.BANNER_WORDS)), O.has_any("attrs", X.folded(P.BANNER_HINTS))
_I = lambda cond, n: f"(CASE WHEN {cond} THEN {n} ELSE 0 END)"
_EVIDENCE = " + ".join(
    [
        _I(_TEXT_LIKE, 5), _I(_TEXT_WORDS, 3), _I(_ATTRS_LIKE, 3), "(CASE WHEN n_hints > 0 THEN least(5, n_hints + 1) ELSE 0 END)", _I("accepts > 0", 7), _I("rejects > 0", 7), _I("settings > 0", 4), _I("actions >= 2", 2),
        _I("fixed", 4), _I("dialog", 3), _I("area_ratio BETWEEN 0.03 AND 0.95", 2), _I("area_ratio > 0.95", -4), _I("edge", 2), _I("full_screen AND actions > 0", -2), _I("nested", -6), _I("dialog AND area_ratio <= 0.8 AND actions > 0", 2),
        _I("NOT fixed AND NOT dialog AND NOT edge AND actions > 0", -6), _I("area_ratio < 0.02 AND actions > 0", -4), _I(f"NOT {_TEXT_LIKE} AND NOT {_TEXT_WORDS} AND NOT {_ATTRS_LIKE} AND n_hints = 0 AND actions > 0", -3),
        _I("length(text) > 80", 1), _I("length(text) > 4000", -3), _I("privacy_link", 1),
    ]
)


@query(duck(f"""WITH {_FEATURES.replace('AS double', 'AS DOUBLE')}, sc AS (SELECT *, {_EVIDENCE} AS score FROM feat)
  SELECT domain, candidate, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, nested, actions DESC, dialog DESC, n_hints DESC, full_screen, candidate) AS r FROM sc) WHERE r = 1"""))
def banner_candidate_score(s, d):
    """Three candidates for each site's banner, scored by their evidence."""
    load(s, d, "a_banners").createOrReplaceTempView("a_banners")
    feat = s.sql(f"WITH {_FEATURES} SELECT * FROM feat")
    return B.best_candidate(feat, "domain", "candidate").select("domain", "candidate", "score")


@query(O.after("patterns", f"""WITH u AS (SELECT domain, x.p AS pattern FROM o_patterns, LATERAL (VALUES {Q._NAMES}) AS x(p, f) WHERE f), i AS ({P.values(L.PATTERN_INFO, 'pattern, severity, article, description')})
  SELECT domain, u.pattern, severity, article, description FROM u JOIN i ON i.pattern = u.pattern"""))
def pattern_explanations(s, d):
    """Each site's patterns with severity, articles and description."""
    info = s.createDataFrame(L.PATTERN_INFO, "pattern string, severity string, article string, description string")
    return Q.patterns(s, d).select("domain", F.explode("names").alias("pattern")).join(info, "pattern").select("domain", "pattern", "severity", "article", "description")


@query(O.after("patterns", "SELECT count(*) AS sites, count(*) FILTER (n_patterns > 0) AS any_pattern, round(avg(n_patterns), 6) AS mean_patterns, round(100.0::DOUBLE * count(*) FILTER (n_patterns > 0) / count(*), 6) AS pct FROM o_patterns"))
def pattern_totals(s, d):
    return metrics.pattern_totals(Q.patterns(s, d)).withColumns({c: F.round(c, 6) for c in ("mean_patterns", "pct")})


@query(O.after("patterns", f"WITH u AS (SELECT x.p AS pattern, count(*) AS sites FROM o_patterns, LATERAL (VALUES {Q._NAMES}) AS x(p, f) WHERE f GROUP BY x.p) SELECT pattern, sites FROM u ORDER BY sites DESC, pattern LIMIT 5"))
def top_patterns(s, d):
    """The five patterns on most sites; a top-k report."""
    return metrics.pattern_prevalence(Q.patterns(s, d)).orderBy(F.desc("sites"), "pattern").limit(5).select("pattern", "sites")


# Scores.
@query(O.after("scores", "(SELECT 'top' AS \"end\", domain, overall FROM o_scores ORDER BY overall DESC, domain LIMIT 5) UNION ALL (SELECT 'bottom', domain, overall FROM o_scores ORDER BY overall, domain LIMIT 5)"))
def best_and_worst_sites(s, d):
    """The five best and the five worst sites; a top-k report."""
    return metrics.ends(Q.scores(s, d), "domain", "overall", 5)


@query(O.after("scores", "SELECT domain, overall, grade FROM o_scores WHERE domain = 'site1.com'"))
def one_site(s, d):
    """A lookup of one site; the condition reaches the scan."""
    return Q.scores(s, d).where(F.col("domain") == "site1.com").select("domain", "overall", "grade")


@query(O.after("scores", f"""WITH {Q._SITES}, c AS (SELECT category, round(avg(overall), 6) AS mean FROM o_rep WHERE category IS NOT NULL GROUP BY category) SELECT category, mean, CAST(row_number() OVER (ORDER BY mean DESC, category) AS INT) AS place FROM c"""))
def category_order(s, d):
    """Categories by mean score."""
    from pyspark.sql import Window

    out = Q.report_sites(s, d).where("category IS NOT NULL").groupBy("category").agg(F.round(F.avg("overall"), 6).alias("mean"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "category")))  # one row per category


_PLATFORMS = ["OneTrust", "Cookiebot", "Quantcast", "TrustArc", "Didomi", "Usercentrics", "Sourcepoint"]


_WINGS = "CASE WHEN region IN ('ASIA', 'MIDDLE EAST') THEN 'east' ELSE 'west' END"


@query(O.after("scores", f"WITH {Q._SITES} SELECT category, " + ", ".join(f'round(avg(overall) FILTER (cmp = \'{p}\'), 6) AS "{p}"' for p in _PLATFORMS) + " FROM o_rep WHERE category IS NOT NULL GROUP BY category"))
def pivot_few_regions(s, d):
    """Where there are fewer than three regions, here two halves of the world, means go by platform."""
    rows = Q.report_sites(s, d).where("category IS NOT NULL").withColumn("region", F.expr(_WINGS))
    out = metrics.pivot_regions(rows, "category", "region", "cmp", "overall", ["east", "west"], _PLATFORMS)
    return out.withColumns({p: F.round(p, 6) for p in _PLATFORMS})


@query(O.after("classified", "SELECT count(*) AS sites, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, round(coalesce((SELECT count(*) FROM a_cookies JOIN a_sites ON domain = site WHERE success), 0)::DOUBLE / count(*) FILTER (success), 6) AS mean_cookies FROM a_sites"))
def crawl_run_summary(s, d):
    per = load(s, d, "a_cookies").groupBy(F.col("site").alias("domain")).agg(F.count("*").alias("n"))
    df = load(s, d, "a_sites").join(per, "domain", "left")
    return df.agg(F.count("*").alias("sites"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.round(F.avg(F.when(F.col("success"), F.coalesce("n", F.lit(0)))), 6).alias("mean_cookies"))


# Published tables.
_SCORES = """SELECT s.domain, 'real' AS source_mode, 'r1' AS run_id, category, region, site_rank AS rank, overall AS overall_score, grade, c1 AS no_pre_consent_trackers, c2 AS reject_option_available, c3 AS equal_accept_reject_effort,
  c4 AS no_dark_patterns, c5 AS post_reject_compliance, c6 AS transparent_information, cmp AS cmp_detected, n_patterns AS dark_pattern_count, coalesce(third_parties, 0) AS pre_consent_tracker_count, coalesce(k.n, 0) AS total_pre_consent_cookies
  FROM o_scores s JOIN a_sites a ON a.domain = s.domain JOIN o_patterns p ON p.domain = s.domain LEFT JOIN o_signals g ON g.site = s.domain LEFT JOIN (SELECT site, count(*) AS n FROM a_cookies WHERE state = 'pre' GROUP BY site) k ON k.site = s.domain"""


@query(O.after("scores", _SCORES))
def scores_table(s, d):
    """The published table of scores."""
    site = lambda df: df.withColumnRenamed("site", "domain")
    cookies = load(s, d, "a_cookies").where("state = 'pre'").groupBy("site").agg(F.count("*").alias("total_pre_consent_cookies"))
    df = Q.scores(s, d).join(load(s, d, "a_sites").select("domain", "category", "region", F.col("site_rank").alias("rank"), F.col("cmp").alias("cmp_detected")), "domain")
    df = df.join(Q.patterns(s, d).select("domain", F.col("n_patterns").alias("dark_pattern_count")), "domain").join(site(Q.signals(s, d)), "domain", "left").join(site(cookies), "domain", "left")
    names = {"overall": "overall_score", "c1": "no_pre_consent_trackers", "c2": "reject_option_available", "c3": "equal_accept_reject_effort", "c4": "no_dark_patterns", "c5": "post_reject_compliance", "c6": "transparent_information", "third_parties": "pre_consent_tracker_count"}
    df = df.withColumnsRenamed(names).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pre_consent_tracker_count", "total_pre_consent_cookies")})
    return sinks.in_order(sinks.stamp(df, source_mode="real", run_id="r1"), sinks.SCORE_FIELDS)


#: What a measurement of each run holds; a failed one has no figures, a run without a tool no extension.
_RUNS = """SELECT r.domain, r.category, r.pet AS pet_name, CASE WHEN r.pet = 'none' THEN 'baseline' ELSE 'extension' END AS measurement_mode, CASE WHEN r.pet IN ('alpha', 'beta') THEN 'firefox' ELSE 'chromium' END AS browser_name,
    concat('1', CAST(r.site_id % 30 AS string), '.0') AS browser_version, CASE WHEN r.pet <> 'none' THEN concat(r.pet, ' shield') END AS extension_name, CASE WHEN r.pet <> 'none' THEN concat('1.', CAST(r.site_id % 4 AS string)) END AS extension_version,
    CASE WHEN r.pet <> 'none' THEN concat('/ext/', r.pet) END AS extension_path, r.pet <> 'none' AS extension_enabled, b.found AS consent_banner_detected, CASE WHEN r.success THEN 800 + (r.site_id * 37) % 900 + r.total_requests END AS page_load_time_ms,
    CASE WHEN r.success THEN r.total_requests - r.blocked_requests + 3 END AS total_cookies, CASE WHEN r.success THEN r.tracker_domains * 2 END AS tracker_cookies, r.tracker_domains, CASE WHEN r.success THEN r.tracker_domains + r.site_id % 4 END AS total_third_party_domains,
    r.total_requests, r.blocked_requests, CASE WHEN r.success THEN r.blocked_requests - r.blocked_requests % 3 END AS blocked_tracker_requests, r.success, CASE WHEN NOT r.success THEN 'timeout' END AS error
  FROM a_pet_runs r JOIN a_banners b ON b.domain = r.domain"""


@query(duck(f"SELECT 'real' AS source_mode, 'r1' AS run_id, * FROM ({_RUNS}) r"))
def tool_table(s, d):
    """The published table of tool runs, in its fixed order of columns, written as CSV and read back with its types."""
    for t in ("a_pet_runs", "a_banners"):
        load(s, d, t).createOrReplaceTempView(t)
    runs = sinks.in_order(sinks.stamp(s.sql(_RUNS).withColumn("beyond", F.lit(1)), source_mode="real", run_id="r1"), sinks.PET_FIELDS)
    path = new_folder(s, "tools")
    sinks.write_table(runs, path, fmt="csv")
    return readers.read_results(s, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema))


@query(O.after("scores", f"WITH {Q._RANKED} SELECT 'real' AS source_mode, 'r1' AS run_id, e.cmp AS cmp_name, e.sites AS site_count, round(mean_score, 1) AS avg_compliance_score, round(median_score, 1) AS median_compliance_score, round(reject_pct, 1) AS pct_with_reject_button, round(works_pct, 1) AS pct_reject_works, round(mean_cut, 2) AS avg_tracker_reduction, round(dark_pct, 1) AS pct_with_dark_patterns, pet_score, CAST(row_number() OVER (ORDER BY pet_score DESC, e.cmp) AS INT) AS rank FROM o_effect e JOIN o_rank r ON r.cmp = e.cmp"))
def cmp_csv(s, d):
    """The published table of platforms."""
    r = lambda c, name, n: F.round(c, n).alias(name)
    df = Q.effect(s, d).join(studies.cmp_ranking(Q.effect(s, d)).select("cmp", "pet_score", "rank"), "cmp")
    df = df.select(F.col("cmp").alias("cmp_name"), F.col("sites").alias("site_count"), r("mean_score", "avg_compliance_score", 1), r("median_score", "median_compliance_score", 1), r("reject_pct", "pct_with_reject_button", 1), r("works_pct", "pct_reject_works", 1), r("mean_cut", "avg_tracker_reduction", 2), r("dark_pct", "pct_with_dark_patterns", 1), "pet_score", "rank")
    return sinks.in_order(sinks.stamp(df, source_mode="real", run_id="r1"), sinks.CMP_FIELDS)


@query(O.after("classified", "SELECT site, 'real' AS source_mode, 'r1' AS run_id, to_json(list({'seq': seq, 'name': name, 'category': category} ORDER BY seq)) AS rows FROM o_classified GROUP BY site"))
def site_documents(s, d):
    """Documents of each site's cookies in their envelope, written as JSON and read back."""
    docs = sinks.envelope(Q.classified(s, d).select("site", "seq", "name", "category"), "site", "rows", {"source_mode": "real", "run_id": "r1"})
    path = new_folder(s, "documents")
    sinks.write_documents(docs, path)
    read = s.read.schema(docs.schema).json(path)
    return read.select("site", "source_mode", "run_id", F.to_json("rows").cast("string").alias("rows"))


# Platforms.
@query(O.after("scores", f"""WITH {Q._EFFECT}, u AS (SELECT cmp, x.p AS pattern, count(*) AS n FROM o_all, LATERAL (VALUES {Q._NAMES}) AS x(p, f) WHERE f GROUP BY cmp, x.p),
  m AS (SELECT cmp, string_agg(pattern || '=' || n, ',' ORDER BY pattern) AS breakdown, arg_min(pattern, lpad(CAST(1000000000 - n AS VARCHAR), 12, '0') || pattern) AS most_common FROM u GROUP BY cmp) SELECT o_effect.cmp, most_common, breakdown FROM o_effect LEFT JOIN m ON m.cmp = o_effect.cmp"""))
def cmp_patterns(s, d):
    out = studies.cmp_patterns(Q.cmp_sites(s, d))
    return out.withColumn("breakdown", F.array_join(F.transform(F.sort_array(F.map_entries("breakdown")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query(O.after("scores", f"WITH {Q._EFFECT}, n AS (SELECT *, count(*) OVER () AS k FROM o_effect WHERE cmp <> 'No CMP Detected') SELECT cmp, sites, round(100 - dark_pct, 6) AS clean_pct, round(mean_score, 6) AS mean_score, CAST(row_number() OVER (ORDER BY round(mean_score, 6) DESC, cmp) AS INT) AS place FROM n WHERE sites >= CASE WHEN k > 5 THEN 3 ELSE 1 END"))
def cmp_figure(s, d):
    """Platforms with enough sites, with the share of sites without dark patterns, by score."""
    from pyspark.sql import Window

    out = studies.enough_sites(Q.effect(s, d)).select("cmp", "sites", F.round(100 - F.col("dark_pct"), 6).alias("clean_pct"), F.round("mean_score", 6).alias("mean_score"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_score"), "cmp")))  # one row per platform


@query(duck("SELECT coalesce(cmp, 'No CMP Detected') AS cmp, domain FROM a_sites"))
def sites_by_cmp(s, d):
    """Sites of each platform, grouped in chunks, here as rows again."""
    return studies.sites_by_cmp(load(s, d, "a_sites")).select("cmp", F.explode("domains").alias("domain"))


@query(O.after("scores", f"WITH {Q._EFFECT} SELECT a.domain, coalesce(a.cmp, 'none') AS cmp, round(e.mean_score, 6) AS study_score, e.sites AS study_sites FROM a_sites a LEFT JOIN o_effect e ON e.cmp = a.cmp"))
def study_context(s, d):
    """Each site beside what the study says of its platform."""
    stats = Q.effect(s, d).select("cmp", F.round("mean_score", 6).alias("study_score"), F.col("sites").alias("study_sites"))
    return load(s, d, "a_sites").select("domain", "cmp").join(stats, "cmp", "left").select("domain", F.coalesce("cmp", F.lit("none")).alias("cmp"), "study_score", "study_sites")


# Tools.
@query(duck("SELECT domain, category, pet, success, CAST(NULL AS VARCHAR) AS error FROM a_pet_runs WHERE pet IN ('alpha', 'beta', 'gamma') UNION ALL SELECT DISTINCT domain, category, p, false, 'SKIPPED: tool is not available' FROM a_pet_runs, (VALUES ('eta'), ('theta')) t(p)"))
def tool_availability(s, d):
    """Chosen tools: runs of those available, failed rows for those that are not."""
    out = studies.pet_availability(load(s, d, "a_pet_runs"), ["alpha", "beta", "gamma", "eta", "theta"], ["alpha", "beta", "gamma", "delta"])
    return out.select("domain", "category", "pet", "success", "error")


@query(duck("SELECT r.domain, pet, coalesce(s.category, 'Unknown') AS category, CASE pet WHEN 'none' THEN 'Baseline' ELSE pet END AS label FROM a_pet_runs r LEFT JOIN a_sites s ON s.domain = r.domain"))
def tool_categories(s, d):
    """Runs without any category take that of their site; tools by the names that reports show."""
    runs = load(s, d, "a_pet_runs").withColumn("category", F.lit(None).cast("string"))
    out = studies.with_category(runs, load(s, d, "a_sites"))
    name = L.named(F.when(F.col("pet") == "none", "baseline").otherwise(F.col("pet")), L.TOOL_NAMES)
    return out.select("domain", "pet", "category", name.alias("label"))


# Interactions.
@query(duck("""SELECT event_id, CASE WHEN event_id % 5 = 0 AND kind <> 'snapshot' THEN 'unavailable_or_expired' WHEN kind <> 'snapshot' AND label = 'OK' THEN 'waiting_for_action' WHEN event_id % 5 <> 0 AND label = 'Close' THEN 'partial_capture'
  WHEN kind = 'snapshot' AND trackers > 4 THEN 'post_click_result' WHEN kind = 'snapshot' THEN 'no_comparable_baseline' ELSE 'unavailable_or_expired' END AS state FROM a_interactions"""))
def compare_states(s, d):
    """Where each event's comparison of before and after stands."""
    mode = F.when(F.col("kind") == "snapshot", "post_interaction").otherwise("baseline_banner")
    status = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("label") == "OK", "armed").when(F.col("label") == "Close", "observed").otherwise("completed")
    return load(s, d, "a_interactions").select("event_id", scoring.compare_state(mode, status, F.col("trackers") > 4).alias("state"))


@query(duck(f"""WITH {Q._BASE}, dl AS (SELECT event_id, cookies - b.c AS c, third_parties - b.p AS t, trackers - b.t AS k FROM o_base WHERE kind = 'click'),
  w AS (SELECT event_id, c, CASE WHEN c > 0 THEN 'increased cookies by ' || c WHEN c < 0 THEN 'reduced cookies by ' || -c ELSE 'left cookies unchanged' END AS wc, CASE WHEN t > 0 THEN 'increased third-party cookies by ' || t WHEN t < 0 THEN 'reduced third-party cookies by ' || -t ELSE 'left third-party cookies unchanged' END AS wt,
    CASE WHEN k > 0 THEN 'increased trackers by ' || k WHEN k < 0 THEN 'reduced trackers by ' || -k ELSE 'left trackers unchanged' END AS wk FROM dl)
  SELECT event_id, CASE WHEN c IS NULL THEN 'No before/after delta is available yet.' ELSE 'It ' || wc || ', ' || wt || ', ' || wk || '.' END AS summary FROM w"""))
def delta_summaries(s, d):
    """What each click changed against the snapshot before it, in words."""
    df = studies.baseline_asof(load(s, d, "a_interactions"))
    delta = lambda c: F.col(c) - F.col(f"base.{c}")
    return df.select("event_id", L.delta_summary(delta("cookies"), delta("third_parties"), delta("trackers")).alias("summary"))


@query(duck(f"""WITH {Q._ACTED}, n AS (SELECT *, lead(kind) OVER w AS nk, lead(ts) OVER w AS nt FROM a_interactions WINDOW w AS (PARTITION BY tab, page ORDER BY ts, event_id))
  SELECT event_id, tab, page, action, coalesce(nk = 'snapshot' AND nt - ts <= INTERVAL 2500 MILLISECONDS, false) AS promoted FROM n JOIN does ON does.label = n.label WHERE kind = 'click' AND action NOT IN ('settings', 'unknown')"""))
def pending_actions(s, d):
    events = load(s, d, "a_interactions")
    return studies.pending_actions(events, classify.classify_interactions(events, Q._vocabulary(s)))


@query(duck("""WITH e AS (SELECT * FROM a_interactions WHERE kind IN ('click', 'banner_seen')), n AS (SELECT *, first_value(CASE WHEN kind = 'click' THEN {'e': event_id, 't': ts} END IGNORE NULLS) OVER (PARTITION BY tab, page ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS c FROM e)
  SELECT event_id, tab, page, CASE WHEN c.t - ts <= INTERVAL 12 HOURS THEN c.e END AS click, CASE WHEN c.t - ts <= INTERVAL 12 HOURS THEN 'completed' ELSE 'cleared' END AS status FROM n WHERE kind = 'banner_seen'"""))
def armed_outcomes(s, d):
    """What became of each watch; the events here are hours apart, so the timeout is twelve hours."""
    return studies.armed_outcomes(load(s, d, "a_interactions"), timeout=12 * 3600.0)


@query(duck("""WITH c AS (SELECT event_id AS click, ts, tab, page FROM a_interactions WHERE kind = 'click'), s AS (SELECT * FROM a_interactions WHERE kind = 'snapshot'),
  m AS (SELECT click, s.event_id, s.trackers, s.third_parties, s.cookies, row_number() OVER (PARTITION BY click ORDER BY 100 * s.trackers + 10 * s.third_parties + s.cookies DESC, s.ts DESC, s.event_id DESC) AS r, count(*) OVER (PARTITION BY click) AS captures
    FROM c JOIN s ON s.tab = c.tab AND s.page = c.page AND s.ts >= c.ts AND s.ts <= c.ts + INTERVAL 24 HOURS) SELECT click, captures, event_id, trackers, third_parties, cookies FROM m WHERE r = 1"""))
def captures_after_click(s, d):
    """The richest capture after each click, within a day of these events."""
    return studies.captures_after(load(s, d, "a_interactions"), within=86400.0, slot=86400)


@query(duck("""WITH x AS (SELECT tab, event_id, CASE kind WHEN 'click' THEN 'completed' WHEN 'snapshot' THEN 'observed' WHEN 'banner_seen' THEN 'armed' ELSE 'unknown_current_state' END AS status, trackers > 4 AS observed, event_id // 100 AS updated, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS frame FROM a_interactions)
  SELECT tab, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY CASE status WHEN 'completed' THEN 4 WHEN 'observed' THEN 3 WHEN 'armed' THEN 2 ELSE 1 END DESC, observed DESC, updated DESC, frame NULLS LAST, event_id) AS r FROM x) WHERE r = 1"""))
def best_session(s, d):
    status = F.when(F.col("kind") == "click", "completed").when(F.col("kind") == "snapshot", "observed").when(F.col("kind") == "banner_seen", "armed").otherwise("unknown_current_state")
    frame = F.when(F.col("event_id") % 3 != 0, F.col("event_id"))
    rows = load(s, d, "a_interactions").select("tab", "event_id", status.alias("status"), (F.col("trackers") > 4).alias("observed"), F.floor(F.col("event_id") / 100).alias("updated"), frame.alias("frame"))
    return studies.best_session(rows, ["tab"], last="event_id").select("tab", "event_id")


@query(duck("SELECT event_id, CASE WHEN round(CAST(cookies - 50 AS DOUBLE) / 3, 1) > 0 THEN '+' ELSE '' END || printf('%.1f%%', round(CAST(cookies - 50 AS DOUBLE) / 3, 1)) AS label FROM a_interactions"))
def signed_labels(s, d):
    return load(s, d, "a_interactions").select("event_id", L.signed_percent((F.col("cookies") - 50).cast("double") / 3).alias("label"))
