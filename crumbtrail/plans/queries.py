"""All queries of the library over the driver's tables, each with its SQL where that can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbtrail.functions import domains as D
from crumbtrail.functions import labels as L
from crumbtrail.functions import text as X
from crumbtrail.operators import banner as B
from crumbtrail.operators import bloom, classify, metrics, privacy, scoring, studies
from crumbtrail.plans import oracle as O
from crumbtrail.plans import params as P
from crumbtrail.plans.adapters import EXPECTED_BUTTONS, duck, load
from crumbtrail.plans.store import new_folder, once
from crumbtrail.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Steps that several queries start from; each is written at its first use.
def classified(s: SparkSession, d: str) -> DataFrame:
    make = lambda: classify.classify_cookies(load(s, d, "a_cookies"), classify.tracker_map(s), classify.block_lists(s), classify.fallback_map(s))
    return once(s, d, "classified", make)


def signals(s: SparkSession, d: str) -> DataFrame:
    return once(s, d, "signals", lambda: classify.pre_consent_signals(classified(s, d), third_parties(s, d)), by="site")


def third_parties(s: SparkSession, d: str) -> DataFrame:
    return once(s, d, "third_parties", lambda: classify.third_parties(load(s, d, "a_requests")))


def states(s: SparkSession, d: str) -> DataFrame:
    """Third parties of each site in each state, and what is new after rejecting: cookies and third parties."""
    n = F.count_if
    out = third_parties(s, d).groupBy("site").agg(
        n("pre").alias("n_pre"), F.nullif(n("reject"), F.lit(0)).alias("n_reject"), F.nullif(n("accept"), F.lit(0)).alias("n_accept"), n(F.col("reject") & ~F.col("pre")).alias("third")
    )
    new = classify.new_after_interaction(load(s, d, "a_cookies"), "reject").groupBy("site").agg(F.count("*").alias("n"))
    total = F.coalesce("n", F.lit(0)) + F.col("third")
    return once(s, d, "states", lambda: out.join(new, "site", "left").select("site", "n_pre", "n_reject", "n_accept", total.alias("n_new")), by="site")


def patterns(s: SparkSession, d: str) -> DataFrame:
    return once(s, d, "patterns", lambda: B.dark_patterns(load(s, d, "a_banners"), load(s, d, "a_buttons")), by="domain")


def scores(s: SparkSession, d: str) -> DataFrame:
    return once(s, d, "scores", lambda: scoring.site_scores(load(s, d, "a_banners"), signals(s, d), patterns(s, d), states(s, d)), by="domain")


def tcf(s: SparkSession, d: str) -> DataFrame:
    from crumbtrail.operators import extras

    return once(s, d, "tcf", lambda: extras.detect_tcf(load(s, d, "a_banners"), load(s, d, "a_requests")), by="domain")


def report_sites(s: SparkSession, d: str) -> DataFrame:
    """What reports count, a row per crawled site."""

    def make() -> DataFrame:
        df = load(s, d, "a_sites").where("success").select("domain", "category", "region", "cmp").join(load(s, d, "a_banners").select("domain", "found", "has_reject"), "domain")
        df = df.join(scores(s, d).select("domain", "overall", "grade"), "domain").join(patterns(s, d).select("domain", "n_patterns", "names"), "domain")
        n = F.coalesce(F.col("trackers") + F.col("third_parties"), F.lit(0))
        return df.join(signals(s, d).withColumnRenamed("site", "domain"), "domain", "left").withColumn("n_signals", n).drop("trackers", "third_parties")

    return once(s, d, "report_sites", make)


def catalogue(s: SparkSession, d: str) -> DataFrame:
    """The queries to publish under differential privacy: metric, kind, value, n, lo, hi."""
    sites = report_sites(s, d)
    count = lambda df, metric, cond, of=None: df.agg(F.count_if(cond).cast("double").alias("value"), (F.count("*") if of is None else F.count_if(of)).alias("n")).select(F.lit(metric).alias("metric"), F.lit("count").alias("kind"), "value", "n")
    out = count(sites, "pre_consent_tracker_percentage", F.col("n_signals") > 0)
    out = out.unionByName(count(sites, "sites_with_reject_button_percentage", F.col("found") & F.col("has_reject"), F.col("found")))
    out = out.unionByName(count(sites, "sites_with_dark_patterns_percentage", F.col("n_patterns") > 0))
    total = sites.agg(F.count("*").alias("n"))
    few = lambda df, prefix, key: df.crossJoin(F.broadcast(total)).select(F.concat(F.lit(prefix), key, F.lit("_percentage")).alias("metric"), F.lit("count").alias("kind"), F.col("c").cast("double").alias("value"), "n")
    out = out.unionByName(few(metrics.grade_distribution(sites).withColumnRenamed("n", "c"), "grade_", "grade"))
    out = out.unionByName(few(sites.select(F.explode("names").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("c")), "dp_", "pattern"))
    per = sites.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("n_signals") > 0).cast("double").alias("with"), F.avg("overall").alias("mean"))
    name = lambda suffix: F.concat(F.lit("cat_"), "category", F.lit(suffix)).alias("metric")
    out = out.unionByName(per.select(name("_pre_consent_tracker_pct"), F.lit("count").alias("kind"), F.col("with").alias("value"), "n"))
    out = out.withColumns({"lo": F.lit(0.0), "hi": F.lit(100.0)})
    mean = lambda df, m, v, hi: df.select(m, F.lit("mean").alias("kind"), v.alias("value"), "n", F.lit(0.0).alias("lo"), F.lit(hi).alias("hi"))
    both = sites.agg(F.count("*").alias("n"), F.avg("overall").alias("score"), F.avg("n_signals").alias("tracking"))
    out = out.unionByName(mean(both, F.lit("avg_compliance_score").alias("metric"), F.col("score"), 100.0)).unionByName(mean(both, F.lit("avg_pre_consent_trackers").alias("metric"), F.col("tracking"), 50.0))
    # Sums of floats depend on their order; the noise must not.
    return out.unionByName(mean(per, name("_avg_score"), F.col("mean"), 100.0)).withColumn("value", F.round("value", 6))


KEY = privacy.Key(P.TEST_SECRET, "check")


# Functions over domains, URLs and texts.
@query(duck(f"SELECT event_id, {O.reg('host')} AS registered, {O.reg('host')} <> {O.reg('site')} AS third_party FROM a_requests"))
def registered_domain(s, d):
    return load(s, d, "a_requests").select("event_id", D.registered_domain(F.col("host")).alias("registered"), D.is_third_party(F.col("host"), F.col("site")).alias("third_party"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][^:]*://([^/?#:]*)', 1)), '^www\\.', '') AS host,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*)', 1) AS page_key FROM pages""")
def url_host_page_key(s, d):
    return load(s, d, "pages").select("page_id", D.url_host(F.col("url")).alias("host"), D.page_key(F.col("url")).alias("page_key"))


_PARTS = "string_split(host, '.')"


_SUFFIXES = [("com",), ("net",), ("io",), ("org",), ("uk",), ("co.uk",), ("gov.uk",), ("*.city.gov.uk",), ("!maps.city.gov.uk",)]

#: Hosts of requests, and the addresses that documents mention. Their endings meet the rules; the base domain has the labels
#: of the rule that counts and one more, or two without a rule.
_BASE_DOMAINS = f"""rules AS ({P.values(_SUFFIXES, "suffix")}),
  hosts AS (SELECT DISTINCT host FROM a_requests UNION SELECT unnest(regexp_extract_all(text, '[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}')) FROM documents),
  ends AS (SELECT host, len({_PARTS}) AS n, unnest(range(1, len({_PARTS}) + 1)) AS i FROM hosts),
  fits AS (SELECT host, n, CASE WHEN suffix[1] = '!' THEN n - i ELSE n - i + 1 END AS labels, suffix[1] = '!' AS exempt FROM ends JOIN rules
    ON suffix = array_to_string({_PARTS}[i:], '.') OR suffix = '!' || array_to_string({_PARTS}[i:], '.') OR suffix = '*.' || array_to_string({_PARTS}[i + 1:], '.')),
  counts AS (SELECT host, arg_max(labels, (exempt, labels)) AS labels FROM fits GROUP BY host),
  bases AS (SELECT h.host, len({_PARTS.replace("host", "h.host")}) AS n, CASE WHEN regexp_full_match(h.host, '[0-9.]+') THEN 4 ELSE least(coalesce(labels, 1) + 1, len({_PARTS.replace("host", "h.host")})) END AS base FROM hosts h LEFT JOIN counts c ON c.host = h.host)"""


def _chain_sql(last: str) -> str:
    return duck(f"WITH {_BASE_DOMAINS}, steps AS (SELECT host, unnest(range(0, n - {last} + 1)) AS pos FROM bases) SELECT host, CAST(pos AS INT) AS pos, array_to_string({_PARTS}[pos + 1:], '.') AS parent FROM steps")


def _hosts(s, d):
    asked = load(s, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), F.lit(0))).alias("host"))
    return load(s, d, "a_requests").select("host").unionByName(asked).distinct()


@query(_chain_sql("base"))
def explode_subdomains(s, d):
    """Each host with its parents, down to its base domain: never to a public suffix, and an address has no parents."""
    return D.explode_subdomains(_hosts(s, d), s.createDataFrame(_SUFFIXES, "suffix string"))


@query(_chain_sql("1"))
def explode_subdomains_whole(s, d):
    """Each host with its parents, down to its last label."""
    return D.explode_subdomains(_hosts(s, d), s.createDataFrame(_SUFFIXES, "suffix string"), whole=True)


@query(duck(f"""WITH h AS (SELECT DISTINCT host FROM a_requests) SELECT host, CASE WHEN ends_with(host, '.city.gov.uk') THEN 'maps.city.gov.uk'
  WHEN ends_with(host, '.co.uk') OR ends_with(host, '.gov.uk') THEN array_to_string({_PARTS}[-3:], '.') ELSE array_to_string({_PARTS}[-2:], '.') END AS registered FROM h"""))
def registered_by_list(s, d):
    """Registered domains by a list of public suffixes with a star rule and an exception."""
    suffixes = s.createDataFrame(_SUFFIXES, "suffix string")
    return D.registered_by_list(load(s, d, "a_requests").select("host").distinct(), suffixes)


@query(duck("SELECT domain, regexp_matches(domain, '(" + "|".join(x.replace(".", "\\.") for x in P.GOV_SUFFIXES) + ")$') AS gov FROM a_sites"))
def gov_flag(s, d):
    return load(s, d, "a_sites").select("domain", D.is_public_sector(F.col("domain")).alias("gov"))


@query(f"SELECT doc_id, md5({O.norm('text')}) AS h FROM documents")
def normalize_text(s, d):
    return load(s, d, "documents").select("doc_id", F.md5(X.normalize(F.col("text")).cast("binary")).alias("h"))


@query(f"SELECT doc_id, {O.has_any('lower(text)', P.PURPOSES)} AS purpose, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in P.VENDORS) + " AS vendors FROM documents")
def keyword_any(s, d):
    low = F.lower("text")
    return load(s, d, "documents").select("doc_id", X.contains_any(low, P.PURPOSES).alias("purpose"), X.count_hits(low, P.VENDORS).alias("vendors"))


@query(f"SELECT doc_id, round({O.CLARITY.replace('lower(banner_text)', 'text')}, 6) AS clarity FROM documents")
def sentence_clarity(s, d):
    return load(s, d, "documents").select("doc_id", F.round(X.words_per_sentence(F.col("text")), 6).alias("clarity"))


_VOC = f"SELECT action, kind, ord, {O.norm('raw')} AS term FROM ({P.values(P.vocabulary_rows(), 'action, kind, ord, raw')}) v"


def _labels_sql(order: str, where: str = "") -> str:
    return duck(f"""WITH voc AS (SELECT * FROM ({_VOC}) w {where}), l AS (SELECT DISTINCT label, {O.norm('label')} AS t FROM a_interactions),
      m AS (SELECT l.label, action, row_number() OVER (PARTITION BY l.label ORDER BY {order}, action) AS r FROM l JOIN voc ON (kind = 'exact' AND t = term) OR (kind = 'contains' AND contains(t, term)))
      SELECT l.label, coalesce(m.action, 'unknown') AS action FROM l LEFT JOIN m ON m.label = l.label AND m.r = 1""")


def _vocabulary(s):
    """The vocabulary of the session's setting, or the example."""
    path = s.conf.get(P.VOCABULARY_SETTING, None)
    return readers.read_vocabulary(s, path) if path else s.sql(P.values(P.vocabulary_rows(), "action, kind, ord, term"))


@query(_labels_sql("ord, kind = 'contains'"))
def classify_action(s, d):
    return classify.classify_labels(load(s, d, "a_interactions"), _vocabulary(s))


@query(_labels_sql("kind = 'contains', ord", "WHERE action <> 'dismiss'"))
def classify_action_two_pass(s, d):
    return classify.classify_labels(load(s, d, "a_interactions"), _vocabulary(s), two_pass=True)


@query(_labels_sql("kind = 'contains', ord", "WHERE action <> 'dismiss'").replace("FROM a_interactions", "FROM (SELECT label FROM a_interactions UNION ALL SELECT banner_text FROM a_banners UNION ALL SELECT cmp FROM a_sites WHERE cmp IS NOT NULL)"))
def classify_by_file(s, d):
    """Labels, texts and names classified by a vocabulary that is read from a file."""
    path, buckets = new_folder(s, "vocabulary"), {}
    for action, kind, words in P.VOCABULARY:
        buckets.setdefault(action, {})[kind] = words
    s.createDataFrame([(json.dumps(buckets),)], "value string").coalesce(1).write.text(path)
    labels = load(s, d, "a_interactions").select("label").union(load(s, d, "a_banners").select("banner_text")).union(load(s, d, "a_sites").where("cmp IS NOT NULL").select("cmp"))
    return classify.classify_labels(labels, readers.read_vocabulary(s, path), two_pass=True)


#: What the labels of the interactions do, written by hand.
_DOES = [
    ("Accept all", "accept"), ("Reject all", "reject"), ("Manage preferences", "settings"), ("OK", "dismiss"), ("Refuser", "reject"), ("Ablehnen", "reject"), ("Close", "dismiss"),
    ("Only essential cookies", "essential"), ("I agree", "accept"), ("Einstellungen", "settings"), ("Learn more", "unknown"), ("Aceptar todo", "accept"),
    ("Continue without accepting", "reject"), ("Reject Optional Cookies", "reject"), ("Not now", "dismiss"), ("Tylko niezbędne pliki cookie", "essential"),
    ("Nastavení cookies", "settings"), ("Προβολή επιλογών", "settings"), ("Çerez ayarları", "settings"), ("Aċċetta kollox", "accept"), ("Save choices", "confirm"),
    ("Vain välttämättömät evästeet", "essential"), ("  I   ACCEPT ", "accept"), ("", "unknown"),
]
_ACTED = f"does AS ({P.values(_DOES, 'label, action')})"


@query(duck(f"WITH {_ACTED} SELECT label, action FROM does WHERE label IN (SELECT label FROM a_interactions)"))
def classify_interaction(s, d):
    """Actions of labels, with confirmation and essential choices, against a table written by hand."""
    return classify.classify_interactions(load(s, d, "a_interactions"), _vocabulary(s))


# Lists, cookies, requests.
@query(duck("""SELECT DISTINCT lower(regexp_extract(line, '^\\|\\|([A-Za-z0-9._-]+)\\^', 1)) AS domain FROM a_filter_text
  WHERE NOT starts_with(line, '!') AND NOT contains(line, '##') AND regexp_extract(line, '^\\|\\|([A-Za-z0-9._-]+)\\^', 1) <> ''"""))
def adblock_rules(s, d):
    return classify.adblock_domains(load(s, d, "a_filter_text"))


@query(O.after("classified", "SELECT * FROM o_classified"))
def classify_cookies(s, d):
    return classified(s, d)


@query(O.after("classified", "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY site, name, cookie_domain ORDER BY is_tracker DESC, source <> 'unknown' DESC, seq) AS r FROM o_classified) WHERE r = 1"))
def dedup_cookies(s, d):
    return classify.dedup_cookies(classified(s, d))


@query(O.after("signals", "SELECT * FROM o_signals"))
def pre_consent_signals(s, d):
    return signals(s, d)


@query(O.after("signals", "SELECT * FROM o_new"))
def new_after_interaction(s, d):
    return classify.new_after_interaction(load(s, d, "a_cookies"), "reject")


@query(O.after("signals", "SELECT * FROM o_states"))
def state_counts(s, d):
    return states(s, d)


@query(O.after("classified", f"""WITH q AS (SELECT site, {O.reg('host')} AS dom FROM a_requests) SELECT site, count(*) AS total, count(*) FILTER (dom IN (SELECT domain FROM tmap) OR dom IN (SELECT domain FROM lists) OR dom IN (SELECT domain FROM fmap)) AS blocked_broad,
  count(*) FILTER (dom IN (SELECT domain FROM lists WHERE l = 'easyprivacy') OR dom IN (SELECT domain FROM fmap)) AS blocked_narrow,
  count(*) FILTER (NOT (dom IN (SELECT domain FROM tmap) OR dom IN (SELECT domain FROM lists) OR dom IN (SELECT domain FROM fmap))) AS net_broad FROM q GROUP BY site"""))
def blocked_requests(s, d):
    return classify.blocked_requests(load(s, d, "a_requests"), classify.tracker_map(s), classify.block_lists(s), classify.fallback_map(s))


@query(O.after("signals", "SELECT d AS domain, count(DISTINCT site) AS first_parties, count(DISTINCT site) >= 3 AS tracking FROM o_third GROUP BY d"))
def tracker_prevalence(s, d):
    return classify.third_party_prevalence(load(s, d, "a_requests"))


@query(duck(f"""WITH ent AS ({P.values(P.ENTITIES, 'domain, owner')}), q AS (SELECT event_id, {O.reg('host')} AS d1, {O.reg('site')} AS d2 FROM a_requests)
  SELECT event_id, d1 AS domain, d1 = d2 OR coalesce(a.owner = b.owner, false) AS same_party FROM q LEFT JOIN ent a ON a.domain = d1 LEFT JOIN ent b ON b.domain = d2"""))
def entity_third_party(s, d):
    return classify.same_entity(load(s, d, "a_requests"), s.sql(P.values(P.ENTITIES, "domain, owner")))


#: domain, score, whether it counts for that domain alone.
_ACTIONS = [("doubleclick.net", 3, 0), ("g.doubleclick.net", 1, 0), ("facebook.net", 2, 0), ("static.criteo.com", 1, 0), ("co.uk", 5, 0), ("com", 5, 0), ("newsroom.co.uk", 2, 0), ("stats.newsroom.co.uk", 4, 1), ("shopfront.com", 4, 1)]


@query(duck(f"""WITH {_BASE_DOMAINS}, act AS ({P.values(_ACTIONS, 'domain, score, own')}) SELECT b.host, coalesce(max(score), 0) AS score
  FROM bases b LEFT JOIN act ON host = domain OR (own = 0 AND ends_with(host, '.' || domain) AND len(string_split(domain, '.')) >= base) GROUP BY b.host"""))
def best_action(s, d):
    """The strongest action on each host's chain; what is said of a public suffix does not count."""
    actions = s.sql(P.values(_ACTIONS, "domain, score, own")).withColumn("own", F.col("own") == 1)
    return classify.strongest_action(_hosts(s, d), actions, s.createDataFrame(_SUFFIXES, "suffix string"))


# Banners and dark patterns.
_TAGS = """regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9-]*(?:[^>"'']|"[^"]*"|''[^'']*'')*>')"""
_PAIRS = r"""regexp_extract_all(raw, '[^\s=>"''/]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''=<>`]+)')"""


@query(f"""WITH t AS (SELECT page_id, unnest({_TAGS}) AS raw, generate_subscripts({_TAGS}, 1) - 1 AS pos FROM pages),
  p AS (SELECT page_id, pos, raw, list_transform({_PAIRS}, lambda x: {{'k': lower(trim(split_part(x, '=', 1))), 'v': trim(x[strpos(x, '=') + 1:])}}) AS kv FROM t)
  SELECT page_id, CAST(pos AS INT) AS pos, lower(regexp_extract(raw, '<([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag, len(list_distinct(list_transform(kv, lambda x: x.k))) AS n_attrs,
    regexp_replace(list_filter(kv, lambda x: x.k = 'id')[1].v, '^["'']|["'']$', '', 'g') AS id, regexp_replace(list_filter(kv, lambda x: x.k = 'class')[1].v, '^["'']|["'']$', '', 'g') AS class,
    regexp_replace(list_filter(kv, lambda x: x.k = 'href')[1].v, '^["'']|["'']$', '', 'g') AS href FROM p""")
def html_elements(s, d):
    df = B.html_elements(load(s, d, "pages"), "page_id", "html")
    attr = lambda k: F.element_at("attrs", k).alias(k)
    return df.select("page_id", "pos", "tag", F.size("attrs").cast("long").alias("n_attrs"), attr("id"), attr("class"), attr("href"))


@query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS h FROM pages""")
def visible_text(s, d):
    return load(s, d, "pages").select("page_id", F.md5(B.visible_text(F.col("html")).cast("binary")).alias("h"))


@query(duck("SELECT domain, CASE " + " ".join(f"WHEN {O.has_any('lower(html)', [x.lower() for x in m])} THEN '{n}'" for n, m in P.CMP_SIGNATURES) + " END AS detected FROM a_banners"))
def detect_cmp(s, d):
    return load(s, d, "a_banners").select("domain", B.detect_cmp(F.col("html")).alias("detected"))


@query(duck("SELECT domain, CASE template WHEN 1 THEN 'OneTrust' WHEN 3 THEN 'Cookiebot' WHEN 4 THEN 'Didomi' WHEN 6 THEN 'Usercentrics' WHEN 9 THEN 'TrustArc' END AS detected FROM a_banners"))
def detect_cmp_tokens(s, d):
    """Platforms by ids, classes and data attributes alone."""
    return load(s, d, "a_banners").select("domain", B.detect_cmp_tokens(B.elements(F.col("html"))).alias("detected"))


_BUTTONS_SQL = f"""o_buttons AS (SELECT domain, t.pos, t.tag, t.id, t.label FROM a_banners b JOIN ({P.values(EXPECTED_BUTTONS, 'template, pos, tag, id, label')}) t ON t.template = b.template)"""


@query(duck(f"WITH {_BUTTONS_SQL} SELECT * FROM o_buttons"))
def extract_buttons(s, d):
    return B.extract_buttons(load(s, d, "a_banners")).drop("element")


@query(duck(f"""WITH {_BUTTONS_SQL}, voc AS ({_VOC}), l AS (SELECT DISTINCT label, {O.norm('label')} AS t FROM o_buttons),
  m AS (SELECT l.label, action, row_number() OVER (PARTITION BY l.label ORDER BY ord, kind = 'contains') AS r FROM l JOIN voc ON (kind = 'exact' AND t = term) OR (kind = 'contains' AND contains(t, term))),
  h AS (SELECT domain, coalesce(bool_or(action = 'accept'), false) AS has_accept, coalesce(bool_or(action = 'reject'), false) AS has_reject, coalesce(bool_or(action = 'settings'), false) AS has_settings
    FROM o_buttons b LEFT JOIN m ON m.label = b.label AND r = 1 GROUP BY domain)
  SELECT *, CASE WHEN has_accept THEN 1 WHEN has_settings THEN 2 ELSE 999 END AS accept_clicks, CASE WHEN has_reject THEN 1 WHEN has_settings THEN 2 ELSE 999 END AS reject_clicks FROM h"""))
def banner_summary(s, d):
    b = B.extract_buttons(load(s, d, "a_banners"))
    return B.banner_summary(b, classify.classify_labels(b, _vocabulary(s)))


@query(O.after("d1", "SELECT domain, round(size_ratio, 6) AS size_ratio, round(font_ratio, 6) AS font_ratio, weight_diff, round(contrast, 6) AS contrast, d1 FROM o_d1"))
def d1_asymmetric(s, d):
    df = B.asymmetric(B.pick_buttons(load(s, d, "a_buttons"))).drop("hidden")
    return df.withColumns({c: F.round(c, 6) for c in ("size_ratio", "font_ratio", "contrast")})


@query(O.after("patterns", """SELECT domain, f1 AS d1, f2 AS d2, f3 AS d3, f4 AS d4, f5 AS d5, f6 AS d6, f7 AS d7, n_patterns,
  CASE WHEN accept_clicks > 0 AND accept_clicks < 999 THEN round(reject_clicks::DOUBLE / accept_clicks, 2) END AS click_ratio FROM o_patterns"""))
def dark_pattern_report(s, d):
    return patterns(s, d).drop("names", "boxes", "phrases")


#: Sentences with several double negatives, which a third of the banners get.
_TWICE = "Don''t decline it, DON''T REFUSE it. Nicht  ablehnen! I do not want to not."
_PRESSED = f"""b AS (SELECT domain, template, html || CASE WHEN site_id % 3 = 1 THEN '<p>{_TWICE}</p>' ELSE '' END AS html FROM a_banners WHERE found),
  t AS (SELECT domain, template, lower(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM b),
  terms AS ({P.values(list(enumerate(P.GUILT)), "i, term")}), twice AS ({P.values(list(enumerate(P.DOUBLE_NEGATIVES)), "i, pattern")}),
  vague AS (SELECT * FROM ({P.values(EXPECTED_BUTTONS, "template, pos, tag, id, label")}) x WHERE tag <> 'span' AND tag <> 'input' AND lower(label) IN (SELECT raw FROM ({P.values([(w,) for a, _, words in P.VOCABULARY if a == 'dismiss' for w in words], 'raw')}) v)),
  found_ AS (SELECT domain, 1 AS k, i, 'guilt-trip: ''' || term || '''' AS phrase FROM t JOIN terms ON contains(t, term)
    UNION ALL SELECT domain, 2, i, 'double-negative: ''' || regexp_extract(t, '(?i)' || pattern, 0) || '''' FROM t JOIN twice ON regexp_matches(t, '(?i)' || pattern)
    UNION ALL SELECT domain, 3, pos, 'ambiguous-button: ''' || lower(label) || '''' FROM t JOIN vague USING (template))"""


@query(duck(f"WITH {_PRESSED} SELECT t.domain, coalesce(string_agg(phrase, '; ' ORDER BY k, i), '') AS phrases, count(phrase) AS n FROM t LEFT JOIN found_ f ON f.domain = t.domain GROUP BY t.domain"))
def confusing_language(s, d):
    """Every phrase that presses or confuses, of each kind."""
    df = load(s, d, "a_banners").where("found").withColumn("html", F.concat("html", F.when(F.col("site_id") % 3 == 1, "<p>" + _TWICE.replace("''", "'") + "</p>").otherwise("")))
    phrases = B.suspicious_phrases(F.col("html"), B.elements(F.col("html")))
    return df.select("domain", phrases.alias("p")).select("domain", F.array_join("p", "; ").alias("phrases"), F.size("p").cast("bigint").alias("n"))


# Scores and metrics.
@query(O.after("scores", "SELECT * FROM o_scores"))
def site_scores(s, d):
    return scores(s, d)


@query(duck("""SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success AND found) AS with_banner, count(*) FILTER (success AND NOT found) AS without_banner FROM a_banners"""))
def crawl_summary(s, d):
    return metrics.crawl_summary(load(s, d, "a_banners"))


@query(O.after("signals", """WITH v AS (SELECT coalesce(nullif(category, ''), 'Unknown') AS category, coalesce(trackers + third_parties, 0) AS n FROM a_sites LEFT JOIN o_signals ON site = domain WHERE success)
  SELECT category, grouping(category) = 1 AS overall, count(*) AS sites, count(*) FILTER (n > 0) AS violating, 100.0::DOUBLE * count(*) FILTER (n > 0) / count(*) AS pct, avg(n) AS mean_signals, median(n)::DOUBLE AS median_signals FROM v GROUP BY ROLLUP (category)"""))
def violations_grouping_sets(s, d):
    return metrics.violations(load(s, d, "a_sites"), signals(s, d))


@query(O.after("classified", "SELECT vendor, count(DISTINCT site) AS sites, count(*) AS cookies, 100.0::DOUBLE * count(DISTINCT site) / (SELECT count(*) FROM a_sites WHERE success) AS pct FROM o_classified WHERE is_tracker GROUP BY vendor ORDER BY sites DESC, cookies DESC, vendor LIMIT 15"))
def vendor_prevalence(s, d):
    return metrics.vendor_prevalence(classified(s, d), load(s, d, "a_sites").where("success").agg(F.count("*").alias("n")), 15)


@query(O.after("classified", "WITH v AS (SELECT vendor, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, vendor) AS r FROM o_classified GROUP BY vendor) SELECT CASE WHEN r <= 4 THEN vendor ELSE 'Others' END AS vendor, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY 1"))
def top_vendors_others(s, d):
    return metrics.with_others(classified(s, d).groupBy("vendor").agg(F.count("*").alias("n")), "vendor", "n", 4)


@query(O.after("classified", "SELECT category, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM o_classified WHERE is_tracker GROUP BY category"))
def tracker_category_share(s, d):
    return metrics.share(classified(s, d).where("is_tracker"), "category")


@query(O.after("signals", """WITH p AS (SELECT site, count(DISTINCT d) FILTER (state = 'pre') AS pre, count(DISTINCT d) FILTER (state = 'accept') AS acc, count(DISTINCT d) FILTER (state = 'reject') AS rej FROM o_third GROUP BY site)
  SELECT count(*) AS sites, avg(nullif(pre, 0)) AS mean_pre, avg(nullif(acc, 0)) AS mean_accept, avg(nullif(rej, 0)) AS mean_reject, count(*) FILTER (nullif(rej, 0) < nullif(pre, 0)) AS reduces, count(*) FILTER (rej = 0) AS eliminates FROM p"""))
def before_after(s, d):
    third = D.is_third_party(F.col("host"), F.col("site"))
    return metrics.before_after(load(s, d, "a_requests"), third, D.registered_domain(F.col("host")))


@query(duck("""SELECT count(*) AS banners, count(*) FILTER (has_reject) AS with_reject, avg(accept_clicks) FILTER (accept_clicks < 999) AS mean_accept_clicks, avg(reject_clicks) FILTER (reject_clicks < 999) AS mean_reject_clicks,
  count(*) FILTER (reject_clicks < 999 AND accept_clicks = reject_clicks) AS equal_effort FROM a_banners WHERE success AND found"""))
def banner_analysis(s, d):
    return metrics.banner_analysis(load(s, d, "a_banners"))


_NAMES = ", ".join(f"('{n}', f{i})" for i, n in enumerate(B.PATTERNS, 1))


@query(O.after("patterns", f"""WITH u AS (SELECT x.p AS pattern FROM o_patterns, LATERAL (VALUES {_NAMES}) AS x(p, f) WHERE f)
  SELECT pattern, count(*) AS sites, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM o_patterns) AS pct FROM u GROUP BY pattern"""))
def dp_prevalence(s, d):
    return metrics.pattern_prevalence(patterns(s, d))


_STATS = "count(overall) AS n, round(avg(overall), 6) AS mean, round(median(overall), 6) AS median, round(coalesce(stddev_samp(overall), 0), 6) AS sd, min(overall) AS least, max(overall) AS most"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "median", "sd")})


@query(O.after("scores", f"SELECT {_STATS} FROM o_scores"))
def score_stats(s, d):
    return _rounded(metrics.score_stats(scores(s, d)))


@query(O.after("scores", f"SELECT category, {_STATS} FROM o_scores s JOIN a_sites a ON a.domain = s.domain WHERE category IS NOT NULL GROUP BY category"))
def score_by_category(s, d):
    return _rounded(metrics.score_stats(scores(s, d).join(load(s, d, "a_sites").select("domain", "category"), "domain").where("category IS NOT NULL"), "category"))


@query(O.after("scores", f"WITH g AS ({P.values([(g,) for _, g in P.GRADES], 'grade')}) SELECT g.grade, count(s.grade) AS n FROM g LEFT JOIN o_scores s ON s.grade = g.grade GROUP BY g.grade"))
def grade_distribution(s, d):
    return metrics.grade_distribution(scores(s, d))


@query(O.after("scores", "SELECT CAST(least(floor(overall / 5) + 1, 20) AS INT) AS bin, count(*) AS n FROM o_scores GROUP BY 1"))
def score_histogram(s, d):
    return metrics.histogram(scores(s, d))


@query(O.after("scores", """WITH b AS (SELECT 0.3 * stddev_samp(overall) AS h, count(*) AS n FROM o_scores), g AS (SELECT i, i * 100.0 / 199 AS x FROM range(200) t(i))
  SELECT CAST(i AS INT) AS i, round(sum(exp(-0.5 * pow((x - overall) / h, 2)) / (n * h * sqrt(2 * pi()))), 6) AS density FROM o_scores, b, g GROUP BY i"""))
def score_kde(s, d):
    return metrics.density(scores(s, d)).withColumn("density", F.round("density", 6))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(O.after("scores", "SELECT category, " + ", ".join(f'round(avg(overall) FILTER (region = \'{r}\'), 6) AS "{r}"' for r in _REGIONS) + " FROM o_scores s JOIN a_sites a ON a.domain = s.domain WHERE category IS NOT NULL GROUP BY category"))
def pivot_category_region(s, d):
    df = scores(s, d).join(load(s, d, "a_sites"), "domain").where("category IS NOT NULL")
    out = metrics.pivot_mean(df, "category", "region", "overall", _REGIONS)
    return out.withColumns({r: F.round(r, 6) for r in _REGIONS})


_PETS = ["none", "alpha", "beta", "gamma", "delta", "epsilon", "zeta"]


@query(duck("SELECT category, " + ", ".join(f"round(avg(tracker_domains) FILTER (pet = '{p}'), 6) AS \"{p}\"" for p in _PETS) + " FROM a_pet_runs WHERE success AND category IS NOT NULL GROUP BY category"))
def pivot_pet_category(s, d):
    out = metrics.pivot_mean(load(s, d, "a_pet_runs").where("success AND category IS NOT NULL"), "category", "pet", "tracker_domains", _PETS)
    return out.withColumns({p: F.round(p, 6) for p in _PETS})


@query(duck("SELECT coalesce(cmp, 'Custom/Unknown') AS cmp, count(*) AS n FROM a_sites WHERE success GROUP BY 1"))
def cmp_distribution(s, d):
    return load(s, d, "a_sites").where("success").groupBy(F.coalesce("cmp", F.lit("Custom/Unknown")).alias("cmp")).agg(F.count("*").alias("n"))


# Platforms and tools.
_TCF = """o_tcf AS (SELECT b.domain, contains(lower(html || ' ' || banner_text), '__tcfapi') OR contains(lower(html || ' ' || banner_text), '__cmp') OR contains(lower(html || ' ' || banner_text), 'tcfapi')
  OR b.domain IN (SELECT site FROM a_requests WHERE state = 'pre' AND (contains(lower(url), '__cmp') OR contains(lower(url), 'tcfapi'))) AS tcf FROM a_banners b)"""
_EFFECT = _TCF + """, o_all AS (SELECT coalesce(cmp, 'No CMP Detected') AS cmp, a.success AS ok, a.success AND n_reject IS NOT NULL AS has, overall, grade, b.n_patterns, b.has_reject, b.reject_clicks, coalesce(n_pre, 0) AS n_pre, n_reject, coalesce(g.trackers, 0) AS trackers, tcf,
    f1, f2, f3, f4, f5, f6, f7
  FROM a_sites a LEFT JOIN o_patterns b ON b.domain = a.domain LEFT JOIN o_scores s ON s.domain = a.domain LEFT JOIN o_states t ON t.site = a.domain LEFT JOIN o_signals g ON g.site = a.domain LEFT JOIN o_tcf c ON c.domain = a.domain),
  o_effect AS (SELECT cmp, count(*) AS sites, coalesce(avg(overall), 0) AS mean_score, coalesce(median(overall), 0) AS median_score,
  count(*) FILTER (grade = 'A') AS "grade_A", count(*) FILTER (grade = 'B') AS "grade_B", count(*) FILTER (grade = 'C') AS "grade_C", count(*) FILTER (grade = 'D') AS "grade_D", count(*) FILTER (grade = 'F') AS "grade_F",
  coalesce(avg(trackers) FILTER (ok), 0) AS mean_trackers, coalesce(avg(n_pre) FILTER (ok), 0) AS mean_domains, coalesce(avg(reject_clicks) FILTER (ok AND has_reject AND reject_clicks < 999), 0) AS mean_clicks,
  coalesce(avg(CASE WHEN n_pre > 0 THEN (n_pre - n_reject)::DOUBLE / n_pre ELSE 0 END) FILTER (has), 0) AS mean_cut, count(*) FILTER (has AND n_reject = 0) AS eliminates, count(*) FILTER (has AND n_pre > 0 AND n_reject >= n_pre) AS no_effect,
  coalesce(avg(n_reject) FILTER (has), 0) AS mean_after, 100.0::DOUBLE * count(*) FILTER (ok AND n_pre > 0) / count(*) AS tracking_pct, 100.0::DOUBLE * count(*) FILTER (ok AND has_reject) / count(*) AS reject_pct,
  coalesce(100.0::DOUBLE * count(*) FILTER (has AND n_reject < n_pre) / nullif(count(*) FILTER (has), 0), 0) AS works_pct, 100.0::DOUBLE * count(*) FILTER (n_patterns > 0) / count(*) AS dark_pct, 100.0::DOUBLE * count(*) FILTER (tcf) / count(*) AS tcf_pct FROM o_all GROUP BY cmp)"""
_SCORE = "round(0.30::DOUBLE * mean_score + 0.25::DOUBLE * works_pct + 0.20::DOUBLE * reject_pct + 0.15::DOUBLE * greatest(0, 100 - dark_pct) + 10.0::DOUBLE * mean_cut, 6)"
_RANKED = f"{_EFFECT}, o_rank AS (SELECT cmp, sites, {_SCORE} AS pet_score FROM o_effect)"


def cmp_sites(s, d):
    return once(s, d, "cmp_sites", lambda: studies.cmp_sites(load(s, d, "a_sites"), load(s, d, "a_banners"), scores(s, d), patterns(s, d), states(s, d), signals(s, d), tcf(s, d)))


def effect(s, d):
    return once(s, d, "effect", lambda: studies.cmp_effectiveness(cmp_sites(s, d)))


_MEANS = ["mean_score", "median_score", "mean_trackers", "mean_domains", "mean_clicks", "mean_cut", "mean_after", "tracking_pct", "reject_pct", "works_pct", "dark_pct", "tcf_pct"]
_COUNTS_OF = ["cmp", "sites", "eliminates", "no_effect"] + [f'"grade_{g}"' for g in "ABCDF"]


@query(O.after("scores", f"WITH {_EFFECT} SELECT {', '.join(_COUNTS_OF)}, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MEANS) + " FROM o_effect"))
def cmp_effectiveness(s, d):
    return effect(s, d).withColumns({c: F.round(c, 6) for c in _MEANS})


@query(O.after("scores", f"WITH {_RANKED} SELECT *, CAST(row_number() OVER (ORDER BY pet_score DESC, cmp) AS INT) AS rank FROM o_rank"))
def cmp_ranking(s, d):
    return studies.cmp_ranking(effect(s, d))


_PET = """o_ok AS (SELECT *, total_requests - blocked_requests AS net FROM a_pet_runs WHERE success),
  o_pet AS (SELECT r.pet, count(*) AS sites, avg(r.tracker_domains) AS mean_trackers, avg(r.net) AS mean_net,
    avg(CASE WHEN b.tracker_domains > 0 THEN 100.0::DOUBLE * (b.tracker_domains - r.tracker_domains) / b.tracker_domains END) AS tracker_cut, avg(CASE WHEN b.net > 0 THEN 100.0::DOUBLE * (b.net - r.net) / b.net END) AS request_cut
    FROM o_ok r LEFT JOIN o_ok b ON b.domain = r.domain AND b.pet = 'none' WHERE r.pet <> 'none' GROUP BY r.pet)"""


@query(duck(f"WITH {_PET} SELECT pet, sites, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_trackers", "mean_net", "tracker_cut", "request_cut")) + " FROM o_pet"))
def pet_baseline_join(s, d):
    out = studies.pet_baseline(load(s, d, "a_pet_runs"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_trackers", "mean_net", "tracker_cut", "request_cut")})


@query(duck(f"WITH {_PET} SELECT pet, round(request_cut, 6) AS request_cut, CAST(row_number() OVER (ORDER BY round(request_cut, 6) DESC NULLS LAST, pet) AS INT) AS rank FROM o_pet"))
def pet_ranking(s, d):
    return studies.pet_ranking(studies.pet_baseline(load(s, d, "a_pet_runs")))


@query(duck("""WITH ok AS (SELECT * FROM a_pet_runs WHERE success), j AS (SELECT r.pet, count(*) AS shared, avg(r.tracker_domains) AS p, avg(b.tracker_domains) AS b FROM ok r JOIN ok b ON b.domain = r.domain AND b.pet = 'none' WHERE r.pet <> 'none' GROUP BY r.pet)
  SELECT pet, shared, round(p, 6) AS mean_pet, round(b, 6) AS mean_base, round(100 * (b - p) / b, 6) AS cut FROM j"""))
def pet_shared_sites(s, d):
    return studies.pet_shared_sites(load(s, d, "a_pet_runs")).withColumns({c: F.round(c, 6) for c in ("mean_pet", "mean_base", "cut")})


@query(O.after("scores", f"""WITH {_RANKED}, {_PET} SELECT pet, cmp, round(100 * (1 - (1 - greatest(coalesce(request_cut, 0), 0) / 100) * (1 - pet_score / 100)), 6) AS combined FROM o_pet, o_rank ORDER BY combined DESC, pet, cmp LIMIT 20"""))
def pet_cmp_combos(s, d):
    return studies.pet_cmp_combos(studies.pet_baseline(load(s, d, "a_pet_runs")), studies.cmp_ranking(effect(s, d)), 20)


# Merging, provenance, captures.
def _batches(s, d):
    """All runs in a first batch, those that failed again in a second, those with trackers in a third."""
    runs = load(s, d, "a_pet_runs").select("domain", "pet", "tracker_domains", F.col("site_id").alias("seq"), "success")
    b = lambda k, df: df.drop("success").withColumns({"batch": F.lit(k), "source_mode": F.lit(f"real_{k}")})
    again = runs.where("NOT success").withColumn("tracker_domains", F.col("tracker_domains") + 1)
    return b(0, runs).unionByName(b(1, again)).unionByName(b(2, runs.where("tracker_domains > 0")), allowMissingColumns=True)


@query(duck("""WITH u AS (SELECT domain, pet, tracker_domains, site_id AS seq, 0 AS batch FROM a_pet_runs UNION ALL SELECT domain, pet, tracker_domains + 1, site_id, 1 FROM a_pet_runs WHERE NOT success
    UNION ALL SELECT domain, pet, tracker_domains, site_id, 2 FROM a_pet_runs WHERE tracker_domains > 0)
  SELECT domain, pet, tracker_domains, seq, batch, 'real' AS source_mode FROM (SELECT *, row_number() OVER (PARTITION BY domain, pet ORDER BY batch DESC, seq DESC) AS r FROM u) WHERE r = 1"""))
def merge_batches(s, d):
    return studies.merge_batches(_batches(s, d), ["domain", "pet"], "real")


@query(duck("SELECT CAST(count(DISTINCT m) AS BIGINT) AS modes, count(*) FILTER (m IS NULL) AS missing, count(DISTINCT m) = 1 AS ok FROM (SELECT CASE WHEN site_id % 2 = 0 THEN 'real_0' ELSE 'real_1' END AS m FROM a_pet_runs) x"))
def provenance_gate(s, d):
    runs = load(s, d, "a_pet_runs")
    parts = [runs.where(f"site_id % 2 = {k}").select(F.lit(f"real_{k}").alias("source_mode")) for k in (0, 1)]
    return studies.provenance_gate(parts, "real_0")


@query(duck("SELECT domain FROM a_sites WHERE domain NOT IN (SELECT domain FROM a_sites WHERE site_id % 4 = 0)"))
def skip_existing(s, d):
    sites = load(s, d, "a_sites")
    return sites.select("domain").join(sites.where("site_id % 4 = 0").select("domain"), "domain", "left_anti")


@query(duck("""SELECT tab, page, event_id, trackers, third_parties, cookies FROM (SELECT *, row_number() OVER (PARTITION BY tab, page ORDER BY 100 * trackers + 10 * third_parties + cookies DESC, ts DESC, event_id DESC) AS r FROM a_interactions WHERE kind = 'snapshot') WHERE r = 1"""))
def richest_capture(s, d):
    return studies.richest_capture(load(s, d, "a_interactions").where("kind = 'snapshot'"), ["tab", "page"])


@query(duck("""WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 10 MINUTES OR lag(page) OVER w <> page THEN 1 ELSE 0 END AS new FROM a_interactions WINDOW w AS (PARTITION BY tab ORDER BY ts, event_id)),
    n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY tab ORDER BY ts, event_id) AS BIGINT) AS session FROM m)
  SELECT tab, session, min(event_id) AS first_event, count(*) AS n, count(*) FILTER (kind = 'click') AS clicks, bool_or(kind = 'banner_seen') AS armed FROM n GROUP BY tab, session"""))
def session_batch(s, d):
    return studies.sessions(load(s, d, "a_interactions"))


_BASE = """o_base AS (SELECT event_id, tab, label, trackers, third_parties, cookies, kind, last_value(CASE WHEN kind = 'snapshot' THEN {'e': event_id, 't': trackers, 'p': third_parties, 'c': cookies} END IGNORE NULLS) OVER (PARTITION BY tab, page ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
    FROM a_interactions WHERE kind IN ('click', 'snapshot'))"""


@query(duck(f"WITH {_BASE} SELECT event_id, tab, b.e AS base_event, trackers - b.t AS d_trackers, third_parties - b.p AS d_third, cookies - b.c AS d_cookies FROM o_base WHERE kind = 'click'"))
def baseline_asof(s, d):
    df = studies.baseline_asof(load(s, d, "a_interactions"))
    delta = lambda c: F.col(c) - F.col(f"base.{c}")
    return df.select("event_id", "tab", F.col("base.event_id").alias("base_event"), delta("trackers").alias("d_trackers"), delta("third_parties").alias("d_third"), delta("cookies").alias("d_cookies"))


@query(duck(f"""WITH {_ACTED}, {_BASE.replace("cookies, kind,", "cookies, new_trackers, other_cookies, plain_cookies, kind,")}, v AS (SELECT x.*, action FROM o_base x JOIN does ON does.label = x.label WHERE kind = 'click'),
    h AS (SELECT *, CASE WHEN action = 'accept' THEN 'not_applicable' WHEN action IN ('unknown', 'dismiss') THEN 'unknown' WHEN trackers = 0 AND other_cookies = 0 AND plain_cookies > 0 THEN 'mixed'
      WHEN trackers > 0 OR new_trackers > 0 OR coalesce(third_parties > b.p, false) OR other_cookies > 0 THEN 'dishonest' ELSE 'honest' END AS verdict FROM v)
  SELECT event_id, action, verdict, CASE verdict WHEN 'not_applicable' THEN '{scoring.FINDINGS["not_applicable"]}' WHEN 'unknown' THEN '{scoring.FINDINGS["unknown"]}' WHEN 'honest' THEN '{scoring.FINDINGS["honest"]}' ELSE
      concat_ws('; ', CASE WHEN trackers > 0 THEN '{scoring.FINDINGS["trackers"]}' END, CASE WHEN new_trackers > 0 THEN '{scoring.FINDINGS["new"]}' END, CASE WHEN coalesce(third_parties > b.p, false) THEN '{scoring.FINDINGS["grown"]}' END,
      CASE WHEN other_cookies > 0 AND trackers = 0 THEN '{scoring.FINDINGS["other"]}' END, CASE WHEN verdict = 'mixed' THEN '{scoring.FINDINGS["mixed"]}' END) END AS findings,
    CASE verdict WHEN 'honest' THEN 'Supports banner claim' WHEN 'mixed' THEN 'Partially supports banner claim' WHEN 'dishonest' THEN 'Weakens banner claim' WHEN 'not_applicable' THEN 'Not an honesty-scored action' ELSE 'Could not verify' END AS trust,
    round((0.35 * (CASE WHEN trackers <= 0 THEN 100 WHEN trackers <= 2 THEN 60 WHEN trackers <= 5 THEN 30 WHEN trackers <= 10 THEN 10 ELSE 0 END)
    + 0.2 * (CASE WHEN third_parties <= 0 THEN 100 WHEN third_parties <= 2 THEN 60 WHEN third_parties <= 5 THEN 30 WHEN third_parties <= 10 THEN 10 ELSE 0 END)
    + 0.1 * (CASE WHEN cookies <= 2 THEN 100 WHEN cookies <= 5 THEN 80 WHEN cookies <= 10 THEN 50 WHEN cookies <= 20 THEN 20 ELSE 0 END)
    + coalesce(0.35 * (CASE verdict WHEN 'honest' THEN 100 WHEN 'mixed' THEN 60 WHEN 'dishonest' THEN 0 END), 0))::DOUBLE / (CASE WHEN verdict IN ('honest', 'mixed', 'dishonest') THEN 1.0 ELSE 0.65 END), 6) AS outcome FROM h"""))
def interaction_outcome(s, d):
    events = load(s, d, "a_interactions")
    df = studies.baseline_asof(events).join(events.select("event_id", "new_trackers", "other_cookies", "plain_cookies"), "event_id")
    df = df.join(classify.classify_interactions(df, _vocabulary(s)), "label")
    grown = F.col("third_parties") > F.col("base.third_parties")
    df = df.withColumn("h", scoring.honesty(F.col("action"), F.col("trackers"), F.col("new_trackers"), grown, F.col("other_cookies"), F.col("plain_cookies")))
    out = scoring.state_outcome(F.col("trackers"), F.col("third_parties"), F.col("cookies"), F.col("h.verdict"))
    return df.select("event_id", "action", "h.verdict", F.array_join("h.findings", "; ").alias("findings"), L.trust_label(F.col("h.verdict")).alias("trust"), F.round(out, 6).alias("outcome"))


# Differential privacy. The secret of these queries is public, so that their results can be compared.
_U = lambda k: f"(('0x' || substr(sha256({k}), 1, 13))::BIGINT + 0.5::DOUBLE) / pow(2, 52)"
_SECRET = f"'{P.TEST_SECRET}|check|'"
_SITES = """o_rep AS (SELECT a.domain, category, region, a.cmp, b.found, b.has_reject, s.overall, s.grade, p.n_patterns, f1, f2, f3, f4, f5, f6, f7, coalesce(g.trackers + g.third_parties, 0) AS n_signals
  FROM a_sites a JOIN a_banners b ON b.domain = a.domain JOIN o_scores s ON s.domain = a.domain JOIN o_patterns p ON p.domain = a.domain LEFT JOIN o_signals g ON g.site = a.domain WHERE a.success)"""
_CATALOGUE = f"""{_SITES}, o_queries AS (SELECT metric, kind, round(value, 6) AS value, n, 0.0::DOUBLE AS lo, hi FROM (
  SELECT 'pre_consent_tracker_percentage' AS metric, 'count' AS kind, count(*) FILTER (n_signals > 0)::DOUBLE AS value, count(*) AS n, 100.0::DOUBLE AS hi FROM o_rep
  UNION ALL SELECT 'sites_with_reject_button_percentage', 'count', count(*) FILTER (found AND has_reject), count(*) FILTER (found), 100 FROM o_rep
  UNION ALL SELECT 'sites_with_dark_patterns_percentage', 'count', count(*) FILTER (n_patterns > 0), count(*), 100 FROM o_rep
  UNION ALL SELECT 'grade_' || g.grade || '_percentage', 'count', count(r.grade), (SELECT count(*) FROM o_rep), 100 FROM ({P.values([(g,) for _, g in P.GRADES], 'grade')}) g LEFT JOIN o_rep r ON r.grade = g.grade GROUP BY g.grade
  UNION ALL SELECT 'dp_' || x.p || '_percentage', 'count', count(*), (SELECT count(*) FROM o_rep), 100 FROM o_rep, LATERAL (VALUES {_NAMES}) AS x(p, f) WHERE f GROUP BY x.p
  UNION ALL SELECT 'cat_' || category || '_pre_consent_tracker_pct', 'count', count(*) FILTER (n_signals > 0), count(*), 100 FROM o_rep WHERE category IS NOT NULL GROUP BY category
  UNION ALL SELECT 'avg_compliance_score', 'mean', avg(overall), count(*), 100 FROM o_rep
  UNION ALL SELECT 'avg_pre_consent_trackers', 'mean', avg(n_signals), count(*), 50 FROM o_rep
  UNION ALL SELECT 'cat_' || category || '_avg_score', 'mean', avg(overall), count(*), 100 FROM o_rep WHERE category IS NOT NULL GROUP BY category) q),
  o_eps AS (SELECT CAST(e AS DOUBLE) AS epsilon FROM (VALUES {', '.join(f'({e})' for e in P.EPSILONS)}) t(e))"""
_KEYED = lambda mech, draw: f"{_SECRET} || metric || '|' || CAST(epsilon AS VARCHAR) || '|{mech}|' || {draw}"
_LAP = lambda key: f"value - (CASE kind WHEN 'count' THEN 1.0::DOUBLE ELSE (hi - lo) / greatest(n, 1) END) / epsilon * sign({_U(key)} - 0.5) * ln(1 - 2 * abs({_U(key)} - 0.5))"
_GAUSS = lambda key: f"value + (CASE kind WHEN 'count' THEN 1.0::DOUBLE ELSE (hi - lo) / greatest(n, 1) END) * sqrt(2 * ln(1.25 / 1e-5)) / epsilon * sqrt(-2 * ln({_U(key + chr(32) + '||' + chr(32) + chr(39) + '|a' + chr(39))})) * cos(2 * pi() * {_U(key + chr(32) + '||' + chr(32) + chr(39) + '|b' + chr(39))})"
_OUT = lambda x: f"CASE kind WHEN 'count' THEN coalesce(100.0::DOUBLE * round(greatest(0, least({x}, n::DOUBLE)), 1) / nullif(n, 0), 0) ELSE round(greatest(lo, least({x}, hi)), 2) END"
_TRUTH = "CASE kind WHEN 'count' THEN coalesce(100.0::DOUBLE * value / nullif(n, 0), 0) ELSE value END"


def _release_sql(noise, mech: str) -> str:
    return O.after("scores", f"WITH {_CATALOGUE}, k AS (SELECT *, {_KEYED(mech, chr(39) + '0' + chr(39))} AS key FROM o_queries, o_eps), m AS (SELECT *, {noise('key')} AS x FROM k) SELECT metric, epsilon, round({_TRUTH}, 6) AS truth, round({_OUT('x')}, 4) AS noisy FROM m")


@query(_release_sql(_LAP, "laplace"))
def laplace_release(s, d):
    return privacy.release(catalogue(s, d), KEY).withColumns({"truth": F.round("truth", 6), "noisy": F.round("noisy", 4)})


@query(_release_sql(_GAUSS, "gaussian"))
def gaussian_release(s, d):
    return privacy.release(catalogue(s, d), KEY, "gaussian").withColumns({"truth": F.round("truth", 6), "noisy": F.round("noisy", 4)})


_TRIALS = f"""{_CATALOGUE}, t AS (SELECT metric, epsilon, t, {_TRUTH} AS truth, kind, value, n, lo, hi, {_KEYED("laplace", "t")} AS key FROM o_queries, o_eps, range(1, 101) r(t)),
  w AS (SELECT *, {_LAP('key')} AS y FROM t), v AS (SELECT *, {_OUT('y')} AS x FROM w),
  u AS (SELECT *, row_number() OVER (PARTITION BY metric, epsilon ORDER BY x, t) AS r FROM v),
  o_trials AS (SELECT metric, epsilon, max(truth) AS truth, avg(x) AS mean, stddev_samp(x) AS sd, avg(abs(x - truth)) AS mae, max(x) FILTER (r = 3) AS ci_lo, max(x) FILTER (r = 98) AS ci_hi FROM u GROUP BY metric, epsilon)"""
_RECOMMEND = f"""{_TRIALS}, o_good AS (SELECT epsilon, avg(CASE WHEN truth > 0 THEN mae / truth < 0.05 ELSE truth = 0 AND mae < 1 END::INT) AS p FROM o_trials WHERE metric IN ({', '.join(repr(m) for m in privacy.KEY_METRICS)}) GROUP BY epsilon),
  o_best AS (SELECT coalesce(min(epsilon), 1.0)::DOUBLE AS epsilon FROM o_good WHERE p >= 0.6)"""


def dp_stats(s, d):
    return once(s, d, "dp_trials", lambda: privacy.trials(catalogue(s, d), KEY))


_ROUNDED = ("truth", "mean", "sd", "mae", "ci_lo", "ci_hi")


@query(O.after("scores", f"WITH {_TRIALS} SELECT metric, epsilon, " + ", ".join(f"round({c}, 4) AS {c}" for c in _ROUNDED) + " FROM o_trials"))
def dp_trials(s, d):
    return dp_stats(s, d).withColumns({c: F.round(c, 4) for c in _ROUNDED})


@query(O.after("scores", f"WITH {_RECOMMEND} SELECT epsilon FROM o_best"))
def recommend_epsilon(s, d):
    return privacy.recommend_epsilon(dp_stats(s, d))


@query(O.after("scores", f"WITH {_RECOMMEND} SELECT metric, o_trials.epsilon, round(mean, 2) AS protected FROM o_trials JOIN o_best ON o_best.epsilon = o_trials.epsilon"))
def protected_release(s, d):
    return privacy.protected(dp_stats(s, d), privacy.recommend_epsilon(dp_stats(s, d)))


@query(O.after("scores", f"WITH {_TRIALS} SELECT epsilon, round(avg(mae), 4) AS mean_mae, count(*) AS queries FROM o_trials GROUP BY epsilon"))
def dp_cost(s, d):
    return privacy.cost(dp_stats(s, d)).withColumn("mean_mae", F.round("mean_mae", 4))


@query(O.after("scores", f"WITH {_TRIALS} SELECT metric, " + ", ".join(f"round(max(mae) FILTER (epsilon = {e}), 4) AS e{str(e).replace('.', '_')}" for e in P.EPSILONS) + " FROM o_trials GROUP BY metric"))
def dp_error_matrix(s, d):
    out = privacy.error_matrix(dp_stats(s, d))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c != "metric"})


#: The probability of k of n, and how many of n say yes: the first k whose summed probability reaches the uniform number.
_DRAWN = f"""{_SITES}, e AS (SELECT CAST(x AS DOUBLE) AS epsilon FROM (VALUES {', '.join(f'({e})' for e in P.EPSILONS)}) t(x)),
  c AS (SELECT 'has_pre_consent_trackers' AS attribute, count(*) AS n, count(*) FILTER (n_signals > 0) AS k FROM o_rep UNION ALL SELECT 'has_reject_button', count(*), count(*) FILTER (found AND has_reject) FROM o_rep),
  q AS (SELECT attribute, epsilon, t, n, k, exp(epsilon) / (1 + exp(epsilon)) AS p FROM c, e, range(1, 21) g(t)),
  b AS (SELECT *, 'yes' AS part, k AS m, p AS pp FROM q UNION ALL SELECT *, 'no', n - k, 1 - p FROM q),
  u AS (SELECT *, {_U(f"{_SECRET} || attribute || '|' || part || '|' || CAST(epsilon AS VARCHAR) || '|' || t")} AS u FROM b),
  f AS (SELECT attribute, epsilon, t, part, u, i, sum(CASE WHEN m = 0 THEN 1 ELSE exp(lgamma(m + 1) - (CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END) - (CASE WHEN i = m THEN 0 ELSE lgamma(m - i + 1) END) + i * ln(pp) + (m - i) * ln(1 - pp)) END) OVER (PARTITION BY attribute, epsilon, t, part ORDER BY i) AS cdf
    FROM (SELECT *, unnest(range(0, m + 1)) AS i FROM u)),
  s AS (SELECT attribute, epsilon, t, part, count(*) FILTER (cdf < u) AS said FROM f GROUP BY ALL),
  w AS (SELECT q.attribute, q.epsilon, q.t, any_value(n) AS n, any_value(k) AS k, greatest(0, least(1, (sum(said)::DOUBLE / any_value(n) - (1 - any_value(p))) / (2 * any_value(p) - 1))) AS estimate FROM q JOIN s ON s.attribute = q.attribute AND s.epsilon = q.epsilon AND s.t = q.t GROUP BY q.attribute, q.epsilon, q.t)"""


@query(O.after("scores", f"WITH {_DRAWN} SELECT attribute, epsilon, max(n) AS n, round(max(k::DOUBLE / n), 6) AS truth, round(avg(estimate), 6) AS estimate, round(stddev_samp(estimate), 6) AS spread FROM w GROUP BY attribute, epsilon"))
def randomized_response_counts(s, d):
    """Randomized response of all sites at once: two binomial draws for each attribute, budget and trial."""
    rows = report_sites(s, d).select((F.col("n_signals") > 0).alias("has_pre_consent_trackers"), (F.col("found") & F.col("has_reject")).alias("has_reject_button"))
    out = privacy.counted_trials(rows, ["has_pre_consent_trackers", "has_reject_button"], KEY)
    return out.select("attribute", "epsilon", "n", *[F.round(c, 6).alias(c) for c in ("truth", "estimate", "spread")])


@query(O.after("scores", f"WITH {_TRIALS} SELECT metric, epsilon, round(mae, 4) AS mae, round(greatest(0, mae - 0.3 * sd), 4) AS low, round(mae + 0.3 * sd, 4) AS high, min(CASE WHEN mae < 5 THEN epsilon END) OVER (PARTITION BY metric) AS enough FROM o_trials"))
def dp_trade_off(s, d):
    return privacy.trade_off(dp_stats(s, d)).withColumns({c: F.round(c, 4) for c in ("mae", "low", "high")})


@query(O.after("scores", f"""WITH {_SITES}, e AS (SELECT CAST(x AS DOUBLE) AS epsilon FROM (VALUES {', '.join(f'({e})' for e in P.EPSILONS)}) t(x)),
  a AS (SELECT domain, 'has_pre_consent_trackers' AS attribute, n_signals > 0 AS truth FROM o_rep UNION ALL SELECT domain, 'has_reject_button', found AND has_reject FROM o_rep),
  r AS (SELECT attribute, epsilon, t, truth, CASE WHEN {_U(f"{_SECRET} || attribute || '|' || domain || '|' || CAST(epsilon AS VARCHAR) || '|' || t")} < exp(epsilon) / (1 + exp(epsilon)) THEN truth ELSE NOT truth END AS said FROM a, e, range(1, 21) g(t)),
  p AS (SELECT attribute, epsilon, t, count(*) AS n, count(*) FILTER (truth) AS true_n, greatest(0, least(1, (count(*) FILTER (said)::DOUBLE / count(*) - (1 - exp(epsilon) / (1 + exp(epsilon)))) / (2 * exp(epsilon) / (1 + exp(epsilon)) - 1))) AS estimate FROM r GROUP BY attribute, epsilon, t)
  SELECT attribute, epsilon, max(n) AS n, round(max(true_n::DOUBLE / n), 6) AS truth, round(avg(estimate), 6) AS estimate, round(abs(avg(estimate) - max(true_n::DOUBLE / n)), 6) AS error,
    CASE WHEN epsilon <= 0.1 THEN 'Very high privacy, low utility' WHEN epsilon <= 0.5 THEN 'High privacy, moderate utility' WHEN epsilon <= 1 THEN 'Good privacy-utility balance' WHEN epsilon <= 2 THEN 'Moderate privacy, good utility' ELSE 'Low privacy, high utility' END AS note FROM p GROUP BY attribute, epsilon"""))
def randomized_response(s, d):
    rows = report_sites(s, d).select("domain", (F.col("n_signals") > 0).alias("has_pre_consent_trackers"), (F.col("found") & F.col("has_reject")).alias("has_reject_button"))
    out = privacy.response_trials(rows, "domain", ["has_pre_consent_trackers", "has_reject_button"], KEY)
    return out.withColumns({c: F.round(c, 6) for c in ("truth", "estimate", "error")})


# Bloom index. Hashes of a text by the five seeds, as places in the index.
_PLACES = lambda text, rows: f"SELECT {text} AS t, list_reduce(list_prepend(CAST(xor(2166136261, s) AS BIGINT), list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 2097152 AS p FROM {rows}, range(5) r(s) WHERE {text} <> ''"
_LISTED = f"""dom AS (SELECT DISTINCT lower(regexp_extract(line, '^\\|\\|([A-Za-z0-9._-]+)\\^', 1)) AS d FROM a_filter_text WHERE NOT starts_with(line, '!') AND NOT contains(line, '##')),
    p AS ({_PLACES("d", "dom")})"""


@query(duck(f"WITH {_LISTED} SELECT p // 32 AS word, bit_or(CAST(1 AS BIGINT) << CAST(p % 32 AS INT)) AS bits FROM p GROUP BY 1"))
def bloom_build(s, d):
    return bloom.build(classify.adblock_domains(load(s, d, "a_filter_text")))


@query(duck(f"""WITH dom AS (SELECT DISTINCT lower(regexp_extract(line, '^\\|\\|([A-Za-z0-9._-]+)\\^', 1)) AS d FROM a_filter_text WHERE NOT starts_with(line, '!') AND NOT contains(line, '##'))
  SELECT DISTINCT host AS domain, true AS maybe FROM a_requests WHERE host IN (SELECT d FROM dom)"""))
def bloom_probe(s, d):
    """Hosts of requests that the index may hold and that are on the list: all of the list's, as a filter loses none."""
    listed = classify.adblock_domains(load(s, d, "a_filter_text"))
    found = bloom.probe(load(s, d, "a_requests").select(F.col("host").alias("domain")), bloom.build(listed)).where("maybe")
    return found.join(listed, "domain", "left_semi")


@query(duck(f"WITH {_LISTED}, asked AS (SELECT DISTINCT host FROM a_requests), h AS ({_PLACES('host', 'asked')}) SELECT t AS domain, bool_and(p IN (SELECT p FROM p)) AS maybe FROM h GROUP BY t"))
def bloom_candidates(s, d):
    """Every host of the requests, and whether the index may hold it."""
    index = bloom.build(classify.adblock_domains(load(s, d, "a_filter_text")))
    return bloom.probe(load(s, d, "a_requests").select(F.col("host").alias("domain")), index)
