"""Further queries, registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from crumbtrail.functions import domains as D
from crumbtrail.functions import labels as L
from crumbtrail.functions import text as X
from crumbtrail.operators import banner as B
from crumbtrail.operators import classify, extras, metrics, privacy, scoring, studies
from crumbtrail.plans import oracle as O
from crumbtrail.plans import params as P
from crumbtrail.plans import queries as Q
from crumbtrail.plans.adapters import duck, load
from crumbtrail.plans.queries import query
from crumbtrail.plans.store import new_folder
from crumbtrail.sources import readers, sinks
from crumbtrail.streaming import audit


@query(duck("""SELECT domain, pos, CAST(replace(width, 'px', '') AS DOUBLE) AS width, CASE font_weight WHEN 'bold' THEN 700 WHEN 'normal' THEN 400 ELSE CAST(font_weight AS INT) END AS weight,
  CASE color WHEN '#bbb' THEN 187 WHEN '#333333' THEN 51 ELSE 255 END AS red,
  CASE color WHEN '#bbb' THEN 187 WHEN '#333333' THEN 51 ELSE 255 END AS green, CASE color WHEN '#bbb' THEN 187 WHEN '#333333' THEN 51 ELSE 255 END AS blue, CASE background WHEN '#0055aa' THEN 85 ELSE 255 END AS ground FROM a_buttons"""))
def parse_css(s, d):
    b = load(s, d, "a_buttons")
    return b.select("domain", "pos", X.parse_px(F.col("width")).alias("width"), X.font_weight(F.col("font_weight")).alias("weight"), *[c.alias(n) for n, c in zip(("red", "green", "blue"), X.rgb(F.col("color")))], X.rgb(F.col("background"))[1].alias("ground"))


@query(duck(f"SELECT domain, round(({O._LUM['white']} + 0.05) / ((CASE color WHEN '#bbb' THEN {O._LUM['bbb']} WHEN 'white' THEN {O._LUM['white']} ELSE {O._LUM['333']} END) + 0.05), 6) AS contrast FROM a_buttons WHERE kind = 'reject'"))
def contrast_ratio(s, d):
    return load(s, d, "a_buttons").where("kind = 'reject'").select("domain", F.round(X.contrast(F.col("color"), F.col("background")), 6).alias("contrast"))


@query(duck("SELECT DISTINCT host AS domain FROM (SELECT CASE WHEN host = 'SELF' THEN 'self.example' ELSE host END AS host FROM host_pool UNION ALL SELECT domain FROM a_sites) h"))
def hosts_list(s, d):
    pool = load(s, d, "host_pool").select(F.when(F.col("host") == "SELF", "self.example").otherwise(F.col("host")).alias("h"))
    lines = pool.union(load(s, d, "a_sites").select("domain")).select(F.concat(F.lit("127.0.0.1 "), "h").alias("line"))
    return readers.hosts_domains(lines.union(s.createDataFrame([("# comment",), ("::1 localhost",)], "line string")))


@query(duck(f"""WITH a AS ({P.values(P.TRACKERS, 'domain, vendor, category')}), b AS (SELECT {O.reg('host')} AS domain, min(resource_type) AS vendor FROM a_requests GROUP BY 1)
  SELECT domain, vendor, category, 0 AS priority FROM a UNION ALL SELECT domain, vendor, 'seen', 1 FROM b WHERE domain NOT IN (SELECT domain FROM a)"""))
def tracker_lists_merge(s, d):
    seen = load(s, d, "a_requests").groupBy(D.registered_domain(F.col("host")).alias("domain")).agg(F.min("resource_type").alias("vendor")).withColumn("category", F.lit("seen"))
    return readers.merge_tracker_lists([classify.tracker_map(s), seen])


@query(O.after("signals", """SELECT d AS domain, max_by(state, resource_type || ' ' || state) AS vendor, max_by(resource_type, resource_type || ' ' || state) AS category
  FROM (SELECT resource_type, state, REG AS d FROM a_requests WHERE REG <> SITE) x GROUP BY d""".replace("REG", O.reg("host")).replace("SITE", O.reg("site"))))
def tracker_services(s, d):
    """Services documents made of the request log, each with at most about a thousand domains of a category and company, read back."""
    third = load(s, d, "a_requests").where(D.is_third_party(F.col("host"), F.col("site")))
    pairs = third.select(F.col("resource_type").alias("cat"), F.col("state").alias("company"), D.registered_domain(F.col("host")).alias("dom")).distinct()
    # Documents of a bounded size, however many domains a company has.
    chunks = pairs.groupBy("cat", "company").agg(F.ceil(F.count("*") / 1000).alias("chunks"))
    chunk = F.pmod(F.xxhash64("dom"), F.col("chunks")).alias("chunk")
    companies = pairs.join(chunks, ["cat", "company"]).groupBy("cat", "company", chunk).agg(F.sort_array(F.collect_set("dom")).alias("doms"))
    entry = F.create_map("company", F.create_map(F.concat(F.lit("http://"), "company"), F.col("doms")))
    json = F.to_json(F.struct(F.create_map(F.col("cat"), F.array(entry)).alias("categories")))
    return readers.tracker_services(companies.select(F.concat_ws(" ", "cat", "company").alias("place"), json.alias("json")), order="place")


@query(duck(f"WITH {Q._TCF} SELECT * FROM o_tcf"))
def detect_tcf(s, d):
    return Q.tcf(s, d)


@query(duck("""SELECT site, host, area FROM (SELECT site, host, min(area) AS area, row_number() OVER (PARTITION BY site ORDER BY min(area), host) AS r FROM (SELECT site, host, length(url) * (event_id % 97 + 1) AS area FROM a_requests) x GROUP BY site, host) WHERE r = 1"""))
def banner_candidate_best(s, d):
    c = load(s, d, "a_requests").select("site", "host", (F.char_length("url") * (F.col("event_id") % 97 + 1)).alias("area")).groupBy("site", "host").agg(F.min("area").alias("area"))
    return extras.pick_candidate(c, ["site"], [F.col("area"), F.col("host")])


#: Three frames of each site: parts of the banner lie in one or the other, some fail or time out, a frame may have no number.
_FRAMES = """SELECT b.domain, CASE WHEN f.i = 2 AND b.site_id % 5 = 0 THEN NULL ELSE f.i END AS frame, b.found AND (f.i = 0 OR b.site_id % (f.i + 2) = 0) AS found, b.has_accept AND f.i <> 1 AS has_accept, b.has_reject AND b.site_id % 3 = f.i AS has_reject,
    contains(b.html, 'id="s"') AND f.i < 2 AS has_settings, b.accept_clicks, CASE WHEN b.site_id % 3 = f.i THEN b.reject_clicks ELSE 999 END AS reject_clicks, CASE WHEN f.i = 2 THEN '' ELSE b.banner_text END AS banner_text,
    CASE WHEN b.site_id % 13 = 8 THEN 'blocked' WHEN (b.site_id + f.i) % 4 = 3 THEN 'no access' END AS error, (b.site_id + f.i) % 4 = 3 AND b.site_id % 2 = 1 AS timed_out
  FROM a_banners b CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS t(i)) f"""


@query(duck(f"""WITH f AS ({_FRAMES}), q AS (SELECT *, (CASE WHEN found THEN 2 ELSE 0 END) + (CASE WHEN has_accept THEN 5 ELSE 0 END) + (CASE WHEN has_reject THEN 5 ELSE 0 END) + (CASE WHEN has_settings THEN 3 ELSE 0 END)
    + (CASE WHEN accept_clicks < 999 THEN 1 ELSE 0 END) + (CASE WHEN reject_clicks < 999 THEN 1 ELSE 0 END) + (CASE WHEN banner_text <> '' THEN 1 ELSE 0 END) AS quality FROM f),
  r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY quality DESC, has_reject DESC, has_accept OR has_reject OR has_settings DESC, frame NULLS LAST) AS r FROM q WHERE error IS NULL),
  g AS (SELECT domain, count(*) FILTER (error IS NULL) AS n, coalesce(string_agg(frame, ',' ORDER BY frame) FILTER (error IS NULL), '') AS ok_frames, coalesce(string_agg(frame, ', ' ORDER BY frame) FILTER (timed_out), '') AS late, string_agg(DISTINCT error, '; ' ORDER BY error) AS errors FROM f GROUP BY domain)
  SELECT g.domain, r.frame, CAST(r.quality AS INT) AS quality, r.has_reject, ok_frames, CASE WHEN n = 0 THEN 'no frame could be scanned: ' || errors || CASE WHEN late <> '' THEN '; timed out in frames ' || late ELSE '' END END AS error FROM g LEFT JOIN r ON r.domain = g.domain AND r = 1"""))
def best_frame_scan(s, d):
    """The frame of each site whose scan counts, by the scan's own points."""
    load(s, d, "a_banners").createOrReplaceTempView("a_banners")
    best = extras.best_frames(s.sql(_FRAMES), "domain")
    return best.select("domain", "frame", "quality", "has_reject", F.array_join(F.col("ok_frames").cast("array<string>"), ",").alias("ok_frames"), "error")


@query(duck("""SELECT site, CASE WHEN n = 0 THEN 'unknown' WHEN k = 0 THEN 'reject' WHEN k = n THEN 'accept' ELSE 'settings' END AS action FROM (SELECT site, count(*) FILTER (name IN ('consent', 'theme')) AS n, count(*) FILTER (name = 'consent') AS k FROM a_cookies GROUP BY site) x"""))
def toggle_action(s, d):
    per = load(s, d, "a_cookies").groupBy("site").agg(F.count_if(F.col("name").isin("consent", "theme")).alias("n"), F.count_if(F.col("name") == "consent").alias("k"))
    return per.select("site", extras.infer_from_toggles(F.col("n"), F.col("k")).alias("action"))


_KNOWN = [("_ga", 4), ("_gid", 5), ("lang", 3), ("theme", 1), ("consent", 1), ("cart", 9), ("NID", 8), ("IDE", 8)]


@query(duck(f"""WITH known AS ({P.values(_KNOWN, 'v, b')}), u AS (SELECT seq AS event_id, name AS v FROM a_cookies UNION ALL SELECT seq, CASE WHEN seq % 4 = 0 THEN 'lang' ELSE 'cart' END FROM a_cookies)
  SELECT event_id, CAST(coalesce(sum(b), 0) AS BIGINT) AS bits, count(*) FILTER (b IS NULL) > 0 OR coalesce(sum(b), 0) > 12 AS identifying FROM u LEFT JOIN known USING (v) GROUP BY event_id"""))
def cookie_entropy(s, d):
    c = load(s, d, "a_cookies")
    values = c.select(F.col("seq").alias("event_id"), F.col("name").alias("value")).union(c.select("seq", F.when(F.col("seq") % 4 == 0, "lang").otherwise("cart")))
    return extras.cookie_entropy(values, s.sql(P.values(_KNOWN, "value, bits")))


#: Strings of all kinds: words and whole texts of documents, names of cookies, addresses of pages and their last parts.
_STRINGS = """SELECT DISTINCT v FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS v FROM documents UNION ALL SELECT text FROM documents UNION ALL SELECT name FROM a_cookies
  UNION ALL SELECT url FROM pages UNION ALL SELECT regexp_extract(url, '([^/]*)$', 1) FROM pages UNION ALL SELECT concat(CAST(event_id * 7919 AS VARCHAR), '.', CAST(k AS VARCHAR)) FROM a_requests) x WHERE v <> ''"""


@query(duck(f"""WITH v AS ({_STRINGS}), u AS (SELECT v, CASE WHEN lower(v) = v OR upper(v) = v THEN lower(v) ELSE v END AS t, length(v) + length(regexp_replace(v, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units FROM v),
    c AS (SELECT *, flatten(list_transform(CASE WHEN units <= 256 THEN string_split(t, '') END, lambda x: CASE WHEN ord(x) > 65535 THEN [55296 + (ord(x) - 65536) // 1024, 56320 + (ord(x) - 65536) % 1024] ELSE [ord(x)] END)) AS codes FROM u),
    z AS (SELECT *, CASE WHEN regexp_full_match(t, '[-._x01]*') THEN 2 WHEN regexp_full_match(t, '[-._x0123456789]*') THEN 10 WHEN regexp_full_match(t, '[-._xabcdef0123456789]*') THEN 16 WHEN regexp_full_match(t, '[-._a-z]*') THEN 26
      WHEN regexp_full_match(t, '[-._a-z0-9]*') THEN 36 WHEN regexp_full_match(t, '[-._a-zA-Z0-9/+]*') OR regexp_full_match(t, '[-._a-zA-Z0-9~%]*') THEN 64 ELSE list_max(codes) - list_min(codes) + 1 END AS n FROM c)
  SELECT md5(v) AS h, round(CASE WHEN units > 256 THEN units ELSE log2(n) * units END, 6) AS bits FROM z"""))
def string_entropy(s, d):
    """The most entropy that each string can have."""
    docs, pages, asked = load(s, d, "documents"), load(s, d, "pages"), load(s, d, "a_requests")
    parts = [
        docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("v")), docs.select(F.col("text").alias("v")), load(s, d, "a_cookies").select(F.col("name").alias("v")),
        pages.select(F.col("url").alias("v")), pages.select(F.regexp_extract("url", "([^/]*)$", 1).alias("v")), asked.select(F.concat_ws(".", (F.col("event_id") * 7919).cast("string"), F.col("k").cast("string")).alias("v")),
    ]
    every = parts[0]
    for other in parts[1:]:
        every = every.unionByName(other)
    return every.where("v <> ''").distinct().select(F.md5("v").alias("h"), F.round(extras.string_bits(F.col("v")), 6).alias("bits"))


@query(duck("""WITH b AS (SELECT avg(tracker_domains) AS b FROM a_pet_runs WHERE pet = 'none') SELECT pet, round(100 * avg(tracker_domains) / any_value(b), 6) AS remaining, round(100 * coalesce(stddev_samp(tracker_domains), 0) / sqrt(count(*)) / any_value(b), 6) AS error FROM a_pet_runs, b GROUP BY pet"""))
def pet_relative_to_baseline(s, d):
    return extras.relative_to_baseline(load(s, d, "a_pet_runs")).withColumns({c: F.round(c, 6) for c in ("remaining", "error")})


@query(O.after("scores", f"""WITH {Q._RECOMMEND}, {Q._RANKED}, {Q._PET}, p AS (SELECT pet, round(request_cut, 6) AS v, row_number() OVER (ORDER BY round(request_cut, 6) DESC NULLS LAST, pet) AS r FROM o_pet), c AS (SELECT cmp, pet_score AS v, row_number() OVER (ORDER BY pet_score DESC, cmp) AS r, count(*) OVER () AS n FROM o_rank),
  b AS (SELECT pet, cmp, round(100 * (1 - (1 - greatest(coalesce(request_cut, 0), 0) / 100) * (1 - pet_score / 100)), 6) AS v FROM o_pet, o_rank ORDER BY v DESC, pet, cmp LIMIT 1)
  SELECT 1 AS place, 'best_tool' AS kind, pet AS name, NULL AS other, v AS value, pet || ' keeps most requests away: ' || printf('%.1f', v) || ' % on average.' AS advice FROM p WHERE r = 1
  UNION ALL SELECT 2, 'next_tool', pet, NULL, v, pet || ' comes next with ' || printf('%.1f', v) || ' %.' FROM p WHERE r = 2
  UNION ALL SELECT 3, 'best_platform', cmp, NULL, v, 'A refusal works best with ' || cmp || ' (' || printf('%.1f', v) || ' points).' FROM c WHERE r = 1
  UNION ALL SELECT 4, 'caution_platform', cmp, NULL, v, 'A refusal is worth least with ' || cmp || ' (' || printf('%.1f', v) || ' points).' FROM c WHERE r = n AND n > 1
  UNION ALL SELECT 5, 'best_pair', pet, cmp, v, pet || ' on sites with ' || cmp || ' does most: ' || printf('%.1f', v) || ' % by estimate.' FROM b
  UNION ALL SELECT 6, 'budget', NULL, NULL, epsilon, 'Publish figures with a budget of ' || printf('%.1f', epsilon) || '.' FROM o_best"""))
def pet_recommendations(s, d):
    stats, platforms = studies.pet_baseline(load(s, d, "a_pet_runs")), studies.cmp_ranking(Q.effect(s, d))
    return extras.findings(studies.pet_ranking(stats), platforms, studies.pet_cmp_combos(stats, platforms, 1), privacy.recommend_epsilon(Q.dp_stats(s, d)))


@query(O.after("signals", "SELECT coalesce(category, 'Unknown') AS category, round(avg(n_pre), 6) AS pre, round(avg(coalesce(n_accept, n_pre)), 6) AS accept, round(avg(coalesce(n_reject, n_pre)), 6) AS reject FROM a_sites JOIN o_states ON site = domain WHERE success GROUP BY 1"))
def state_by_category(s, d):
    return extras.state_means(load(s, d, "a_sites"), Q.states(s, d)).withColumns({c: F.round(c, 6) for c in ("pre", "accept", "reject")})


@query(O.after("scores", f"""SELECT p.domain, CASE WHEN coalesce(trackers + third_parties, 0) = 0 THEN 'no tracking signals before consent' ELSE coalesce(trackers + third_parties, 0) || ' tracking signals before consent' END AS c1,
  CASE WHEN NOT found THEN 'no banner' WHEN has_reject AND reject_clicks = 1 THEN 'reject is offered at once' WHEN reject_clicks < 999 THEN 'reject takes ' || reject_clicks || ' clicks' ELSE 'reject cannot be reached' END AS c2,
  CASE WHEN reject_clicks >= 999 AND accept_clicks >= 999 THEN 'neither choice can be reached' WHEN reject_clicks >= 999 THEN 'reject cannot be reached' WHEN reject_clicks <= accept_clicks THEN 'rejecting is as easy as accepting' ELSE 'rejecting takes ' || (reject_clicks - accept_clicks) || ' more clicks' END AS c3,
  CASE WHEN n_patterns = 0 THEN 'no dark patterns' ELSE n_patterns || ' dark patterns' END AS c4,
  CASE WHEN NOT found THEN 'not available without a banner' WHEN NOT (has_reject OR reject_clicks < 999) THEN 'no way to reject' WHEN n_reject IS NULL THEN 'no data after rejecting' WHEN NOT reject_done THEN 'rejecting failed'
    WHEN coalesce(n_new, 0) = 0 AND n_reject <= coalesce(n_pre, 0) THEN 'nothing new after rejecting' WHEN n_accept IS NOT NULL AND n_reject < n_accept THEN 'something new, but less than after accepting' WHEN n_accept IS NOT NULL THEN 'no better than after accepting'
    WHEN coalesce(n_new, 0) > 0 THEN n_new || ' new signals after rejecting' ELSE 'partial' END AS c5,
  CASE WHEN banner_text = '' AND html = '' THEN 'no text' ELSE coalesce(nullif(concat_ws(', ', CASE WHEN {O.has_any("lower(banner_text)", P.PURPOSES)} THEN 'purposes' END, CASE WHEN {O.has_any("lower(banner_text)", P.VENDORS)} THEN 'vendors' END,
    CASE WHEN {O.has_any("lower(html)", P.PRIVACY_LINKS)} THEN 'privacy link' END, CASE WHEN coalesce({O.CLARITY}, 99) < 30 THEN 'clear sentences' END), ''), 'nothing named') END AS c6
  FROM o_patterns p LEFT JOIN o_signals s ON s.site = p.domain LEFT JOIN o_states t ON t.site = p.domain"""))
def explain_criteria(s, d):
    """Why each site got its points, by criterion."""
    site = lambda df: df.withColumnRenamed("site", "domain")
    df = load(s, d, "a_banners").join(site(Q.signals(s, d)), "domain", "left").join(Q.patterns(s, d).select("domain", "n_patterns"), "domain", "left").join(site(Q.states(s, d)), "domain", "left")
    df = df.withColumn("n_signals", F.coalesce(F.col("trackers") + F.col("third_parties"), F.lit(0)))
    return df.select("domain", *[why.alias(c) for c, why in scoring.explanations().items()])


@query(duck("SELECT domain, CAST(row_number() OVER (ORDER BY min(seq)) AS INT) AS rank FROM (SELECT domain, site_id * 2 AS seq FROM a_sites WHERE category IS NOT NULL UNION ALL SELECT domain, site_id * 2 + 1001 FROM a_sites) u GROUP BY domain"))
def merge_site_lists(s, d):
    sites = load(s, d, "a_sites")
    return extras.renumber(sites.where("category IS NOT NULL").select("domain", (F.col("site_id") * 2).alias("seq")).union(sites.select("domain", F.col("site_id") * 2 + 1001)))


_SNAP = "(SELECT site, count(*) AS cookies, count(*) FILTER (is_tracker) AS trackers, count(*) FILTER (third_party) AS third_party, max(age_days) AS longest FROM o_classified GROUP BY site)"
_LISTED = lambda key, where: f"(SELECT site, string_agg(k || '=' || n, ',' ORDER BY k) AS v FROM (SELECT site, {key} AS k, count(*) AS n FROM o_classified {where} GROUP BY site, {key}) x GROUP BY site)"


@query(O.after("classified", f"SELECT s.*, c.v AS categories, coalesce(t.v, '') AS vendors FROM {_SNAP} s JOIN {_LISTED('category', '')} c ON c.site = s.site LEFT JOIN {_LISTED('vendor', 'WHERE is_tracker')} t ON t.site = s.site"))
def site_snapshot(s, d):
    """Counts of each site's cookies, with maps of categories and of trackers by vendor, here as text."""
    made = extras.site_snapshot(Q.classified(s, d))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return made.withColumns({c: text(c) for c in ("categories", "vendors")})


def _study(s, d):
    sites, patterns = Q.report_sites(s, d), Q.patterns(s, d)
    share = lambda name: F.avg(F.array_contains("names", name).cast("double"))
    after = metrics.after_rejecting(Q.states(s, d))
    public = sites.where(D.is_public_sector(F.col("domain"))).agg(F.count("*").alias("public_sites"), F.avg("overall").alias("public_score"), F.avg((F.col("n_signals") > 0).cast("double")).alias("public_tracking"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    one = metrics.crawl_summary(load(s, d, "a_banners")).crossJoin(patterns.agg(share("missing_reject").alias("missing_reject_rate"), share("multi_layer").alias("multi_layer_rate")))
    one = one.crossJoin(after.select(ratio("reduces", "sites").alias("reduces_rate"), ratio("eliminates", "sites").alias("eliminates_rate"))).crossJoin(sites.agg(F.avg("overall").alias("mean_score"))).crossJoin(public)
    stats = studies.pet_baseline(load(s, d, "a_pet_runs")).join(studies.pet_ranking(studies.pet_baseline(load(s, d, "a_pet_runs"))).select("pet", "rank"), "pet")
    tools = stats.select("rank", F.col("pet").alias("name"), "sites", F.round("tracker_cut", 6).alias("tracker_pct"), F.round("request_cut", 6).alias("request_pct"), F.format_string("%s avg tracker reduction in study", L.signed_percent(F.col("tracker_cut"))).alias("label"))
    ranked = studies.cmp_ranking(studies.enough_sites(Q.effect(s, d)))
    platforms = ranked.join(Q.effect(s, d).select("cmp", "mean_score", "reject_pct"), "cmp").select("rank", F.col("cmp").alias("name"), "sites", F.round("mean_score", 6).alias("score"), F.round(F.col("reject_pct") / 100, 6).alias("reject_rate"), "pet_score")
    return one, tools, platforms


@query(O.after("scores", f"""WITH {Q._SITES} SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success AND found) AS with_banner, count(*) FILTER (success AND NOT found) AS without_banner FROM a_banners) a,
  (SELECT round(avg(f3::INT), 6) AS missing_reject_rate, round(avg(f6::INT), 6) AS multi_layer_rate FROM o_patterns) b,
  (SELECT round(count(*) FILTER (nullif(rej, 0) < nullif(pre, 0))::DOUBLE / count(*), 6) AS reduces_rate, round(count(*) FILTER (rej = 0)::DOUBLE / count(*), 6) AS eliminates_rate FROM (SELECT site, count(DISTINCT d) FILTER (state = 'pre') AS pre, count(DISTINCT d) FILTER (state = 'reject') AS rej FROM o_third GROUP BY site) x) c,
  (SELECT round(avg(overall), 6) AS mean_score FROM o_rep) e, (SELECT count(*) AS public_sites, round(avg(overall), 6) AS public_score, round(avg((n_signals > 0)::INT), 6) AS public_tracking FROM o_rep WHERE ends_with(domain, '.gov.uk')) f"""))
def study_figures(s, d):
    """The single figures of a published study."""
    one = _study(s, d)[0]
    return one.withColumns({c: F.round(c, 6) for c in one.columns if c.endswith("rate") or c in ("mean_score", "public_score", "public_tracking")})


@query(O.after("scores", f"""WITH {Q._RANKED}, {Q._PET}, n AS (SELECT *, count(*) OVER () AS k FROM o_rank WHERE cmp <> 'No CMP Detected'), e AS (SELECT * FROM n WHERE sites >= CASE WHEN k > 5 THEN 3 ELSE 1 END)
  SELECT 'tools' AS part, CAST(row_number() OVER (ORDER BY round(request_cut, 6) DESC NULLS LAST, pet) AS INT) AS rank, pet AS name, sites FROM o_pet
  UNION ALL SELECT 'platforms', CAST(row_number() OVER (ORDER BY pet_score DESC, cmp) AS INT), cmp, sites FROM e UNION ALL SELECT 'metadata', 0, 'total', (SELECT count(*) FROM a_banners)"""))
def study_snapshot(s, d):
    """The published figures of a study, written as one row of JSON and read back: its total, tools and platforms in order. The figures
    themselves are those of study_figures, pet_ranking and cmp_ranking."""
    one, tools, platforms = _study(s, d)
    path = new_folder(s, "snapshot")
    sinks.write_documents(sinks.report_row({"metadata": one, "tools": tools, "platforms": platforms}), path)
    row = s.read.schema("metadata string, tools string, platforms string").json(path)
    ranked = lambda c: row.select(F.lit(c).alias("part"), F.explode(F.from_json(c, "array<struct<rank: int, name: string, sites: bigint>>")).alias("x")).select("part", "x.*")
    total = row.select(F.lit("metadata").alias("part"), F.lit(0).alias("rank"), F.lit("total").alias("name"), F.get_json_object("metadata", "$[0].total").cast("bigint").alias("sites"))
    return ranked("tools").unionByName(ranked("platforms")).unionByName(total)


@query(O.after("scores", "SELECT domain, c1, c2, c3, c4, c6, round(" + " + ".join(f"{c} * {w}::DOUBLE" for c, w in P.LEGACY_WEIGHTS.items() if c != "c5") + " + coalesce(c5, 0) * 0.15::DOUBLE, 6) AS legacy FROM o_scores"))
def legacy_scores(s, d):
    df = Q.scores(s, d).withColumn("c5", F.coalesce("c5", F.lit(0)))
    return df.select("domain", "c1", "c2", "c3", "c4", "c6", F.round(scoring.overall(P.LEGACY_WEIGHTS), 6).alias("legacy"))


# Streams over the event table, run to the end of what is there.
def _stream(s, d, end: bool):
    """The events as a stream of files in order of time; end: with marks that close what is open."""
    path = new_folder(s, "stream")
    events = load(s, d, "a_interactions").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "tab", "page", "label", "kind")
    (audit.ended(events) if end else events).write.parquet(f"{path}/in")
    return audit.read_events(s, f"{path}/in", audit.EVENTS, files=64), path


@query(duck("""WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 10 MINUTES OR lag(page) OVER w <> page THEN 1 ELSE 0 END AS new FROM a_interactions WINDOW w AS (PARTITION BY tab ORDER BY ts, event_id)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY tab ORDER BY ts, event_id) AS session FROM m)
  SELECT tab, any_value(page) AS page, min(event_id) AS first_event, count(*) AS n, count(*) FILTER (kind = 'click') AS clicks, bool_or(kind = 'banner_seen') AS armed, bool_or(kind = 'banner_seen') AND count(*) FILTER (kind = 'click') > 0 AS completed FROM n GROUP BY tab, session"""))
def session_stream(s, d):
    events, path = _stream(s, d, True)
    return audit.run_to_table(audit.sessions(events), f"{path}/out", f"{path}/cp")


@query(duck("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, kind, count(*) AS n FROM a_interactions GROUP BY 1, 2"))
def rate_window_stream(s, d):
    events, path = _stream(s, d, True)
    out = audit.run_to_table(audit.rates(events), f"{path}/out", f"{path}/cp")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(duck("""WITH w AS (SELECT kind, date_trunc('hour', ts) - to_minutes(60 * i) AS start FROM a_interactions, range(2) t(i)) SELECT CAST(start AS VARCHAR) AS start, kind, count(*) AS n FROM w GROUP BY 1, 2"""))
def sliding_window_stream(s, d):
    """Rates over windows of two hours, a new one each hour."""
    events, path = _stream(s, d, True)
    out = audit.run_to_table(audit.rates(events, "2 hours", slide="1 hour"), f"{path}/out", f"{path}/cp")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(O.after("signals", "SELECT d AS domain, 3 AS first_parties FROM o_third GROUP BY d HAVING count(DISTINCT site) >= 3"))
def prevalence_stream(s, d):
    """Trackers as a stream learns them: each once, when it meets the third site."""
    path = new_folder(s, "stream")
    load(s, d, "a_requests").select("host", "site").write.parquet(f"{path}/in")
    stream = s.readStream.schema("host string, site string").parquet(f"{path}/in")
    return audit.run_to_table(audit.learned_trackers(stream), f"{path}/out", f"{path}/cp")


@query(duck("SELECT domain, min(CASE WHEN cmp IS NULL THEN 1 ELSE 0 END) AS batch FROM a_sites GROUP BY domain"))
def incremental_ingest(s, d):
    """Sites that come in two deliveries, the second with all that the first had: each is taken up once."""
    path = new_folder(s, "ingest")
    sites = load(s, d, "a_sites").select("domain", "cmp")
    sites.where("cmp IS NOT NULL").select("domain", F.lit(0).alias("batch")).write.parquet(f"{path}/in")
    stream = lambda: s.readStream.schema("domain string, batch int").parquet(f"{path}/in")
    audit.ingest(stream(), f"{path}/out", f"{path}/cp", "domain")
    sites.select("domain", F.lit(1).alias("batch")).write.mode("append").parquet(f"{path}/in")
    return audit.ingest(stream(), f"{path}/out", f"{path}/cp", "domain")


# Phrases.
@query(O.after("patterns", f"""WITH u AS (SELECT x.p AS pattern, count(*) AS n FROM o_patterns, LATERAL (VALUES {Q._NAMES}) AS x(p, f) WHERE f GROUP BY 1), t AS (SELECT pattern, 100.0::DOUBLE * n / (SELECT count(*) FROM o_patterns) AS pct FROM u)
  SELECT pattern, printf('%s (%.1f%%)', CASE WHEN pct >= 90 THEN 'Nearly all sites' WHEN pct >= 70 THEN 'A large majority of sites' WHEN pct >= 50 THEN 'A majority of sites' WHEN pct >= 30 THEN 'A substantial minority of sites' ELSE 'A minority of sites' END, pct) AS phrase FROM t"""))
def share_phrases(s, d):
    return metrics.pattern_prevalence(Q.patterns(s, d)).select("pattern", L.share_phrase(F.col("pct")).alias("phrase"))


@query(duck("""SELECT b.domain, CAST((CASE WHEN found THEN 2 ELSE 0 END) + (CASE WHEN has_accept THEN 5 ELSE 0 END) + (CASE WHEN has_reject THEN 5 ELSE 0 END) + (CASE WHEN contains(html, 'id="s"') THEN 3 ELSE 0 END)
  + (CASE WHEN accept_clicks < 999 THEN 1 ELSE 0 END) + (CASE WHEN reject_clicks < 999 THEN 1 ELSE 0 END) + (CASE WHEN banner_text <> '' THEN 1 ELSE 0 END) AS INT) AS quality FROM a_banners b"""))
def scan_quality(s, d):
    return load(s, d, "a_banners").withColumn("has_settings", F.contains("html", F.lit('id="s"'))).select("domain", L.scan_quality().alias("quality"))


#: Buttons as a scan shows them: a third of the sites have no button to refuse, most have one to the settings, some look like links.
_PREVIEWS = """SELECT b.domain, CASE WHEN x.role = 'settings' THEN 'settings' ELSE b.kind END AS role, CAST(replace(b.width, 'px', '') AS double) AS width, CAST(replace(b.height, 'px', '') AS double) AS height,
    CAST(replace(b.font_size, 'px', '') AS double) - CASE WHEN x.role = 'settings' THEN 2 ELSE 0 END AS font_size, CASE b.font_weight WHEN 'bold' THEN 700 WHEN 'normal' THEN 400 ELSE 600 END AS font_weight,
    n.site_id % 5 = 2 AND x.role = 'own' AS plain_link, n.reject_clicks AS clicks
  FROM a_buttons b JOIN a_banners n ON n.domain = b.domain CROSS JOIN (SELECT * FROM (VALUES ('own'), ('settings')) AS t(role)) x
  WHERE (x.role = 'own' AND (b.kind = 'accept' OR n.site_id % 3 <> 0)) OR (x.role = 'settings' AND b.kind = 'reject' AND n.site_id % 4 <> 1)"""


@query(duck(f"""WITH p AS ({_PREVIEWS}), j AS (SELECT a.domain, CASE WHEN r.domain IS NOT NULL THEN 'direct' WHEN t.domain IS NOT NULL THEN 'settings' ELSE 'missing' END AS source, t.clicks,
    coalesce(r.width, t.width) * coalesce(r.height, t.height) / (a.width * a.height) AS area, coalesce(r.font_size, t.font_size) / a.font_size AS font, a.font_weight - coalesce(r.font_weight, t.font_weight) AS bold, coalesce(r.plain_link, t.plain_link) AS link
    FROM (SELECT * FROM p WHERE role = 'accept') a LEFT JOIN (SELECT * FROM p WHERE role = 'reject') r ON r.domain = a.domain LEFT JOIN (SELECT * FROM p WHERE role = 'settings') t ON t.domain = a.domain)
  SELECT domain, source, CASE WHEN source = 'missing' THEN 'no reject button' ELSE concat_ws('; ', CASE WHEN source = 'settings' THEN CASE WHEN clicks BETWEEN 1 AND 998 THEN 'reject only behind settings (' || clicks || ' clicks)' ELSE 'reject only behind settings' END END,
    CASE WHEN area < 0.7 THEN 'reject is smaller' END, CASE WHEN font < 0.85 THEN 'reject has a smaller font' END, CASE WHEN bold > 200 THEN 'accept is bolder' END, CASE WHEN link THEN 'reject looks like a plain link' END) END AS issues FROM j"""))
def compare_buttons(s, d):
    """The button to accept beside the way to refuse, which may lead through the settings."""
    for t in ("a_buttons", "a_banners"):
        load(s, d, t).createOrReplaceTempView(t)
    issues = B.compare_previews(s.sql(_PREVIEWS))
    return issues.select("domain", "source", F.concat_ws("; ", "issues").alias("issues"))


@query(O.after("scores", f"WITH {Q._CATALOGUE} SELECT metric, epsilon, CASE epsilon WHEN 0.1 THEN 'Low (high privacy)' WHEN 0.5 THEN 'Moderate' WHEN 1.0 THEN 'Balanced (recommended)' WHEN 2.0 THEN 'Good utility' WHEN 5.0 THEN 'High utility' WHEN 10.0 THEN 'Near-exact' END AS utility, CASE WHEN epsilon <= 0.1 THEN 'Very high privacy, low utility' WHEN epsilon <= 0.5 THEN 'High privacy, moderate utility' WHEN epsilon <= 1 THEN 'Good privacy-utility balance' WHEN epsilon <= 2 THEN 'Moderate privacy, good utility' ELSE 'Low privacy, high utility' END AS note FROM o_queries, o_eps"))
def epsilon_notes(s, d):
    df = privacy.epsilons(Q.catalogue(s, d).select("metric"))
    return df.select("metric", "epsilon", L.utility(F.col("epsilon")).alias("utility"), L.epsilon_note(F.col("epsilon")).alias("note"))


# Tools by weight, and what they help with.
PROFILES = {
    "Brave Shields": (100, ["pre_consent_trackers", "advertising", "fingerprinting", "analytics"]),
    "Privacy Badger": (90, ["pre_consent_trackers", "fingerprinting"]),
    "uBlock Origin": (80, ["pre_consent_trackers", "advertising", "analytics"]),
    "Firefox ETP Strict": (65, ["pre_consent_trackers", "fingerprinting", "social"]),
    "Firefox ETP Standard": (55, ["pre_consent_trackers", "social"]),
    "Consent-O-Matic": (50, ["dark_patterns", "reject_effort"]),
}
_HELPS = [(tool, issue, i, weight) for tool, (weight, issues) in PROFILES.items() for i, issue in enumerate(issues)]


@query(O.after("scores", f"""WITH h AS ({P.values(_HELPS, 'tool, issue, ord, weight')}), c AS (SELECT DISTINCT site, lower(category) AS category FROM o_classified WHERE is_tracker),
  i AS (SELECT DISTINCT site, 'pre_consent_trackers' AS issue, 2 AS points FROM c UNION ALL SELECT site, category, 1 FROM c
    UNION ALL SELECT domain, 'reject_effort', 2 FROM o_patterns WHERE NOT has_reject OR reject_clicks > accept_clicks OR n_patterns > 0 UNION ALL SELECT domain, 'dark_patterns', 2 FROM o_patterns WHERE n_patterns > 0),
  w AS (SELECT *, CASE issue WHEN 'pre_consent_trackers' THEN 'pre-consent trackers' WHEN 'dark_patterns' THEN 'dark patterns' WHEN 'reject_effort' THEN 'reject friction' WHEN 'fingerprinting' THEN 'fingerprinting signals' ELSE issue || ' trackers' END AS why FROM i JOIN h USING (issue)),
  m AS (SELECT site, tool, CAST(sum(points) AS BIGINT) AS relevance, max(weight) AS weight, list(why ORDER BY ord) AS reasons FROM w GROUP BY site, tool),
  r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY relevance DESC, weight DESC, tool) AS r FROM m)
  SELECT site, tool, relevance, CASE len(reasons) WHEN 1 THEN 'Helps with ' || reasons[1] || '.' WHEN 2 THEN 'Helps with ' || reasons[1] || ' and ' || reasons[2] || '.' ELSE 'Helps with ' || reasons[1] || ', ' || reasons[2] || ', and ' || reasons[3] || '.' END AS why FROM r WHERE r <= 3"""))
def site_tool_advice(s, d):
    """For each site the three tools that help most with its issues; a top-k report."""
    kinds = Q.classified(s, d).where("is_tracker").select("site", F.lower("category").alias("category")).distinct()
    b = load(s, d, "a_banners").join(Q.patterns(s, d).select("domain", "n_patterns"), "domain")
    effort = ~F.col("has_reject") | (F.col("reject_clicks") > F.col("accept_clicks")) | (F.col("n_patterns") > 0)
    row = lambda df, site, issue, points: df.select(F.col(site).alias("site"), issue.alias("issue"), F.lit(points).alias("points"))
    issues = row(kinds.select("site").distinct(), "site", F.lit("pre_consent_trackers"), 2).unionByName(row(kinds, "site", F.col("category"), 1))
    issues = issues.unionByName(row(b.where(effort), "domain", F.lit("reject_effort"), 2)).unionByName(row(b.where("n_patterns > 0"), "domain", F.lit("dark_patterns"), 2))
    return extras.advice(issues, s.sql(P.values(_HELPS, "tool, issue, ord, weight")))
