"""DuckDB SQL for the steps that several oracles share."""

from __future__ import annotations

from crumbtrail.functions.text import ACCENTS
from crumbtrail.plans import params as P
from crumbtrail.plans.adapters import EXPECTED
from crumbtrail.plans.params import values

_q = lambda s: "'" + s.replace("'", "''") + "'"


def reg(host: str) -> str:
    parts = f"string_split(lower(ltrim({host}, '.')), '.')"
    suffixes = ", ".join(map(_q, P.TWO_LABEL_SUFFIXES))
    return f"(CASE WHEN array_to_string({parts}[-2:], '.') IN ({suffixes}) THEN array_to_string({parts}[-3:], '.') ELSE array_to_string({parts}[-2:], '.') END)"


def has_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


def norm(text: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(translate({text}, {_q(ACCENTS[0])}, {_q(ACCENTS[1])}), '\\p{{M}}+', '', 'g')), '[ \\t\\n\\r]+', ' ', 'g'))"


def name_case(i: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(name), {_q(p.lower())}) THEN {_q((v, c)[i])}" for p, v, c in P.HEURISTICS) + " END"


CLASSIFIED = f"""
tmap AS ({values(P.TRACKERS, "domain, vendor, category")}),
fmap AS ({values(P.FALLBACK_TRACKERS, "domain, vendor, category")}),
lists AS (SELECT domain, max(list) AS l FROM ({values([("easyprivacy", d) for d in P.EASYPRIVACY] + [("easylist", d) for d in P.EASYLIST], "list, domain")}) x GROUP BY domain),
o_hosts AS (SELECT *, ltrim(cookie_domain, '.') AS host, {reg("cookie_domain")} AS registered, {reg("cookie_domain")} <> {reg("site")} AS third_party, {name_case(0)} AS nv, {name_case(1)} AS nc,
  CAST(CASE WHEN expires <= 0 THEN 0 ELSE greatest(0, round((expires - as_of) / 86400)) END AS BIGINT) AS age_days FROM a_cookies),
o_met AS (SELECT h.*, coalesce(t1.vendor, t2.vendor) AS mv, coalesce(t1.category, t2.category) AS mc, greatest(l1.l, l2.l) AS l, f.vendor AS fv, f.category AS fc
  FROM o_hosts h LEFT JOIN tmap t1 ON t1.domain = h.registered LEFT JOIN tmap t2 ON t2.domain = h.host
  LEFT JOIN lists l1 ON l1.domain = h.registered LEFT JOIN lists l2 ON l2.domain = h.host LEFT JOIN fmap f ON f.domain = h.registered),
o_src AS (SELECT *, CASE WHEN mv IS NOT NULL THEN 'disconnect' WHEN l IS NOT NULL THEN l WHEN fv IS NOT NULL THEN 'fallback' WHEN nv IS NOT NULL THEN 'name'
  WHEN NOT third_party AND (contains(lower(cookie_domain), 'cdn') OR contains(lower(cookie_domain), 'static') OR contains(lower(cookie_domain), 'assets') OR age_days = 0) THEN 'own' ELSE 'unknown' END AS step FROM o_met),
o_classified AS (SELECT seq, site, state, name, cookie_domain, path, as_of, expires, registered, third_party, age_days,
  CASE step WHEN 'disconnect' THEN mv WHEN 'fallback' THEN fv WHEN 'name' THEN nv ELSE 'Unknown' END AS vendor,
  CASE step WHEN 'disconnect' THEN mc WHEN 'fallback' THEN fc WHEN 'name' THEN nc WHEN 'easyprivacy' THEN 'Analytics' WHEN 'easylist' THEN 'Advertising' WHEN 'own' THEN 'Functional' ELSE 'Unknown' END AS category,
  step NOT IN ('own', 'unknown') AS is_tracker, CASE WHEN step IN ('name', 'own') THEN 'heuristic' ELSE step END AS source FROM o_src)"""

SIGNALS = f"""
o_third AS (SELECT site, state, {reg("host")} AS d FROM a_requests WHERE {reg("host")} <> {reg("site")}),
o_signals AS (SELECT coalesce(a.site, b.site) AS site, coalesce(trackers, 0) AS trackers, coalesce(third_parties, 0) AS third_parties
  FROM (SELECT site, count(DISTINCT (name, cookie_domain)) AS trackers FROM o_classified WHERE state = 'pre' AND is_tracker GROUP BY site) a
  FULL JOIN (SELECT site, count(DISTINCT d) AS third_parties FROM o_third WHERE state = 'pre' GROUP BY site) b ON a.site = b.site),
o_new AS (SELECT DISTINCT site, name, cookie_domain, path FROM a_cookies WHERE state = 'reject'
  EXCEPT SELECT site, name, cookie_domain, path FROM a_cookies WHERE state = 'pre'),
o_new_third AS (SELECT DISTINCT site, d FROM o_third WHERE state = 'reject' EXCEPT SELECT site, d FROM o_third WHERE state = 'pre'),
o_states AS (SELECT s.site, n_pre, n_reject, n_accept, coalesce(n.n, 0) + coalesce(m.n, 0) AS n_new FROM
  (SELECT site, count(DISTINCT d) FILTER (state = 'pre') AS n_pre, nullif(count(DISTINCT d) FILTER (state = 'reject'), 0) AS n_reject,
          nullif(count(DISTINCT d) FILTER (state = 'accept'), 0) AS n_accept FROM o_third GROUP BY site) s
  LEFT JOIN (SELECT site, count(*) AS n FROM o_new GROUP BY site) n ON n.site = s.site
  LEFT JOIN (SELECT site, count(*) AS n FROM o_new_third GROUP BY site) m ON m.site = s.site)"""

_PX = lambda c: f"coalesce(CAST(nullif(regexp_extract({c}, '([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE), 0)"
_LIN = lambda x: f"(CASE WHEN {x} / 255.0 <= 0.03928 THEN {x} / 255.0 / 12.92 ELSE pow(({x} / 255.0 + 0.055) / 1.055, 2.4) END)"
_LUM = {k: "(" + " + ".join(f"{w} * {_LIN(c)}" for w, c in zip((0.2126, 0.7152, 0.0722), rgb)) + ")" for k, rgb in {"white": (255,) * 3, "333": (51,) * 3, "bbb": (187,) * 3}.items()}

ASYMMETRIC = f"""
o_pair AS (SELECT domain, max(width) FILTER (kind = 'accept') AS aw, max(height) FILTER (kind = 'accept') AS ah, max(font_size) FILTER (kind = 'accept') AS af,
  max(width) FILTER (kind = 'reject') AS rw, max(height) FILTER (kind = 'reject') AS rh, max(font_size) FILTER (kind = 'reject') AS rf,
  max(font_weight) FILTER (kind = 'reject') AS rwt, max(color) FILTER (kind = 'reject') AS rc, count(DISTINCT kind) AS k FROM a_buttons GROUP BY domain),
o_ratio AS (SELECT domain, k, {_PX("rw")} * {_PX("rh")} / ({_PX("aw")} * {_PX("ah")}) AS size_ratio, {_PX("rf")} / {_PX("af")} AS font_ratio,
  700 - (CASE rwt WHEN 'normal' THEN 400 ELSE CAST(rwt AS INT) END) AS weight_diff,
  ({_LUM["white"]} + 0.05) / ((CASE rc WHEN '#bbb' THEN {_LUM["bbb"]} WHEN 'white' THEN {_LUM["white"]} ELSE {_LUM["333"]} END) + 0.05) AS contrast FROM o_pair WHERE k = 2),
o_d1 AS (SELECT b.domain, size_ratio, font_ratio, weight_diff, contrast,
  coalesce(size_ratio < 0.7 OR font_ratio < 0.85 OR weight_diff > 200 OR contrast < 3.0, false) AS d1
  FROM (SELECT DISTINCT domain FROM a_buttons) b LEFT JOIN o_ratio r ON r.domain = b.domain)"""

def _in(flag: str) -> str:
    return f"template IN ({', '.join(map(str, EXPECTED[flag]))})"


#: Flags that come from markup are those written down for each template by hand.
PATTERNS = f"""
o_hidden AS (SELECT domain, bool_or(kind = 'reject' AND (display = 'none' OR visibility = 'hidden' OR color = background)) AS hidden FROM a_buttons GROUP BY domain),
o_flags AS (SELECT b.*, coalesce(d1, false) AND found AS f1, found AND ({_in("f2")} OR coalesce(hidden, false)) AS f2, NOT found OR NOT has_reject OR reject_clicks = 999 AS f3,
  found AND {_in("f4")} AS f4, found AND {_in("f5")} AS f5, accept_clicks < 999 AND reject_clicks > accept_clicks AS f6, found AND {_in("f7")} AS f7
  FROM a_banners b LEFT JOIN o_d1 ON o_d1.domain = b.domain LEFT JOIN o_hidden h ON h.domain = b.domain),
o_patterns AS (SELECT *, CAST(f1 AS INT) + CAST(f2 AS INT) + CAST(f3 AS INT) + CAST(f4 AS INT) + CAST(f5 AS INT) + CAST(f6 AS INT) + CAST(f7 AS INT) AS n_patterns FROM o_flags)"""


def _band(n: str, steps: list[tuple[int, int]]) -> str:
    return "CASE " + " ".join(f"WHEN {n} <= {b} THEN {s}" for b, s in steps) + " ELSE 0 END"


_SENTENCES = "list_filter(list_transform(regexp_split_to_array(lower(banner_text), '[.!?]+'), lambda s: trim(regexp_replace(s, '[ \\t\\n\\r]+', ' ', 'g'))), lambda s: s <> '')"
CLARITY = f"CASE WHEN len({_SENTENCES}) > 0 THEN CAST(list_sum(list_transform({_SENTENCES}, lambda s: len(string_split(s, ' ')))) AS DOUBLE) / len({_SENTENCES}) END"
_W = P.WEIGHTS
SCORES = f"""
o_criteria AS (SELECT p.domain, {_band("coalesce(trackers + third_parties, 0)", [(0, 100), (2, 60), (5, 30), (10, 10)])} AS c1,
  CASE WHEN NOT found THEN 0 WHEN has_reject AND reject_clicks = 1 THEN 100 WHEN reject_clicks < 999 THEN 50 ELSE 0 END AS c2,
  CASE WHEN reject_clicks >= 999 THEN 0 WHEN reject_clicks <= accept_clicks THEN 100 WHEN reject_clicks - accept_clicks = 1 THEN 50 ELSE 20 END AS c3,
  {_band("n_patterns", [(0, 100), (1, 60), (2, 30)])} AS c4,
  CASE WHEN NOT found THEN NULL WHEN NOT (has_reject OR reject_clicks < 999) THEN 0 WHEN n_reject IS NULL THEN NULL WHEN NOT reject_done THEN 0
       WHEN coalesce(n_new, 0) = 0 AND n_reject <= coalesce(n_pre, 0) THEN 100
       WHEN n_accept IS NOT NULL THEN CASE WHEN n_reject < n_accept THEN 50 ELSE 0 END WHEN coalesce(n_new, 0) > 0 THEN 30 ELSE 50 END AS c5,
  CASE WHEN banner_text = '' AND html = '' THEN 0 ELSE (CASE WHEN {has_any("lower(banner_text)", P.PURPOSES)} THEN 30 ELSE 0 END) + (CASE WHEN {has_any("lower(banner_text)", P.VENDORS)} THEN 30 ELSE 0 END)
    + (CASE WHEN {has_any("lower(html)", P.PRIVACY_LINKS)} THEN 20 ELSE 0 END) + (CASE WHEN coalesce({CLARITY}, 99) < 30 THEN 20 ELSE 0 END) END AS c6
  FROM o_patterns p LEFT JOIN o_signals s ON s.site = p.domain LEFT JOIN o_states t ON t.site = p.domain WHERE success),
o_overall AS (SELECT *, round((c1 * {_W["c1"]}::DOUBLE + c2 * {_W["c2"]}::DOUBLE + c3 * {_W["c3"]}::DOUBLE + c4 * {_W["c4"]}::DOUBLE + coalesce(c5 * {_W["c5"]}::DOUBLE, 0) + c6 * {_W["c6"]}::DOUBLE)
  / ({1 - _W["c5"]}::DOUBLE + CASE WHEN c5 IS NULL THEN 0 ELSE {_W["c5"]}::DOUBLE END), 6) AS overall FROM o_criteria),
o_scores AS (SELECT *, CASE WHEN round(overall, 2) >= 90 THEN 'A' WHEN round(overall, 2) >= 75 THEN 'B' WHEN round(overall, 2) >= 60 THEN 'C' WHEN round(overall, 2) >= 40 THEN 'D' ELSE 'F' END AS grade FROM o_overall)"""

#: What each step needs in front of it.
CHAIN = {"classified": [CLASSIFIED], "signals": [CLASSIFIED, SIGNALS], "d1": [ASYMMETRIC], "patterns": [ASYMMETRIC, PATTERNS], "scores": [CLASSIFIED, SIGNALS, ASYMMETRIC, PATTERNS, SCORES]}


def after(step: str, sql: str) -> str:
    from crumbtrail.plans.adapters import duck

    more = sql.strip()
    head = "WITH " + ",".join(c.strip() for c in CHAIN[step])
    return duck(head + (",\n" + more[5:] if more[:5].upper() == "WITH " else "\n" + more))
