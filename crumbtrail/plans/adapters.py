"""Canonical tables made from the star-schema tables, in SQL that Spark and DuckDB both read.

A production user passes crawl tables of the same columns instead; these stand in for them and
grow with ``events`` and ``customer``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from crumbtrail.plans.params import values
from crumbtrail.plans.store import once

_HOSTS = [
    "doubleclick.net", "stats.g.doubleclick.net", "www.google-analytics.com", "connect.facebook.net", "static.criteo.com",
    "script.hotjar.com", "analytics.tiktok.com", "sb.scorecardresearch.com", "api.segment.io", "ib.adnxs.com",
    "cdn.taboola.com", "widgets.outbrain.com", "fonts.gstatic.com", "cdn.jsdelivr.net", "images.shopfront.com",
    "media.shopfront.com", "stats.newsroom.co.uk", "static.newsroom.co.uk", "maps.city.gov.uk", "api.payments.com",
    "player.video.org", "SELF", "SELF", "SELF",
]
_NAMES = ["_ga", "_gid", "_fbp", "IDE", "NID", "session_id", "csrftoken", "_hjid", "lang", "cart", "mp_abc", "li_gc", "uid", "consent", "theme", "amp_x"]
_CMPS = ["OneTrust", "Cookiebot", "Quantcast", "TrustArc", "Didomi", "Usercentrics", "Sourcepoint"]
_LABELS = [
    "Accept all", "Reject all", "Manage preferences", "OK", "Refuser", "Ablehnen", "Close", "Only essential cookies", "I agree", "Einstellungen", "Learn more", "Aceptar todo",
    "Continue without accepting", "Reject Optional Cookies", "Not now", "Tylko niezbędne pliki cookie", "Nastavení cookies", "Προβολή επιλογών", "Çerez ayarları", "Aċċetta kollox",
    "Save choices", "Vain välttämättömät evästeet", "  I   ACCEPT ", "",
]
#: number, text, markup, accept and reject buttons, clicks to accept and to reject.
TEMPLATES = [
    (0, "We use cookies for analytics and advertising. Read our privacy policy.", '<div class="banner"><p>[T]</p><a href="/p">Privacy policy</a><button id="a">Accept all</button><button id="r">Reject all</button></div>', 1, 1, 1, 1),
    (1, "Cookies help us give you the best experience.", '<div class="onetrust"><p>[T]</p><button id="a">Accept all</button><button id="r">Reject all</button></div>', 1, 1, 1, 1),
    (2, "We value your privacy. Google and Meta measure visits.", '<div class="banner"><p>[T]</p><button id="a">OK</button><button id="r" style="display:none">Reject all</button></div>', 1, 1, 1, 1),
    (3, "By using this site you agree.", '<div class="cybot"><p>[T]</p><button id="a">OK</button></div>', 1, 0, 1, 999),
    (4, "Choose purposes: marketing, measurement.", '<div class="didomi"><p>[T]</p><label for="m">Marketing</label><input type="checkbox" id="m" checked><label for="n">Strictly necessary</label><input type="checkbox" id="n" checked><button id="a">Accept all</button><button id="r">Reject all</button></div>', 1, 1, 1, 1),
    (5, "Don't not accept or you will miss out!", '<div class="banner"><p>[T]</p><button id="a">Accept all</button><button id="r">No thanks</button></div>', 1, 1, 1, 1),
    (6, "We and third parties use cookies. See our cookie policy.", '<div class="usercentrics"><p>[T]</p><a href="/c">Cookie policy</a><button id="a">Accept all</button><button id="s">Manage preferences</button></div>', 1, 1, 1, 2),
    (7, "Please choose to continue.", '<div class="cookie-wall" style="position:fixed;width:100%;height:100%"><p>[T]</p><button id="a">Accept all</button><button id="s">Settings</button></div>', 1, 1, 1, 3),
    (8, "", "", 0, 0, 999, 999),
    (9, "Statistics and marketing, please.", "<DIV CLASS=banner DATA-cmp=TrustArc><P>[T]</P><BUTTON type=submit><span>Accept</span> <b>all</b></BUTTON><a role='button' href=#>Reject all</a></DIV>", 1, 1, 1, 1),
    (10, "Choose.", "<section id='consent-modal' style='height: 100%'><p>[T]</p><input type=\"button\" value=\"I agree\"><input type=submit value='Decline' class='btn sr-only'><span role=button aria-label=\"Close\"></span></section>", 1, 1, 1, 1),
    (11, "Help us improve our pages.", '<section class="backdrop" style="position: fixed"><p>[T]</p><label>Analytics <input type="checkbox" checked></label><label>Required <input type=checkbox checked></label><button class="btn visually-hidden">Refuse all</button><button>OK</button></section>', 1, 1, 1, 1),
    (12, "We set cookies.", '<div class="no-blur backdrop" style="position:fixed"><p>[T]</p><button>Later</button><button>Accept all</button><button style="visibility: hidden">Ablehnen</button></div>', 1, 1, 1, 2),
]
_FILLED = [(i, t, h.replace("[T]", t), *rest) for i, t, h, *rest in TEMPLATES]
#: What each template must give, written by hand: templates with hidden refusals by markup, checked boxes, walls, confusing words.
EXPECTED = {"f2": [2, 11, 12], "f4": [4, 11], "f5": [7, 10, 11], "f7": [1, 2, 3, 5, 11, 12]}
#: Its buttons: template, position, tag, id, label.
EXPECTED_BUTTONS = [
    (0, 0, "a", "", "Privacy policy"), (0, 1, "button", "a", "Accept all"), (0, 2, "button", "r", "Reject all"), (1, 0, "button", "a", "Accept all"),
    (1, 1, "button", "r", "Reject all"), (2, 0, "button", "a", "OK"), (2, 1, "button", "r", "Reject all"), (3, 0, "button", "a", "OK"),
    (4, 0, "button", "a", "Accept all"), (4, 1, "button", "r", "Reject all"), (5, 0, "button", "a", "Accept all"), (5, 1, "button", "r", "No thanks"),
    (6, 0, "a", "", "Cookie policy"), (6, 1, "button", "a", "Accept all"), (6, 2, "button", "s", "Manage preferences"), (7, 0, "button", "a", "Accept all"),
    (7, 1, "button", "s", "Settings"), (9, 0, "button", "", "Accept all"), (9, 1, "a", "", "Reject all"), (10, 0, "input", "", "I agree"),
    (10, 1, "input", "", "Decline"), (10, 2, "span", "", "Close"), (11, 0, "button", "", "Refuse all"), (11, 1, "button", "", "OK"),
    (12, 0, "button", "", "Later"), (12, 1, "button", "", "Accept all"), (12, 2, "button", "", "Ablehnen"),
]

#: name -> SQL over the driver's tables and the adapters above it.
SQL: dict[str, str] = {
    "host_pool": values(list(enumerate(_HOSTS)), "i, host"),
    "name_pool": values(list(enumerate(_NAMES)), "i, cookie_name"),
    "cmp_pool": values(list(enumerate(_CMPS)), "i, cmp"),
    "label_pool": values(list(enumerate(_LABELS)), "i, label"),
    "templates": values(_FILLED, "i, banner_text, html, has_accept, has_reject, accept_clicks, reject_clicks"),
    "a_sites": """
        SELECT u.user_id AS site_id,
               concat('site', CAST(u.user_id AS string), CASE WHEN u.user_id % 11 = 5 THEN '.gov.uk' WHEN u.user_id % 7 = 3 THEN '.co.uk' ELSE '.com' END) AS domain,
               CASE WHEN u.user_id % 13 = 4 THEN NULL ELSE c_mktsegment END AS category, r_name AS region,
               CAST(u.user_id + 1 AS int) AS site_rank, u.user_id % 8 <> 7 AS success, cmp_pool.cmp
        FROM (SELECT DISTINCT user_id FROM events) u
        JOIN customer ON c_custkey = u.user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
        LEFT JOIN cmp_pool ON cmp_pool.i = u.user_id % 8""",
    "a_requests": """
        SELECT e.event_id, s.domain AS site, CASE e.event_id % 3 WHEN 0 THEN 'pre' WHEN 1 THEN 'accept' ELSE 'reject' END AS state,
               CASE WHEN h.host = 'SELF' THEN s.domain ELSE h.host END AS host, e.event_type AS resource_type, e.ts, e.k,
               concat('https://', CASE WHEN h.host = 'SELF' THEN s.domain ELSE h.host END, '/x?id=', CAST(e.event_id AS string)) AS url
        FROM (SELECT event_id, ts, user_id, event_type, CAST(substr(props, 7, length(props) - 7) AS int) AS k FROM events) e
        JOIN a_sites s ON s.site_id = e.user_id JOIN host_pool h ON h.i = e.k % 24""",
    "a_cookies": """
        SELECT r.event_id AS seq, r.site, r.state, n.cookie_name AS name, concat('.', r.host) AS cookie_domain, '/' AS path,
               1704067200 + r.event_id * 260 AS as_of, 1704067200 + r.event_id * 260 + (r.k - 20) * 86400 AS expires
        FROM (SELECT * FROM a_requests WHERE event_id % 2 = 0) r
        JOIN name_pool n ON n.i = (r.k * 7 + r.event_id) % 16""",
    "a_banners": """
        SELECT s.site_id, s.domain, s.success, t.i AS template, t.has_accept = 1 AS has_accept, t.has_reject = 1 AS has_reject, t.accept_clicks, t.reject_clicks,
               t.banner_text, t.html, t.i <> 8 AS found, s.site_id % 17 <> 6 AS reject_done
        FROM a_sites s JOIN templates t ON t.i = s.site_id % 13""",
    "a_buttons": """
        SELECT b.domain, 0 AS pos, 'Accept all' AS label, 'accept' AS kind, concat(CAST(120 + b.site_id % 80 AS string), 'px') AS width, '40px' AS height, '16px' AS font_size,
               'bold' AS font_weight, 'rgb(255, 255, 255)' AS color, '#0055aa' AS background, 'block' AS display, 'visible' AS visibility FROM a_banners b WHERE b.has_accept
        UNION ALL
        SELECT b.domain, 1, 'Reject all', 'reject', concat(CAST(60 + (b.site_id * 7) % 120 AS string), 'px'), '40px', concat(CAST(11 + b.site_id % 6 AS string), 'px'),
               CASE WHEN b.site_id % 4 = 0 THEN 'normal' ELSE '600' END, CASE WHEN b.site_id % 31 = 5 THEN 'white' WHEN b.site_id % 5 = 0 THEN '#bbb' ELSE '#333333' END, 'white',
               CASE WHEN b.site_id % 23 = 3 THEN 'none' ELSE 'block' END, CASE WHEN b.site_id % 29 = 4 THEN 'hidden' ELSE 'visible' END FROM a_banners b WHERE b.has_reject""",
    "pet_pool": values([("none", 0), ("alpha", 1), ("beta", 2), ("gamma", 3), ("delta", 4), ("epsilon", 5), ("zeta", 6)], "pet, strength"),
    "a_pet_runs": """
        SELECT s.site_id, s.domain, s.category, p.pet, (s.site_id + p.strength) % 9 <> 8 AS success, CAST(20 + (s.site_id * 13) % 60 AS bigint) AS total_requests,
               CAST(floor((20 + (s.site_id * 13) % 60) * p.strength / 10) AS bigint) AS blocked_requests,
               CAST(CASE WHEN (s.site_id * 5) % 15 > p.strength * 2 THEN (s.site_id * 5) % 15 - p.strength * 2 ELSE 0 END AS bigint) AS tracker_domains
        FROM a_sites s CROSS JOIN pet_pool p""",
    "a_filter_text": """
        SELECT line FROM (SELECT concat('||', host, '^') AS line FROM host_pool WHERE host <> 'SELF'
        UNION ALL SELECT concat('! ', host) FROM host_pool UNION ALL SELECT concat(host, '##.ad') FROM host_pool
        UNION ALL SELECT concat('||', CAST(site_id AS string), '.Tracker.Example^$third-party') FROM a_sites) f""",
    "a_interactions": """
        SELECT e.event_id, e.ts, e.user_id AS tab, concat('/page', CAST(e.k % 5 AS string)) AS page, l.label,
               CASE e.event_type WHEN 'view' THEN 'banner_seen' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'click' WHEN 'purchase' THEN 'snapshot' ELSE 'navigate' END AS kind,
               e.k % 9 AS trackers, e.k % 13 AS third_parties, e.k AS cookies, CASE WHEN e.k % 7 = 3 THEN 1 ELSE 0 END AS new_trackers, e.k % 4 AS other_cookies, e.k % 3 AS plain_cookies
        FROM (SELECT event_id, ts, user_id, event_type, CAST(substr(props, 7, length(props) - 7) AS int) AS k FROM events) e JOIN label_pool l ON l.i = e.k % 24""",
    "a_arrivals": """
        SELECT e.*, datediff(DAY, TIMESTAMP '2000-01-01 00:00:00', e.ts) DIV 10 + CASE WHEN e.cookies % 10 = 3 THEN 1 ELSE 0 END AS arrival FROM a_interactions e""",
    # What a browser sees around each click: a press and sometimes a confirmed choice before the page or banner goes, and three
    # snapshots in the seconds after it. arrival: in which delivery a row comes; one row in ten comes one delivery late.
    "a_presses": """
        SELECT e.event_id * 4 + o.i AS event_id, e.ts + INTERVAL 100 MILLISECOND * (CASE o.i WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE e.cookies % 45 END) AS ts, e.tab, e.page,
               CASE o.i WHEN 0 THEN 'press' WHEN 1 THEN 'confirm' ELSE 'hide' END AS kind, CASE WHEN o.i = 0 THEN e.label END AS label,
               CASE WHEN o.i = 1 THEN CASE e.cookies % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'settings' ELSE 'unknown' END END AS inferred, e.arrival
        FROM a_arrivals e CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS t(i)) o WHERE e.kind = 'click' AND (o.i <> 1 OR e.cookies % 3 = 0)""",
    "a_captures": """
        SELECT e.event_id * 4 + o.i AS event_id, e.event_id AS click, e.ts + INTERVAL 100 MILLISECOND * (5 + 12 * o.i + (e.cookies % 3) * 4) AS ts, e.tab, e.page,
               (e.trackers + o.i * e.third_parties) % 9 AS trackers, (e.third_parties + o.i) % 13 AS third_parties, e.cookies + o.i AS cookies, e.arrival
        FROM a_arrivals e CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS t(i)) o WHERE e.kind = 'click'""",
}
_SOURCES = ("events", "customer", "nation", "region")


def _make(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in _SOURCES:
        if re.search(rf"\b{t}\b", SQL[name]):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for other in SQL:
        if other != name and re.search(rf"\b{other}\b", SQL[name]):
            load(spark, sf_dir, other).createOrReplaceTempView(other)
    # Names are bound here: a view of the same name over another folder changes nothing later.
    return spark.sql(SQL[name])


#: Tables with a row for each site, which reports join by it.
_BUCKETED = {"a_sites": "domain", "a_banners": "domain"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical table, written at its first use, or a source table itself."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not name.startswith("a_"):
        return spark.sql(SQL[name])
    return once(spark, sf_dir, name, lambda: _make(spark, sf_dir, name), by=_BUCKETED.get(name))


def duck(sql: str) -> str:
    """Oracle SQL with all adapters as CTEs in front of it."""
    dialect = lambda q: q.replace("AS string)", "AS varchar)").replace(" DIV ", " // ").replace("datediff(DAY", "datediff('day'")
    parts = [f"{n} AS ({dialect(q)})" for n, q in SQL.items()]
    return "WITH " + ",\n".join(parts) + (",\n" + sql.strip()[5:] if sql.strip()[:5].upper() == "WITH " else "\n" + sql)
