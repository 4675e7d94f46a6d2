"""Queries of the interaction audit as a stream: deliveries come one by one, rows out of order, and each result equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from crumbtrail.operators import classify, studies
from crumbtrail.plans import queries as Q
from crumbtrail.plans.adapters import duck, load
from crumbtrail.plans.queries import query
from crumbtrail.plans.store import new_folder
from crumbtrail.streaming import audit, timed

#: Deliveries hold ten days each, and a row may come one delivery late.
_DELAY = "21 days"


def _deliver(s, events, arrival="arrival"):
    """The table as a stream of one file for each delivery, in order, and the folder of its results."""
    path = new_folder(s, "live")
    timed.delivered(events.withColumn("ts", F.col("ts").cast("timestamp")), f"{path}/in", arrival)
    stream = audit.read_events(s, f"{path}/in", s.read.parquet(f"{path}/in").schema)
    return stream, path


_ARMED = """WITH e AS (SELECT * FROM a_interactions WHERE kind IN ('click', 'banner_seen')),
  n AS (SELECT b.event_id, b.tab, b.page, b.ts, min({'t': c.ts, 'e': c.event_id}) AS c FROM e b LEFT JOIN e c ON c.kind = 'click' AND c.tab = b.tab AND c.page = b.page AND (c.ts, c.event_id) > (b.ts, b.event_id)
    WHERE b.kind = 'banner_seen' GROUP BY ALL)
  SELECT event_id, tab, page, CASE WHEN c.t - ts <= INTERVAL 12 HOURS THEN c.e END AS click, CASE WHEN c.t - ts <= INTERVAL 12 HOURS THEN 'completed' ELSE 'cleared' END AS status FROM n"""


@query(duck(_ARMED))
def armed_stream(s, d):
    """Watches that banners arm, with timers of event time; the events are hours apart, so the timeout is twelve hours."""
    stream, path = _deliver(s, load(s, d, "a_arrivals").select("event_id", "ts", "tab", "page", "kind", "arrival"))
    return audit.run_to_table(timed.armed(stream, timeout=12 * 3600.0, delay=_DELAY), f"{path}/out", f"{path}/cp")


@query(duck("""WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 10 MINUTES OR lag(page) OVER w <> page THEN 1 ELSE 0 END AS new FROM a_interactions WINDOW w AS (PARTITION BY tab ORDER BY ts, event_id)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY tab ORDER BY ts, event_id) AS session FROM m)
  SELECT tab, any_value(page) AS page, min(event_id) AS first_event, count(*) AS n, count(*) FILTER (kind = 'click') AS clicks, bool_or(kind = 'banner_seen') AS armed FROM n GROUP BY tab, session"""))
def ordered_session_stream(s, d):
    """Sessions of a stream whose rows come out of order."""
    stream, path = _deliver(s, load(s, d, "a_arrivals").select("event_id", "ts", "tab", "page", "kind", "arrival"))
    return audit.run_to_table(timed.sessions(stream, delay=_DELAY), f"{path}/out", f"{path}/cp")


_SHOTS = """WITH m AS (SELECT c.event_id AS click, s.event_id, s.trackers, s.third_parties, s.cookies, count(*) OVER (PARTITION BY c.event_id) AS captures,
    row_number() OVER (PARTITION BY c.event_id ORDER BY 100 * s.trackers + 10 * s.third_parties + s.cookies DESC, s.ts DESC, s.event_id DESC) AS r
  FROM a_interactions c JOIN a_captures s ON s.tab = c.tab AND s.page = c.page AND s.ts >= c.ts AND s.ts <= c.ts + INTERVAL 3 SECONDS WHERE c.kind = 'click')
  SELECT click, captures, event_id, trackers, third_parties, cookies FROM m WHERE r = 1"""


@query(duck(_SHOTS))
def capture_stream(s, d):
    """The richest snapshot in the three seconds after each click: two streams joined by an interval of time."""
    clicks, path = _deliver(s, load(s, d, "a_arrivals").where("kind = 'click'").select("event_id", "ts", "tab", "page", "kind", "arrival"))
    shots, _ = _deliver(s, load(s, d, "a_captures").select("event_id", "ts", "tab", "page", "trackers", "third_parties", "cookies", F.lit("snapshot").alias("kind"), "arrival"))
    done = timed.captured(clicks.select(F.col("event_id").alias("click"), F.col("ts").alias("at"), "tab", "page"), shots, delay=_DELAY)
    return audit.run_to_table(done, f"{path}/out", f"{path}/cp")


@query(duck(_SHOTS))
def captures_in_seconds(s, d):
    """The same from tables: clicks and snapshots meet in slots of time."""
    shots = load(s, d, "a_captures").withColumn("kind", F.lit("snapshot"))
    clicks = load(s, d, "a_interactions").where("kind = 'click'")
    return studies.captures_after(clicks.unionByName(shots, allowMissingColumns=True))


_PROMOTED = f"""WITH {Q._ACTED}, p AS (SELECT p.*, coalesce(inferred, does.action) AS action FROM a_presses p LEFT JOIN does ON does.label = p.label),
  h AS (SELECT *, lag(ts) OVER w AS ht, lag(event_id) OVER w AS he FROM p WHERE kind = 'hide' WINDOW w AS (PARTITION BY tab, page ORDER BY ts, event_id)),
  m AS (SELECT h.event_id, x.event_id AS source_id, x.kind AS source, x.action, row_number() OVER (PARTITION BY h.event_id ORDER BY x.kind, x.ts DESC, x.event_id DESC) AS r
    FROM h JOIN p x ON x.tab = h.tab AND x.page = h.page AND (x.ts, x.event_id) < (h.ts, h.event_id) AND (h.ht IS NULL OR (x.ts, x.event_id) > (h.ht, h.he)) AND h.ts - x.ts <= INTERVAL 2500 MILLISECONDS
    WHERE x.kind = 'confirm' OR (x.kind = 'press' AND x.action NOT IN ('settings', 'unknown')))
  SELECT h.tab, h.page, h.event_id, source_id, source, m.action FROM h LEFT JOIN m ON m.event_id = h.event_id AND r = 1"""


def _presses(s, d):
    """Presses by what their labels do, with confirmed choices and hidden pages."""
    rows = load(s, d, "a_presses")
    actions = classify.classify_interactions(rows.where("label IS NOT NULL"), Q._vocabulary(s))
    return rows.join(actions, "label", "left").select("event_id", "ts", "tab", "page", "kind", F.coalesce("inferred", "action").alias("action"), "arrival")


@query(duck(_PROMOTED))
def pending_promotions(s, d):
    """The action that each hidden page or banner makes believed: a choice just confirmed, or else a button just pressed."""
    return studies.promotions(_presses(s, d))


@query(duck(_PROMOTED))
def pending_stream(s, d):
    """The same as a stream, with timers that forget what is pending after 2.5 seconds."""
    stream, path = _deliver(s, _presses(s, d))
    return audit.run_to_table(timed.pending(stream, delay=_DELAY), f"{path}/out", f"{path}/cp")


@query(duck("""WITH m AS (SELECT arrival, max(epoch_us(ts)) // 1000 AS top FROM a_arrivals GROUP BY arrival), b AS (SELECT a.arrival, max(m.top) - 86400000 AS least FROM (SELECT DISTINCT arrival FROM a_arrivals) a LEFT JOIN m ON m.arrival < a.arrival GROUP BY a.arrival)
  SELECT event_id, tab, kind, coalesce(epoch_us(ts) // 1000 < least, false) AS late FROM a_arrivals JOIN b USING (arrival)"""))
def late_rows(s, d):
    """Every row either in time or in the side table of late ones: more than a day behind the latest of earlier deliveries."""
    stream, path = _deliver(s, load(s, d, "a_arrivals").select("event_id", "ts", "tab", "kind", "arrival"))
    kept, late = timed.split_late(stream, f"{path}/kept", f"{path}/late", f"{path}/cp", 86400)
    both = kept.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.where(F.col("kind") != timed.END).select("event_id", "tab", "kind", "late")
