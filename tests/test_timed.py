"""Timers, interval joins and late rows on streams: rows out of order over several triggers give what the batch forms give."""

import random

import pytest
from pyspark.sql import functions as F

from crumbtrail.operators import studies
from crumbtrail.streaming import audit, timed

EVENT = "event_id long, us long, tab long, page string, kind string, action string"


def table(spark, rows, schema=EVENT):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us")).drop("us")


def stream(spark, df, path, parts):
    """df in deliveries by a column of numbers."""
    timed.delivered(df, str(path), parts)
    return audit.read_events(spark, str(path), df.drop(parts).schema)


@pytest.fixture(scope="module")
def events(spark):
    """Events of three tabs a second or so apart, that arrive shuffled within a minute, over several triggers."""
    pick = random.Random(4)
    rows, us = [], 1_700_000_000_000_000
    for i in range(400):
        us += pick.choice([0, 300_000, 900_000, 2_600_000, 40_000_000])
        kind = pick.choice(["banner_seen", "click", "press", "press", "confirm", "hide", "other"])
        action = pick.choice(["accept", "reject", "settings", "unknown", None])
        rows.append((i, us + pick.randrange(999), i % 3, pick.choice("pq"), kind, action, (us - 1_700_000_000_000_000) // 60_000_000 // 20 + pick.choice([0, 0, 1])))
    return table(spark, rows, EVENT + ", part long").select("event_id", "ts", "tab", "page", "kind", "action", "part")


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect()))


def test_armed_equals_batch(spark, events, tmp_path):
    done = audit.run_to_table(timed.armed(stream(spark, events, tmp_path / "in", "part"), timeout=30.0, delay="45 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = studies.armed_outcomes(events, timeout=30.0)
    assert same(done, batch) and {r.status for r in batch.collect()} == {"completed", "cleared"}


def test_sessions_equal_batch(spark, events, tmp_path):
    done = audit.run_to_table(timed.sessions(stream(spark, events, tmp_path / "in", "part"), idle=5.0, delay="45 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = studies.sessions(events, gap="5 seconds").drop("session")
    assert same(done.drop("page"), batch) and done.agg(F.max("n")).first()[0] > 2


def test_pending_equals_batch(spark, events, tmp_path):
    done = audit.run_to_table(timed.pending(stream(spark, events, tmp_path / "in", "part"), delay="45 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = studies.promotions(events)
    assert same(done, batch) and {r.source for r in batch.collect()} == {"confirm", "press", None}


def test_what_is_promoted(spark, tmp_path):
    """A choice confirmed counts before a button pressed, also if the press is later; both are forgotten; 2.5 seconds still count."""
    s = 1_000_000
    rows = [
        (1, 10 * s, 1, "p", "confirm", "reject"), (2, 11 * s, 1, "p", "press", "accept"), (3, 12 * s, 1, "p", "hide", None),  # the choice
        (4, 12 * s + 9, 1, "p", "hide", None),  # nothing left
        (5, 20 * s, 1, "p", "confirm", "reject"), (6, 22 * s, 1, "p", "press", "accept"), (7, 22 * s + 500_001, 1, "p", "hide", None),  # the choice is too old
        (8, 30 * s, 1, "p", "press", "accept"), (9, 30 * s + 1, 1, "p", "press", "settings"), (10, 32 * s + 500_000, 1, "p", "hide", None),
        (11, 40 * s, 1, "p", "press", "accept"), (12, 42 * s + 500_001, 1, "p", "hide", None),
        (13, 50 * s, 1, "p", "confirm", None), (14, 51 * s, 1, "p", "hide", None), (15, 52 * s, 2, "p", "hide", None),
    ]
    df = table(spark, rows).withColumn("part", F.col("event_id") % 2)
    want = {3: (1, "confirm", "reject"), 4: (None, None, None), 7: (6, "press", "accept"), 10: (8, "press", "accept"), 12: (None, None, None), 14: (13, "confirm", "unknown"), 15: (None, None, None)}
    done = audit.run_to_table(timed.pending(stream(spark, df, tmp_path / "in", "part")), str(tmp_path / "out"), str(tmp_path / "cp"))
    for got in (studies.promotions(df), done):
        assert {r.event_id: (r.source_id, r.source, r.action) for r in got.collect()} == want


def test_the_richest_capture_is_kept(spark, tmp_path):
    """Three captures half a second, one and a half and three seconds after the click: the last has most trackers; one more comes too late."""
    s = 1_000_000
    clicks = table(spark, [(1, 100 * s, 9, "p", "click", None)]).withColumn("part", F.lit(0))
    shots = [(10, 100 * s + 500_000, 0, 0, 1), (11, 101 * s + 500_000, 0, 1, 3), (12, 103 * s, 1, 2, 4), (13, 103 * s + 1000, 9, 9, 9)]
    made = spark.createDataFrame(shots, "event_id long, us long, trackers long, third_parties long, cookies long")
    made = made.withColumns({"ts": F.timestamp_micros("us"), "tab": F.lit(9).cast("long"), "page": F.lit("p"), "kind": F.lit("snapshot"), "part": F.col("event_id") % 2}).drop("us")
    a = stream(spark, clicks, tmp_path / "a", "part").select(F.col("event_id").alias("click"), F.col("ts").alias("at"), "tab", "page")
    done = audit.run_to_table(timed.captured(a, stream(spark, made, tmp_path / "b", "part")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r.click, r.captures, r.event_id, r.trackers, r.third_parties, r.cookies) for r in done.collect()] == [(1, 3, 12, 1, 2, 4)]


def test_late_rows_are_set_aside(spark, events, tmp_path):
    rows = stream(spark, events, tmp_path / "in", "part")
    kept, late = timed.split_late(rows, str(tmp_path / "kept"), str(tmp_path / "late"), str(tmp_path / "cp"), 60)
    ids = lambda df: [r.event_id for r in df.where(F.col("kind") != timed.END).collect()]
    assert sorted(ids(kept) + ids(late)) == list(range(400))
    latest, want = 0, set()
    for part in sorted({r.part for r in events.collect()}):
        own = [(r.event_id, int(r.ts.timestamp() * 1000)) for r in events.where(F.col("part") == part).collect()]
        want |= {i for i, ms in own if latest and ms < latest - 60_000}
        latest = max([latest, *[ms for _, ms in own]])
    assert set(ids(late)) == want and 20 < len(want) < 380


def test_ingest_reads_its_deliveries_only(spark, tmp_path):
    """Each trigger reads its delivery, however much the table holds, and the state knows all keys."""
    for i in range(4):
        spark.range(i * 500, i * 500 + 1000).select(F.col("id").alias("k"), F.lit(i).alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = audit.read_events(spark, str(tmp_path / "in"), "k long, v int")
    done = audit.ingest(rows, str(tmp_path / "out"), str(tmp_path / "cp"), "k")
    assert done.count() == done.select("k").distinct().count() == 2500
    assert done.groupBy("v").count().orderBy("v").collect() == [(0, 1000), (1, 500), (2, 500), (3, 500)]
    timed.use_rocksdb(spark)
    q = rows.dropDuplicates(["k"]).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [p.numInputRows for p in q.recentProgress if p.numInputRows] == [1000] * 4


def test_deliveries_are_made_from_one_pass(spark, events, tmp_path):
    """Whatever the number of deliveries, the input is evaluated once."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    timed.delivered(events.mapInPandas(note, events.schema), str(tmp_path / "in"), "part")
    assert seen.value == 400 and events.select("part").distinct().count() > 2
    assert spark.read.parquet(str(tmp_path / "in")).where(F.col("kind") != timed.END).count() == 400


def test_keys_share_state(spark, tmp_path):
    """Many keys, null ones too, are kept in as many groups as there are buckets, in few partitions, and give what the batch form gives."""
    s = 1_000_000
    rows = [(i, 1_700_000_000 * s + (i // 200) * 20 * s + i, i % 100 if i % 7 else None, "pq"[i % 2], ["banner_seen", "click", "other"][i % 3], None) for i in range(600)]
    df = table(spark, rows).withColumn("part", F.lit(0))
    given = spark.conf.get("spark.sql.shuffle.partitions")
    watched = timed.armed(stream(spark, df, tmp_path / "in", "part"), timeout=30.0, buckets=3)
    with timed.few_state_partitions(spark):
        q = watched.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == given
    # For each bucket and the closing row: an entry of waiting rows or of open ones, and a timer with its index.
    assert max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) < 40
    done = spark.read.schema(watched.schema).parquet(str(tmp_path / "out"))
    batch = studies.armed_outcomes(df.drop("part"), timeout=30.0)
    known = F.col("tab").isNotNull()
    assert same(done.where(known), batch.where(known)) and done.where(~known).count() == sum(r[2] is None and r[4] == "banner_seen" for r in rows)
