"""Streams against their batch forms, with rows out of order."""

from pyspark.sql import functions as F

from crumbtrail.streaming import audit


def events(spark, path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, t int, tab long, page string, label string, kind string").withColumn("ts", F.timestamp_seconds("t"))
        df.select("event_id", "ts", "tab", "page", "label", "kind").coalesce(1).write.mode("append").parquet(str(path / f"b{i}"))
    return spark.readStream.schema(audit.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(path / "b*"))


def test_sessions(spark, tmp_path):
    rows = [[(1, 20, 1, "p", "", "click"), (0, 10, 1, "p", "", "banner_seen"), (2, 30, 1, "q", "", "navigate")], [(3, 5000, 1, "q", "", "click"), (4, 90000, 2, "z", "", "navigate")], [(5, 200000, 3, "z", "", "navigate")]]
    done = audit.run_to_table(audit.sessions(events(spark, tmp_path / "in", rows)), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.tab, r.first_event): (r.page, r.n, r.clicks, r.armed, r.completed) for r in done.collect()}
    assert got[(1, 0)] == ("p", 2, 1, True, True)
    assert got[(1, 2)][:3] == ("q", 1, 0)
    assert got[(1, 3)][:3] == ("q", 1, 1)


def test_sessions_over_triggers(spark, tmp_path):
    """A tab's session goes on over files, as one; marks of the end close all."""
    rows = [[(i, 1000 + i * 100, 1, "p" if i < 7 else "q", "", "click" if i % 3 else "banner_seen") for i in range(k, k + 4)] for k in (0, 4, 8)]
    flat = [r for part in rows for r in part]
    rows.append([(-1, 10**7, 1, "", "", audit.END)])
    done = audit.run_to_table(audit.sessions(events(spark, tmp_path / "in", rows)), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    got = {r.first_event: (r.page, r.n, r.clicks, r.armed) for r in done}
    assert got == {0: ("p", 7, sum(r[5] == "click" for r in flat[:7]), True), 7: ("q", 5, sum(r[5] == "click" for r in flat[7:]), True)}


def test_rates_equal_batch(spark, tmp_path):
    rows = [[(i, i * 600, 1, "p", "", "click" if i % 2 else "navigate") for i in range(k, 40, 2)] for k in (0, 1)]
    frames = [spark.createDataFrame(r, "event_id long, t int, tab long, page string, label string, kind string") for r in rows]
    all_rows = frames[0].union(frames[1]).withColumn("ts", F.timestamp_seconds("t")).drop("t")
    audit.ended(all_rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(audit.EVENTS).parquet(str(tmp_path / "in"))
    done = audit.run_to_table(audit.rates(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = all_rows.groupBy(F.window("ts", "1 hour").start.alias("start"), "kind").agg(F.count("*").alias("n"))
    assert done.count() == 14 and sorted(map(tuple, done.collect())) == sorted(map(tuple, batch.collect()))


def test_learned_once(spark, tmp_path):
    rows = [[("t.tracker.com", "a.com"), ("u.tracker.com", "a.com"), ("b.com", "b.com"), ("x.few.org", "a.com")], [("tracker.com", "b.com"), ("x.few.org", "b.com")], [("tracker.com", "c.com"), ("tracker.com", "d.com")], [("tracker.com", "e.com")]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "host string, site string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema("host string, site string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b*"))
    done = audit.run_to_table(audit.learned_trackers(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r.domain, r.first_parties) for r in done.collect()] == [("tracker.com", 3)]


def test_ingest_takes_up_each_key_once(spark, tmp_path):
    take = lambda: audit.ingest(spark.readStream.schema("k string, v int").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "k")
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int").write.parquet(str(tmp_path / "in"))
    take()
    spark.createDataFrame([("b", 2), ("c", 2), ("c", 2)], "k string, v int").write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted((r.k, r.v) for r in take().collect()) == [("a", 1), ("b", 1), ("c", 2)]
