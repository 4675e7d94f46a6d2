"""The interaction audit in order of event time: watches that time out, actions believed when a banner goes, captures in the
seconds after a click, and rows that come too late.

Rows of a stream come in any order. What depends on their order is kept in state until the watermark has passed it; a timer
of event time then hands it on, sorted. State is what came within the watermark's delay and what is still open, in RocksDB, so
it does not grow with a tab's history. Keys are dealt to buckets, whose rows are folded together, so the cost is of rows and not of keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from crumbtrail.plans.store import new_folder

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The kind of the one row that only moves the watermark, see closing().
END = "end"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and large state need, with changelogs in place of whole snapshots."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


@contextmanager
def few_state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in about two partitions a core. Each partition costs a Python worker and state
    stores in every trigger, whatever it holds, and rows go to buckets of bounded size within it."""
    name = "spark.sql.shuffle.partitions"
    given = spark.conf.get(name)
    # A stream copies the settings when it starts.
    spark.conf.set(name, str(min(int(given), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, given)


def closing(events: DataFrame, after: str = "400 days") -> DataFrame:
    """One row of kind END long after the last of events: as the last of a stream that is known to be complete, it lets every
    timer and window of the others end. Other columns but page are null; keys are not, as joins filter out null keys before they
    see the time."""
    row = {"page": F.lit(""), "ts": F.col("last_") + F.expr(f"INTERVAL {after}"), "tab": F.lit(-1).cast("long"), "kind": F.lit(END)}
    last = events.agg(F.max("ts").alias("last_"))
    return last.select(*[row.get(c, F.lit(None)).cast(events.schema[c].dataType).alias(c) for c in events.columns])


def delivered(events: DataFrame, path: str, arrival: str) -> None:
    """Writes events as files that come one after the other, one for each value of the column arrival (which is left out), and
    closing rows last. For input of a known, small number of deliveries."""
    # One pass lays the rows out by delivery; each file is then made from its own rows alone.
    laid = new_folder(events.sparkSession, "deliveries")
    events.write.partitionBy(arrival).parquet(laid)
    events = events.sparkSession.read.schema(events.schema).parquet(laid).select(*events.columns)
    for (n,) in sorted(events.select(arrival).distinct().collect()):
        events.where(F.col(arrival) == n).drop(arrival).coalesce(1).write.mode("append").parquet(path)
    # Twice: what one operator lets go of when the first comes, the next one lets go of at the second.
    for after in ("400 days", "800 days"):
        closing(events.drop(arrival), after).coalesce(1).write.mode("append").parquet(path)


def _us(ts: pd.Series) -> pd.Series:
    return ts.dt.tz_localize(None).astype("datetime64[us]").astype("int64") if getattr(ts.dt, "tz", None) else ts.astype("datetime64[us]").astype("int64")


def _packed(rows: pd.DataFrame) -> list[tuple[bytes]]:
    """Rows as entries of a list state, of bounded size each."""
    out = []
    for i in range(0, len(rows), 1 << 16):
        batch, sink = pa.RecordBatch.from_pandas(rows.iloc[i : i + (1 << 16)], preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(entries: Iterator[tuple[bytes]]) -> pd.DataFrame | None:
    frames = [pa.ipc.open_stream(x).read_pandas() for (x,) in entries]
    return pd.concat(frames, ignore_index=True) if frames else None


class _InOrder(StatefulProcessor):
    """Keeps rows (keys, event_id, us, kind, value) until the watermark has passed them, then folds them in order of time and id.

    A group is a bucket of many keys, so that state and timers are touched once for the bucket and not for each key. A subclass
    folds all of a bucket's keys at once: ``fold(rows, now)`` gets what was open and what is due, sorted by ``own`` (the number
    of a key), time and id, and returns the rows of the result and what is open still; ``deadline`` is how many microseconds an
    open row may last.
    """

    deadline = 0
    keys = ["tab", "page"]
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getListState("open", "rows binary")
        self.timer = handle.getValueState("timer", "ms long")

    def fold(self, rows: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        raise NotImplementedError

    def fresh(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows as they come, in the form of open ones."""
        return rows

    def _wake(self, us: int) -> None:
        """The one timer of the bucket: for the first of what is next."""
        ms = us // 1000 + 1
        if self.timer.exists():
            (known,) = self.timer.get()
            if known <= ms:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            # Batch by batch: a trigger's rows of one bucket are never one frame.
            us = _us(pdf["ts"])
            self.waiting.appendList(_packed(pdf[[*self.keys, "event_id", "kind", "value"]].assign(us=us)))
            first = int(us.min()) if first is None else min(first, int(us.min()))
        if first is not None:
            self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed is there, not only what this timer stands for.
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        self.timer.clear()
        rows, open_ = (_unpacked(x.get()) if x.exists() else None for x in (self.waiting, self.open))
        ahead, parts = [], [] if open_ is None else [open_.assign(fresh=False)]
        if rows is not None:
            due = rows["us"] < now
            parts.append(self.fresh(rows[due]).assign(fresh=True))
            self._keep(self.waiting, rows[~due])
            ahead += rows.loc[~due, "us"].tolist()
        if parts:
            all_ = pd.concat([x for x in parts if len(x)] or parts[:1], ignore_index=True)
            own = all_.groupby(self.keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.lexsort((all_["event_id"], all_["fresh"], all_["us"], own))
            out, left = self.fold(all_.assign(own=own).iloc[order].reset_index(drop=True), now)
            self._keep(self.open, left.drop(columns=["own", "fresh"]))
            ahead += (left["us"] + self.deadline).tolist()
            if len(out):
                yield out[self.columns]
        # For a row to fold, or an open one at its deadline, whether or not anything else comes.
        if ahead:
            self._wake(int(min(ahead)))

    @staticmethod
    def _keep(state, rows: pd.DataFrame) -> None:
        state.put(_packed(rows)) if len(rows) else state.clear()

    def close(self) -> None:
        pass


def _last(flag: np.ndarray) -> np.ndarray:
    """The place of the last row up to each that is flagged, -1 without one."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1)) if len(flag) else np.zeros(0, np.int64)


def _taken(column: pd.Series, at: np.ndarray) -> np.ndarray:
    """The column's values at some places, null for negative ones."""
    return np.where(at >= 0, column.to_numpy(object)[at], None)


class _Armed(_InOrder):
    columns = ["tab", "page", "event_id", "click", "status"]

    def __init__(self, timeout_us: int) -> None:
        self.deadline = timeout_us

    def fresh(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[rows["kind"].isin(["banner_seen", "click"])]

    def fold(self, rows: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        own, us, n = rows["own"].to_numpy(), rows["us"].to_numpy(), len(rows)
        back = _last((rows["kind"] == "click").to_numpy()[::-1])[::-1]
        click = np.where(back >= 0, n - 1 - back, -1)
        click = np.where((click >= 0) & (own[click] == own), click, -1)
        done = (click >= 0) & (us[click] - us <= self.deadline)
        seen = (rows["kind"] == "banner_seen").to_numpy()
        ended = seen & (done | (click >= 0) | (now - us > self.deadline))
        out = rows[ended].assign(click=_taken(rows["event_id"], np.where(done, click, -1))[ended], status=np.where(done, "completed", "cleared")[ended])
        return out, rows[seen & ~ended]


#: What a session may be pending with, the one that is believed first in front (fixed values).
INFERRED, PRESSED = "confirm", "press"
_NEVER = ("settings", "unknown")


class _Pending(_InOrder):
    """What is open is the last press and the last confirmation of a choice, at most one of each."""

    columns = ["tab", "page", "event_id", "source_id", "source", "action"]

    def __init__(self, window_us: int) -> None:
        self.deadline = window_us

    def fresh(self, rows: pd.DataFrame) -> pd.DataFrame:
        value = rows["value"].where(rows["value"].notna() & (rows["value"] != ""), "unknown")
        decides = (rows["kind"] == INFERRED) | (rows["kind"] == PRESSED) & ~value.isin(_NEVER)
        return rows.assign(value=value)[decides | (rows["kind"] == "hide")]

    def fold(self, rows: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        own, us, kind = rows["own"].to_numpy(), rows["us"].to_numpy(), rows["kind"]
        hide = (kind == "hide").to_numpy()
        start = _last(np.r_[True, own[1:] != own[:-1]][: len(own)])
        # The hide before each row forgets what came before it.
        since = np.maximum(start, np.r_[-1, _last(hide)[:-1]][: len(own)] + 1)
        best, keep = np.full(len(own), -1), np.zeros(len(own), bool)
        end = np.r_[own[1:] != own[:-1], True][: len(own)]
        for name in (PRESSED, INFERRED):
            at = _last((kind == name).to_numpy())
            best = np.where((at >= since) & (us - us[at] <= self.deadline), at, best)
            open_ = at[end & ~hide & (at >= since)]
            keep[open_[now - us[open_] <= self.deadline]] = True
        best = best[hide]
        out = rows.loc[hide, ["tab", "page", "event_id"]]
        return out.assign(source_id=_taken(rows["event_id"], best), source=_taken(kind, best), action=_taken(rows["value"], best)), rows[keep]


class _Sessions(_InOrder):
    """What is open is one session of a tab: its first event, the time of its last one, its page and counts."""

    keys = ["tab"]
    columns = ["tab", "page", "first_event", "n", "clicks", "armed"]

    def __init__(self, idle_us: int) -> None:
        self.deadline = idle_us

    def fresh(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["kind"] != END]
        rows = rows.assign(first_event=rows["event_id"], n=1, clicks=(rows["kind"] == "click").astype("int64"), armed=rows["kind"] == "banner_seen")
        return rows.rename(columns={"value": "page"}).drop(columns="kind")

    def fold(self, rows: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        own, us, page = rows["own"].to_numpy(), rows["us"].to_numpy(), pd.factorize(rows["page"])[0]
        new = np.r_[True, (own[1:] != own[:-1]) | (page[1:] != page[:-1]) | (np.diff(us) > self.deadline)][: len(own)]
        number = np.cumsum(new)
        one = rows.groupby(number, sort=False)
        out = one[["tab", "own", "page", "fresh"]].head(1).set_axis(number[new])
        sums = one.agg(first_event=("first_event", "min"), us=("us", "max"), event_id=("event_id", "last"), n=("n", "sum"), clicks=("clicks", "sum"), armed=("armed", "max"))
        out = out.join(sums)
        last = np.r_[out["own"].to_numpy()[1:] != out["own"].to_numpy()[:-1], True][: len(out)]
        left = last & (now - out["us"].to_numpy() <= self.deadline)
        return out[~left], out[left]


class _Late(StatefulProcessor):
    """Marks rows that are behind the watermark. Needs no state."""

    def __init__(self, columns: list[str], delay_ms: int, kept_ms: int) -> None:
        self.columns, self.delay_ms, self.kept_ms = columns, delay_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The latest time of earlier triggers, less the delay; 0 in the first one.
        mark = timerValues.getCurrentWatermarkInMs()
        least = mark + self.kept_ms - self.delay_ms if mark > 0 else 0
        for pdf in rows:
            yield pdf[self.columns].assign(late=(_us(pdf["ts"]) // 1000) < least)

    def close(self) -> None:
        pass


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket_")


def _timed(events: DataFrame, processor: _InOrder, delay: str, value: str, out: str, buckets: int) -> DataFrame:
    use_rocksdb(events.sparkSession)
    # Keys as strings: null ones stay apart from others in every frame.
    rows = events.withWatermark("ts", delay).select(_bucket(processor.keys, buckets), *[F.col(k).cast("string") for k in processor.keys], "event_id", "ts", "kind", F.col(value).cast("string").alias("value"))
    done = rows.groupBy("bucket_").transformWithStateInPandas(processor, ", ".join(f"{k} string" for k in processor.keys) + f", {out}", "append", "EventTime")
    return done.withColumns({k: F.col(k).cast(events.schema[k].dataType) for k in processor.keys})


#: Groups that the keys of a stream are dealt to. What a task holds at once is what one of them receives within the delay, so a
#: stream with more rows in its delay needs more of them.
BUCKETS = 512


def sessions(events: DataFrame, idle: float = 600.0, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Runs of a tab's events on one page with no longer pause than idle, in order of time whatever the order of arrival: the same
    rows as studies.sessions."""
    out = "page string, first_event long, n long, clicks long, armed boolean"
    return _timed(events, _Sessions(int(idle * 1e6)), delay, "page", out, buckets)


def armed(events: DataFrame, timeout: float = 120.0, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """For each sight of a banner (event_id, ts, tab, page, kind): the click that completes the watch it armed, or that it was
    cleared after the timeout. The same rows as studies.armed_outcomes, whatever the order of arrival within the delay."""
    return _timed(events, _Armed(int(timeout * 1e6)), delay, "kind", "event_id long, click long, status string", buckets)


def pending(events: DataFrame, window: float = 2.5, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """For each hidden page or banner (kind ``hide``) the action that is believed because of it: the choice last confirmed
    within the window, or else the last press of a button that decides; null if neither. Both are forgotten then.
    events: event_id, ts, tab, page, kind, action."""
    return _timed(events, _Pending(int(window * 1e6)), delay, "action", "event_id long, source_id long, source string, action string", buckets)


def captured(clicks: DataFrame, shots: DataFrame, within: float = 3.0, delay: str = "10 minutes") -> DataFrame:
    """The richest of the snapshots in the seconds after each click, as an interval join of two streams.

    clicks: click, at, tab, page; shots: event_id, ts, tab, page, trackers, third_parties, cookies. Either side is kept until
    the other's watermark is past what it can meet; a click is written once no snapshot can follow.
    """
    use_rocksdb(clicks.sparkSession)
    a = clicks.withWatermark("at", delay).select("click", "at", F.col("tab").alias("tab_"), F.col("page").alias("page_"))
    b = shots.withWatermark("ts", delay)
    near = (F.col("ts") >= F.col("at")) & (F.col("ts") <= F.col("at") + F.expr(f"INTERVAL '{int(within * 1000)}' MILLISECOND"))
    met = a.join(b, near & (F.col("tab") == F.col("tab_")) & (F.col("page") == F.col("page_")))
    worth = 100 * F.col("trackers") + 10 * F.col("third_parties") + F.col("cookies")
    pick = F.max_by(F.struct("event_id", "trackers", "third_parties", "cookies"), F.struct(worth, "ts", "event_id"))
    return met.groupBy("click", "at").agg(pick.alias("c"), F.count("*").alias("captures")).select("click", "captures", "c.*")


def with_lateness(events: DataFrame, delay_seconds: int, key: str = "tab", buckets: int = BUCKETS) -> DataFrame:
    """events with ``late``: whether a row lies further back than the delay behind the latest row of all triggers before.

    Nothing is dropped: the stream's own watermark trails by 10,000 days, and the mark that decides is reckoned from it. (Rows further back than those 10,000 days are dropped.)
    """
    use_rocksdb(events.sparkSession)
    days = 10_000
    processor = _Late(events.columns, delay_seconds * 1000, days * 86_400_000)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", late boolean"
    rows = events.withWatermark("ts", f"{days} days").select("*", _bucket([key], buckets)).groupBy("bucket_")
    return rows.transformWithStateInPandas(processor, out, "append", "EventTime")


def split_late(events: DataFrame, path: str, late_path: str, checkpoint: str, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Runs the stream over all that is there; rows in time go to the table at path, late ones to that at late_path. Each trigger's files
    are replaced if it is run again, so both tables have each row once."""
    marked = with_lateness(events, delay_seconds)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        for late, to in ((False, path), (True, late_path)):
            rows.where(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{to}/trigger={number}")
        rows.unpersist()

    spark, schema = events.sparkSession, events.schema
    with few_state_partitions(spark):
        q = marked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return tuple(spark.read.schema(schema).parquet(f"{p}/trigger=*") for p in (path, late_path))
