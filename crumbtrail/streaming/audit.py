"""The interaction audit on streams: sessions, tracker prevalence, rates with watermarks, ingestion of what is new."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crumbtrail.functions import domains as D
from crumbtrail.streaming.timed import few_state_partitions, use_rocksdb

EVENTS = "event_id long, ts timestamp, tab long, page string, label string, kind string"
SESSION = "tab long, page string, first_event long, n long, clicks long, armed boolean, completed boolean"
_STATE = "page string, first_event long, n long, clicks long, armed boolean, last_us long"
#: The kind of an event that only ends what is open, see ended().
END = "end"


def read_events(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ended(events: DataFrame, after: str = "2 days") -> DataFrame:
    """events and, for each tab, one of kind END well after the last of all: input that is known to be complete then leaves
    no session or window open. Its own session and window stay open and are never written."""
    last = events.agg(F.max("ts").alias("last_"))
    marks = events.select("tab").distinct().crossJoin(F.broadcast(last))  # one row on one side
    row = {"ts": F.col("last_") + F.expr(f"INTERVAL {after}"), "event_id": F.lit(-1).cast("long"), "page": F.lit(""), "label": F.lit(""), "kind": F.lit(END)}
    return events.unionByName(marks.withColumns(row).drop("last_"))


def _audit(idle_us: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["tab", "page", "first_event", "n", "clicks", "armed", "completed"]
        if state.hasTimedOut:
            page, first, n, clicks, armed, _ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], page, first, n, clicks, armed, armed and clicks > 0)], columns=names)
            return
        # A trigger's rows of one tab, in order of time; maxFilesPerTrigger bounds them.
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        us, page = rows.ts.to_numpy("datetime64[us]").astype(np.int64), rows.page.to_numpy()
        open_ = state.get if state.exists else None
        before_us, before_page = (open_[5], open_[0]) if open_ else (us[0], page[0])
        new = (np.diff(us, prepend=before_us) > idle_us) | (page != np.r_[[before_page], page[:-1]].astype(object))
        starts = np.unique(np.r_[0, np.flatnonzero(new)])
        table = pd.DataFrame(
            {
                "page": page[starts], "first_event": np.minimum.reduceat(rows.event_id.to_numpy(np.int64), starts), "n": np.diff(np.r_[starts, len(us)]),
                "clicks": np.add.reduceat((rows.kind == "click").to_numpy(np.int64), starts), "armed": np.logical_or.reduceat((rows.kind == "banner_seen").to_numpy(bool), starts),
            }
        )
        if open_:
            if new[0]:
                table = pd.concat([pd.DataFrame([open_[:5]], columns=table.columns), table])
            else:
                # The first run goes on with the open session.
                table = table.astype({"armed": bool})
                table.loc[0, ["first_event", "n", "clicks", "armed"]] = [min(open_[1], table.first_event[0]), open_[2] + table.n[0], open_[3] + table.clicks[0], bool(open_[4] or table.armed[0])]
        last = table.iloc[-1]
        state.update((str(last.page), int(last.first_event), int(last.n), int(last.clicks), bool(last.armed), int(us[-1])))
        state.setTimeoutTimestamp(max(int(us[-1]) // 1000 + idle_us // 1000, state.getCurrentWatermarkMs() + 1))
        done = table.iloc[:-1].copy()
        done["tab"] = key[0]
        done["completed"] = done.armed.astype(bool) & (done.clicks > 0)
        yield done[names]

    return step


def sessions(events: DataFrame, idle: str = "10 minutes", idle_seconds: int = 600) -> DataFrame:
    """Sessions of a tab on one page, closed by another page or by idleness in event time. Armed: a banner was seen;
    completed: it was also clicked. State is one small row per open tab."""
    marked = events.withWatermark("ts", idle).select("event_id", "ts", "tab", "page", "kind")
    return marked.groupBy("tab").applyInPandasWithState(_audit(idle_seconds * 1_000_000), SESSION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events of each kind per window, tumbling or sliding."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    # No filter on the kind here: it would reach below the watermark, and marks of the end could not move it.
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def _learn(at_least: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = list(state.get[0]) if state.exists else []
        before = len(known)
        for pdf in batches:
            if len(known) < at_least:
                known = list(dict.fromkeys([*known, *pdf.site.unique().tolist()]))[:at_least]
        state.update((known,))
        # Once: when the number is reached.
        if before < at_least <= len(known):
            yield pd.DataFrame({"domain": [key[0]], "first_parties": [len(known)]})

    return step


def learned_trackers(requests: DataFrame, at_least: int = 3) -> DataFrame:
    """Each third party once, as soon as it was met on so many distinct sites. State is that number of sites per domain."""
    third = requests.where(D.is_third_party(F.col("host"), F.col("site"))).select(D.registered_domain(F.col("host")).alias("domain"), "site")
    return third.groupBy("domain").applyInPandasWithState(_learn(at_least), "domain string, first_parties int", "sites array<string>", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str) -> DataFrame:
    """Appends the rows whose key no delivery has had yet; of equal keys in a trigger one. The keys are state, looked up for
    the rows of a trigger alone, so what a trigger reads is its delivery and not the table. A table that was made otherwise
    goes through as a first delivery."""
    use_rocksdb(stream.sparkSession)
    return run_to_table(stream.dropDuplicates([key]), path, checkpoint)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote. Exactly once: Parquet sink and checkpoint."""
    with few_state_partitions(stream.sparkSession):
        q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
