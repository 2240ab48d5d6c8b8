"""Streaming forms of normalization and of the collapse of repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from taxalog.operators.dedup import anchored_groups, counted, counted_summary, deduplicate, event_key
from taxalog.operators.evaluate import observe_counts
from taxalog.operators.normalize import normalize, split_rejects
from taxalog.options import Options
from taxalog.schemas import EVENT_FIELDS
from taxalog.storage import stored
from taxalog.streaming.sinks import Sink

UNTIL_END = {"availableNow": True}


def counted_events(logs: DataFrame, labels: DataFrame | None = None, embedder=None, options: Options = Options(),
                   name: str = "events") -> DataFrame:
    """Stream of events and rejects, row in, row out, with their ``error``; stateless, so nothing is held back at a stop.

    A row without a time gets that of its batch. Both kinds are counted under ``name`` (see ``CountListener``).
    """
    timed = logs.withColumn("ts", F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()))
    return observe_counts(normalize(timed, labels, embedder, options), name)


def direct(logs: DataFrame, labels: DataFrame | None = None, embedder=None, options: Options = Options(),
           name: str = "events") -> DataFrame:
    """The events of ``counted_events``; rejects are counted and left out. ``with_rejects`` keeps them."""
    return split_rejects(counted_events(logs, labels, embedder, options, name))[0]


def with_rejects(sink: Sink, rejects: Sink) -> Sink:
    """Events to one sink, rows that the model failed on, with their ``error``, to the other."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.persist(StorageLevel.DISK_ONLY)  # a batch has any size, and the model's workers need the memory
        try:
            good, bad = split_rejects(rows)
            sink(good, batch_id)
            rejects(bad, batch_id)
        finally:
            rows.unpersist()
    return write


def start(events: DataFrame, sink: Sink, checkpoint: str, trigger: dict = UNTIL_END) -> StreamingQuery:
    return (events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


# --- per micro-batch -----------------------------------------------------------

def dedup_batches(sink: Sink, window_s: float, **how) -> Sink:
    """Collapse repeats within each micro-batch, in arrival order; no group spans two batches.

    The trigger interval takes the place of the buffer timer and the source's
    per-trigger limit that of the buffer size.
    """
    def write(events: DataFrame, batch_id: int) -> None:
        events = events.withColumn("seq", F.coalesce("seq", F.monotonically_increasing_id()))
        events.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sink(deduplicate(events, window_s, **how), batch_id)
        finally:
            events.unpersist()
    return write


def buffered(events: DataFrame, sink: Sink, window_s: float, checkpoint: str, trigger: dict | None = None,
             **how) -> StreamingQuery:
    every = {"processingTime": f"{max(round(window_s * 1000), 1)} milliseconds"}
    return start(events, dedup_batches(sink, window_s, **how), checkpoint, trigger or every)


# --- event time ------------------------------------------------------------------

_KEY = ["type", "category"]
_PAYLOAD = ["severity", "summary", "confidence", "raw"]
_HEAD = "seq long, severity string, summary string, confidence double, raw string"
_OPEN = f"anchor_us long, latest_us long, n long, {_HEAD}"
_OUT = f"type string, category string, {_OPEN}"
_COLUMNS = ["anchor_us", "latest_us", "n", "seq", *_PAYLOAD]


def fold_times(group: tuple | None, ts: np.ndarray, n: np.ndarray, heads: pd.DataFrame, window_us: int) -> list[tuple]:
    """The groups that an open group and rows in time order make, in order; every one but the last is complete.

    Jumps from anchor to anchor: the work is one search per group, not per row.
    """
    groups, at, sums = [], 0, np.concatenate([[0], np.cumsum(n)])
    while at < len(ts) or group is not None:
        if group is None:
            group, at = (int(ts[at]), int(ts[at]), int(n[at]), *heads.iloc[at]), at + 1
        end = at + int(np.searchsorted(ts[at:], group[0] + window_us, "right"))
        if end > at:
            group = (group[0], int(ts[end - 1]), group[2] + int(sums[end] - sums[at]), *group[3:])
        groups.append(group)
        group, at = None, end
    return groups


class OpenGroup(StatefulProcessor):
    """Keeps one open group per key and closes it by an event-time timer at the end of its window."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def _settled(self, key, groups: list[tuple], mark_ms: int) -> pd.DataFrame:
        """Emits the groups whose window lies behind the watermark and keeps the last one that does not."""
        last = groups[-1]
        if last[0] + self.window_us > mark_ms * 1000:
            groups = groups[:-1]
            self.open.update(tuple(None if pd.isna(v) else v for v in last))
            self.handle.registerTimer(max(-(-(last[0] + self.window_us) // 1000), mark_ms + 1))
        else:
            self.open.clear()
        out = pd.DataFrame(groups, columns=_COLUMNS)
        out.insert(0, "type", key[0])
        out.insert(1, "category", key[1])
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.open.get()) if self.open.exists() else None
        new = pd.concat(list(rows)).sort_values("ts_us", kind="stable")
        groups = fold_times(held, new["ts_us"].to_numpy(), new["n"].to_numpy(), new[["seq", *_PAYLOAD]], self.window_us)
        yield self._settled(key, groups, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():  # else a later row has closed it
            yield self._settled(key, [tuple(self.open.get())], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def event_time_dedup(events: DataFrame, window_s: float, delay: str = "10 seconds", name: str = "event_time") -> DataFrame:
    """Groups that do not depend on how the stream is cut into batches.

    Rows of one type, category and time are one row of a native aggregate, which
    Spark holds until the watermark has passed them; so they come to the fold in time
    order, batch after batch, and a key's state there is its one open group. A group is
    emitted when the watermark has passed its window, and by ``left_open`` at the end.
    A row without a time counts with the time of its batch. Rows behind the watermark
    of the batch before theirs are dropped by Spark, which counts them, after those of
    one task and time were combined (``CountListener.late``). The observation ``name`` counts the rows (``seen``)
    and those without a time (``untimed``).

    Needs the RocksDB state store: ``use_rocksdb(spark)`` before the stream starts.
    """
    window_us = round(window_s * 1_000_000)
    # Rows of a stream may carry no number; equal times then need some fixed order.
    seq = F.coalesce("seq", F.xxhash64(*_PAYLOAD)).alias("seq")
    stamp = F.coalesce(F.col("timestamp").cast("timestamp"), F.current_timestamp())
    rows = (events.observe(name, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("timestamp").isNull()).alias("untimed"))
            .withColumn("timestamp", stamp).withWatermark("timestamp", delay)
            .groupBy(*_KEY, "timestamp").agg(F.count("*").alias("n"), F.min(F.struct(seq, *_PAYLOAD)).alias("head"))
            .select(*_KEY, F.unix_micros("timestamp").alias("ts_us"), "n", "head.*"))
    return _as_events(rows.groupBy(*_KEY).transformWithStateInPandas(OpenGroup(window_us), _OUT, "Append", "EventTime"))


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _as_events(groups: DataFrame) -> DataFrame:
    n, span = F.col("n"), F.col("latest_us") - F.col("anchor_us")
    return (groups.withColumn("timestamp", F.timestamp_micros("anchor_us"))
            .withColumn("summary", counted_summary(F.col("summary"), n, span)).withColumn("count", counted(n))
            .select("seq", *EVENT_FIELDS))


def _state(spark: SparkSession, checkpoint: str, operator: str, **options) -> DataFrame:
    """The last state of the stream's operator with this name."""
    ids = {r.operatorName: r.operatorId for r in spark.read.format("state-metadata").load(checkpoint).collect()}  # a row per operator
    return spark.read.format("statestore").options(operatorId=ids[operator], **options).load(checkpoint)


def left_open(spark: SparkSession, checkpoint: str, window_s: float, **how) -> DataFrame:
    """The events that ``event_time_dedup`` still held when its stream ended for good.

    Read from the state of the last batch in ``checkpoint``: open groups go on with
    the rows that waited for the watermark, in the time chunks of the batch operator.
    The stream's sink gets what this returns.
    """
    started = (_state(spark, checkpoint, "transformWithStateInPandasExec", stateVarName="open").select("key.*", "value.*")
               .select(*_KEY, F.col("anchor_us").alias("ts"), "latest_us", "n", "seq", *_PAYLOAD))
    waiting = (_state(spark, checkpoint, "stateStoreSave").where("key.timestamp IS NOT NULL")
               .select("key.*", F.col("value.count").alias("n"), "value.min.*")
               .select(*_KEY, F.unix_micros("timestamp").alias("ts"), F.unix_micros("timestamp").alias("latest_us"), "n", "seq", *_PAYLOAD))
    rows = stored(started.unionByName(waiting), "left-open")
    points = rows.select(event_key().alias("key"), "ts", "seq", "n")
    # The latest time of an open group counts for its duration only.
    ends = rows.where("latest_us > ts").select(event_key().alias("key"), F.col("latest_us").alias("ts"),
                                               F.lit((1 << 63) - 1).alias("seq"), F.lit(0).cast("long").alias("n"))
    groups = anchored_groups(points.unionByName(ends), round(window_s * 1_000_000), **how).select(
        F.col("key").alias("_key"), F.col("anchor").alias("ts"), F.col("first_seq").alias("seq"), F.col("n").alias("_n"), "latest")
    found = rows.withColumn("_key", event_key()).join(groups, ["_key", "ts", "seq"])
    return _as_events(found.select(*_KEY, F.col("ts").alias("anchor_us"), F.col("latest").alias("latest_us"),
                                   F.col("_n").alias("n"), "seq", *_PAYLOAD))


# --- metrics ---------------------------------------------------------------------

class CountListener(StreamingQueryListener):
    """Counts of every finished micro-batch: ``batches`` (batch, written, skipped) of ``counted_events``,
    ``timed`` (batch, seen, untimed) of ``event_time_dedup``, ``late`` (batch, rows behind the watermark)."""

    def __init__(self, name: str = "events", timed: str = "event_time"):
        self.name, self.timed_name = name, timed
        self.batches: list[tuple[int, int, int]] = []
        self.timed: list[tuple[int, int, int]] = []
        self.late: list[tuple[int, int]] = []
        self.ended: set[str] = set()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        for into, name, fields in ((self.batches, self.name, ("written", "skipped")), (self.timed, self.timed_name, ("seen", "untimed"))):
            row = progress.observedMetrics.get(name)
            if row is not None and all(f in row for f in fields):
                into.append((progress.batchId, *(row[f] for f in fields)))
        if progress.stateOperators:
            self.late.append((progress.batchId, sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.add(str(event.id))
