"""Collapse of repeats inside anchored windows.

A group starts at its first event (the anchor) and takes every event of the
same type and category up to ``window`` after the anchor; the next event opens
the next group. Neither epoch-aligned nor gap-based windows give this.

The rule is a chain, one anchor depends on the one before, so a busy key looks
like work for one task. It is split here:

1. Time is cut into chunks. For every (key, chunk) the *steps* say where a chain
   leaves the chunk, depending on where it enters: only events in the first
   window of a chunk can be entries, and entries that meet stay together, so
   this is a short non-decreasing step function. Chunks run in parallel.
2. The steps of many chunks are composed into steps of a span of chunks.
3. Per key, the spans are walked in order; then, in parallel per span, the
   chunks. That gives the anchor that is open when each chunk begins.
4. Every chunk now folds its own events, independently of all others.

Only (key, time, count) travels through these steps, equal times combined before
the shuffle. Each pass reads sorted Arrow batches and keeps one open entry set,
never a whole key. The event payload joins at the end, for group heads only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from taxalog.functions.text import format_duration

CHUNK_POINTS = 100_000  # points per chunk that are aimed at
MAX_CHUNK_WINDOWS = 4096
SPAN_CHUNKS = 512     # chunks per span
SEQ_BUCKET = 1 << 20  # arrival numbers per bucket


def event_key(event_type="type", category="category") -> Column:
    return F.concat_ws(".", F.col(event_type), F.col(category))


# --- clocks -------------------------------------------------------------------

def arrival_clock(events: DataFrame, key: str, ts_us: str, seq: str, bucket: int = SEQ_BUCKET) -> DataFrame:
    """Replace the time by the latest time seen so far per key, in arrival order.

    A late row never opens a group, so arrival order and time order agree on
    this clock. The running maximum is taken inside buckets of ``bucket``
    arrival numbers and carried over from bucket to bucket, which bounds the
    rows of one sort by the bucket instead of the key.
    """
    rows = events.withColumn("_bucket", F.floor(F.col(seq) / bucket))
    tops = rows.groupBy(key, "_bucket").agg(F.max(ts_us).alias("_top"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(key, "_bucket", F.max("_top").over(before).alias("_carried"))
    inside = W.partitionBy(key, "_bucket").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    return (rows.join(carried, [key, "_bucket"])
            .withColumn(ts_us, F.greatest(F.max(ts_us).over(inside), F.col("_carried")))
            .drop("_bucket", "_carried"))


# --- sorted passes --------------------------------------------------------------

def _runs(batches: Iterator[pd.DataFrame], by: list[str]):
    """Consecutive rows with equal ``by`` values, as pieces of at most one batch.

    Yields ``(group, is_new, piece)``.
    """
    current = None
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[c].to_numpy() for c in by]
        change = np.zeros(len(batch), dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        bounds = [0, *np.flatnonzero(change), len(batch)]
        for start, stop in zip(bounds, bounds[1:]):
            group = tuple(v[start] for v in values)
            yield group, group != current, batch.iloc[start:stop]
            current = group


def _advance(anchors: np.ndarray, entries: np.ndarray, exits: np.ndarray, window: int) -> np.ndarray:
    """Move each open anchor to where a block takes it; stay if nothing is late enough."""
    at = np.searchsorted(entries, anchors + window, side="right")
    moved = at < len(entries)
    return np.where(moved, exits[np.minimum(at, len(entries) - 1)], anchors) if len(entries) else anchors


def _block_exits(times: np.ndarray, window: int) -> np.ndarray:
    """Last anchor within a sorted block, for a chain that enters at each event."""
    after = np.searchsorted(times, times + window, side="right")
    last = np.arange(len(times))
    # Pointer doubling: log2(longest chain) rounds over the block.
    hop = np.where(after < len(times), after, last)
    while True:
        further = hop[hop]
        if (further == hop).all():
            return times[hop]
        hop = further


def _squeeze(entries: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries that leave at the same anchor need only their last member."""
    keep = np.append(exits[1:] != exits[:-1], True) if len(exits) else np.zeros(0, dtype=bool)
    return entries[keep], exits[keep]


def _steps_of_points(window: int, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, entries, exits, more = None, None, None, True
        for new_group, is_new, piece in _runs(batches, ["key", "chunk"]):
            if is_new:
                if group is not None:
                    yield _step_rows(group, entries, exits)
                group, more = new_group, True
                entries = exits = np.zeros(0, dtype=np.int64)
            times = piece["ts"].to_numpy()
            block = _block_exits(times, window)
            exits = _advance(exits, times, block, window)
            if more:
                # Events in the first window are entries, and the first event behind it.
                n = int(np.searchsorted(times, group[1] * chunk + window, side="right")) + 1
                more = n > len(times)
                entries = np.concatenate([entries, times[:n]])
                exits = np.concatenate([exits, block[:n]])
            entries, exits = _squeeze(entries, exits)
        if group is not None:
            yield _step_rows(group, entries, exits)
    return run


def _step_rows(group, entries, exits) -> pd.DataFrame:
    return pd.DataFrame({"key": group[0], "chunk": group[1], "entry": entries, "leave": exits})


def _steps_of_steps(window: int):
    """Compose the steps of the chunks of a span, in chunk order."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span = chunk = None
        entries = exits = np.zeros(0, dtype=np.int64)
        parts: list = []
        seen = 0

        def close_chunk():
            nonlocal entries, exits, parts, seen
            if parts:
                e = np.concatenate([p[0] for p in parts])
                x = np.concatenate([p[1] for p in parts])
                exits = _advance(exits, e, x, window)
                # All entries of the first chunk, and the first one of the second.
                n = len(e) if seen == 0 else 1 if seen == 1 else 0
                entries, exits = _squeeze(np.concatenate([entries, e[:n]]), np.concatenate([exits, x[:n]]))
                parts, seen = [], seen + 1

        for group, _, piece in _runs(batches, ["key", "span", "chunk"]):
            if group != chunk:
                close_chunk()
                if group[:2] != span:
                    if span is not None:
                        yield _step_rows(span, entries, exits)
                    span, seen = group[:2], 0
                    entries = exits = np.zeros(0, dtype=np.int64)
                chunk = group
            parts.append((piece["entry"].to_numpy(), piece["leave"].to_numpy()))
        close_chunk()
        if span is not None:
            yield _step_rows(span, entries, exits)
    return run


def _walk(window: int, outer: list[str]):
    """Go through the chunks of an outer group; say which anchor is open before each.

    The input may carry the anchor that is open before the outer group.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, chunk, anchor = None, None, None
        entered = False
        out: list = []
        for group, is_new, piece in _runs(batches, [*outer, "chunk"]):
            if is_new:
                if group[:-1] != where:
                    where = group[:-1]
                    start = piece["open"].iloc[0] if "open" in piece else None
                    anchor = None if start is None or pd.isna(start) else int(start)
                chunk, entered = group[-1], False
                out.append((group[0], chunk, anchor))
                if len(out) >= 10_000:
                    yield _open_rows(out)
                    out = []
            if not entered:
                e, x = piece["entry"].to_numpy(), piece["leave"].to_numpy()
                at = 0 if anchor is None else int(np.searchsorted(e, anchor + window, side="right"))
                if at < len(e):
                    anchor, entered = int(x[at]), True
        if out:
            yield _open_rows(out)
    return run


def _open_rows(rows) -> pd.DataFrame:
    return pd.DataFrame({"key": [r[0] for r in rows], "chunk": [r[1] for r in rows],
                         "open": pd.array([r[2] for r in rows], dtype="Int64")})


def _fold(window: int):
    """Assign the events of a chunk to groups, given the anchor that is open before it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor = None
        for group, is_new, piece in _runs(batches, ["key", "chunk"]):
            if is_new:
                start = piece["open"].iloc[0]
                anchor = None if pd.isna(start) else int(start)
            times = piece["ts"].to_numpy()
            after = np.searchsorted(times, times + window, side="right")
            at = 0 if anchor is None else int(np.searchsorted(times, anchor + window, side="right"))
            heads = []
            while at < len(times):
                heads.append(at)
                at = int(after[at])
            bounds = np.array(heads if heads and heads[0] == 0 else [0, *heads], dtype=np.intp)
            anchors = times[bounds]
            if not heads or heads[0] != 0:
                anchors[0] = anchor
            stops = np.append(bounds[1:], len(times)) - 1
            yield pd.DataFrame({
                "key": group[0], "anchor": anchors,
                "n": np.add.reduceat(piece["n"].to_numpy(), bounds),
                "latest": times[stops],
                # only the anchor's own time knows the first arrival
                "first_seq": piece["first_seq"].to_numpy()[bounds],
                "is_head": anchors == times[bounds]})
            anchor = int(anchors[-1])
    return run


def _number(value: Column, size: int) -> Column:
    return F.coalesce(F.floor(value / F.lit(size)), F.lit(0).cast("long"))


def windows_per_chunk(points: DataFrame, window_us: int, aim: int = CHUNK_POINTS) -> int:
    """Chunk length by density: the densest window of the data, so many times, makes ``aim`` points.

    One window is the least, as a chunk has to hold the entries of its first
    window. Rows are counted within tasks before the shuffle, and one number
    comes to the driver. The groups are the same for any length.
    """
    bins = points.groupBy("key", F.floor(F.col("ts") / F.lit(max(window_us, 1)))).count()
    densest = bins.agg(F.max("count")).first()[0]
    return max(1, min(MAX_CHUNK_WINDOWS, aim // (densest or 1)))


def anchored_groups(points: DataFrame, window_us: int, chunk_windows: int | None = None,
                    span_chunks: int = SPAN_CHUNKS, direct: bool = False) -> DataFrame:
    """Groups ``(key, anchor, n, latest, first_seq)`` of ``(key, ts, seq)`` rows, times in microseconds.

    A column ``n`` says how many rows a point stands for, one by default. Without
    ``chunk_windows`` the chunks follow the density, see ``windows_per_chunk``.
    ``direct`` folds each key in one sorted pass, in one task. It saves the fixed
    cost of the steps and is meant for inputs of known size, such as micro-batches.
    """
    if chunk_windows is None:
        chunk_windows = 1 if direct else windows_per_chunk(points, window_us)
    chunk = max(window_us, 1) * chunk_windows
    weight = F.sum("n") if "n" in points.columns else F.count("*")
    # Steps and fold read the same shuffle, so both take all of its columns; a
    # numbering that cannot be null keeps the joins from adding a filter to one.
    distinct = (points.groupBy("key", _number(F.col("ts"), chunk).alias("chunk"), "ts")
                .agg(weight.alias("n"), F.min("seq").alias("first_seq")))
    chunks = distinct.repartition("key", "chunk")
    fold_schema = T.StructType([distinct.schema["key"], T.StructField("anchor", T.LongType()),
                                T.StructField("n", T.LongType()), T.StructField("latest", T.LongType()),
                                T.StructField("first_seq", T.LongType()), T.StructField("is_head", T.BooleanType())])
    if direct:
        whole = distinct.withColumn("chunk", F.lit(0).cast("long")).withColumn("open", F.lit(None).cast("long"))
        return _join_parts(whole.repartition("key").sortWithinPartitions("key", "ts")
                           .mapInPandas(_fold(window_us), fold_schema))

    chunk_field = T.StructField("chunk", T.LongType(), False)
    step_schema = T.StructType([distinct.schema["key"], chunk_field,
                                T.StructField("entry", T.LongType()), T.StructField("leave", T.LongType())])
    open_schema = T.StructType([distinct.schema["key"], chunk_field,
                                T.StructField("open", T.LongType())])

    steps = (chunks.sortWithinPartitions("key", "chunk", "ts")
             .mapInPandas(_steps_of_points(window_us, chunk), step_schema))
    by_span = (steps.withColumn("span", _number(F.col("chunk"), span_chunks)).repartition("key", "span"))
    in_order = ["key", "span", "chunk", "entry"]
    spans = by_span.sortWithinPartitions(*in_order).mapInPandas(_steps_of_steps(window_us), step_schema)
    open_spans = (spans.repartition("key").sortWithinPartitions("key", "chunk", "entry")
                  .mapInPandas(_walk(window_us, ["key"]), open_schema)
                  .withColumnRenamed("chunk", "span"))
    open_chunks = (by_span.join(open_spans, ["key", "span"]).sortWithinPartitions(*in_order)
                   .mapInPandas(_walk(window_us, ["key", "span"]), open_schema))
    parts = (chunks.join(open_chunks, ["key", "chunk"]).sortWithinPartitions("key", "chunk", "ts")
             .mapInPandas(_fold(window_us), fold_schema))
    return _join_parts(parts)


def _join_parts(parts: DataFrame) -> DataFrame:
    """A group that crosses a chunk border or an Arrow batch arrives in several parts."""
    return parts.groupBy("key", "anchor").agg(
        F.sum("n").alias("n"), F.max("latest").alias("latest"),
        F.min(F.when(F.col("is_head"), F.col("first_seq"))).alias("first_seq"))


# --- events -------------------------------------------------------------------

def counted(n: Column) -> Column:
    """A count is shown only for real groups."""
    return F.when(n > 1, n).otherwise(0).cast("int")


def counted_summary(summary: Column, n: Column, span_us: Column) -> Column:
    return F.when(n > 1, F.concat(summary, F.lit(" (x"), n.cast("string"), F.lit(" in "),
                                  format_duration(span_us), F.lit(")"))).otherwise(summary)


def deduplicate(events: DataFrame, window_s: float = 5.0, order: str = "arrival", **chunking) -> DataFrame:
    """One event per group: its first, with the count and the rewritten summary.

    ``events`` has ``seq`` and the event columns. ``order="arrival"`` follows
    ``seq`` (late rows join the open group); ``order="time"`` sorts by time.
    ``events`` is read twice, so it should be a stored table, not a long plan.
    Sort the result by ``seq`` for first-occurrence order.
    """
    if order not in ("arrival", "time"):
        raise ValueError(f"order must be arrival or time, got {order!r}")
    window_us = round(window_s * 1_000_000)
    points = events.select(event_key().alias("key"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("ts"), "seq")
    if not chunking.get("direct") and chunking.get("chunk_windows") is None:
        chunking["chunk_windows"] = windows_per_chunk(points, window_us)  # before the clock, which takes several shuffles
    if order == "arrival":
        points = arrival_clock(points, "key", "ts", "seq")
    groups = anchored_groups(points, window_us, **chunking)
    heads = groups.select(F.col("first_seq").alias("seq"), "n", (F.col("latest") - F.col("anchor")).alias("_span"))
    return (events.join(heads, "seq")
            .withColumn("summary", counted_summary(F.col("summary"), F.col("n"), F.col("_span")))
            .withColumn("count", counted(F.col("n")))
            .drop("n", "_span"))


def total_count(events: DataFrame) -> DataFrame:
    """Rows the events stand for; equals the number of rows before the collapse."""
    return events.agg(F.sum(F.greatest(F.col("count"), F.lit(1))).alias("total"), F.count("*").alias("events"))
