"""Mixing of sources to target weights along a curriculum (operator 6).

A source's tokens are demanded at a rate that changes over the training time 0..1.
The integral of its schedule is its cumulative demand; the documents of a source,
in a fixed random order and repeated as its target asks, lie one after the other
on that demand; inverting it gives each its time, and documents are range-sorted
by time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Weight at the start and at the end of the training, by the source's place modulo their number.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``source``, ``source_size``, ``place``, ``target`` from (source, size) rows, some of them per source.

    Sources by code point, null last, get the weights in turn and share
    ``share`` times all words. A target stops at ``REPEATS`` times its source's
    size; what is above is shared again by weight, which ends at one common level
    of words per weight: sources are put in order of the level that caps them,
    and the level is the first, and so the highest, that caps no later source. The windows
    run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = (per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
           .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
           .withColumn("most", F.col("source_size") * REPEATS))
    order = Window.orderBy(F.col("most") / F.col("w"), "place")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("full", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("total", F.sum("source_size").over(whole)))
    level = (F.col("total") * F.lit(float(share)) - F.col("full")) / F.col("rest")
    per = per.withColumn("level", F.max(F.when(level * F.col("w") <= F.col("most"), level)).over(whole))
    return per.select("source", "source_size", "place",
                      F.least(F.col("most").cast("double"), F.col("level") * F.col("w")).alias("target"))


def demand_time(share: Column, start: Column, end: Column) -> Column:
    """Time at which a schedule, linear from ``start`` to ``end``, has demanded ``share`` of its tokens."""
    mean, slope = (start + end) / 2, end - start
    return F.when(slope == 0, share).otherwise((F.sqrt(start * start + slope * 2 * mean * share) - start) / slope)


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
         schedules: Sequence[tuple[float, float]] = SCHEDULES) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies``, ``taken``, ``times`` (array of double).

    A null text has size 0; documents of size 0 take no word; a null source is a
    source. The order within a source hangs on the doc_id (on the text where it is
    null), so reruns agree; repeated rows are documents of their own. Columns of
    ``docs`` with these names are replaced.

    Running sums go in two steps, over 4096 slices of a source by hash and within
    a slice, so a source with a third of all rows is spread over its slices.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken", "times")]
    rows = (docs.select(*names).withColumn("size", word_count(F.col("text")))
            .withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))))
            .withColumn("_slice", F.substring("_order", 1, 3)))
    slices = rows.groupBy("source", "_slice").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    level = targets(slices.select("source", "size"), weights, share).withColumnRenamed("source", "_source")
    starts = (starts.join(level, F.col("source").eqNullSafe(F.col("_source")))
              .select("_source", F.col("_slice").alias("_part"), "_before", "source_size", "place", "target"))
    within = (Window.partitionBy("source", "_slice").orderBy("_order", "doc_id", "size", F.xxhash64("text"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_end", F.sum("size").over(within))
    rows = (rows.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_part")))
            .withColumn("_middle", F.col("_before") + F.col("_end") - F.col("size") / 2))
    begin, end = (F.element_at(F.array(*(F.lit(float(s[k])) for s in schedules)), (F.col("place") % len(schedules) + 1).cast("int"))
                  for k in (0, 1))
    middles = F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), lambda k: F.col("_middle") + F.col("source_size") * k)
    taken = F.filter(middles, lambda m: m < F.col("target"))
    rows = (rows.withColumn("_taken", taken).withColumn("copies", F.size("_taken"))
            .withColumn("taken", F.col("size") * F.col("copies"))
            .withColumn("times", F.transform("_taken", lambda m: demand_time(m / F.col("target"), begin, end))))
    return rows.select(*names, "size", "source_size", "target", "copies", "taken", "times")


def arrange(docs: DataFrame, **options) -> DataFrame:
    """The training set: a row for every copy that the mix takes, with ``position`` (0..1), range-sorted by it."""
    rows = plan(docs, **options)
    names = [c for c in docs.columns if c in rows.columns and c != "position"]
    return rows.select(*names, F.explode("times").alias("position")).orderBy("position", "doc_id")
