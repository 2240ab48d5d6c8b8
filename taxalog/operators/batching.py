"""Fixed-size batches of events and their JSON-array payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAYLOAD_EVENTS = 50   # fixed value
SEQ_BUCKET = 1 << 16  # arrival numbers numbered by one task
SPAN_BUCKETS = 1 << 12


def local_batches(rows: DataFrame, size: int = PAYLOAD_EVENTS) -> DataFrame:
    """``batch_id`` in the order of each task's rows; no shuffle, short last batches."""
    position = F.monotonically_increasing_id()
    return rows.withColumn("_at", position).withColumn(
        "batch_id", F.concat(F.shiftright("_at", 33).cast("string"), F.lit("-"),
                             F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / size).cast("string"))).drop("_at")


def ordered_batches(rows: DataFrame, seq: str = "seq", size: int = PAYLOAD_EVENTS, bucket: int = SEQ_BUCKET) -> DataFrame:
    """``row_no`` (from 0) and ``batch_id`` in global ``seq`` order.

    Rows are numbered inside buckets of arrival numbers; bucket offsets come from
    running sums of the bucket counts, again in two levels, so that no window
    spans the data.
    """
    marked = (rows.withColumn("_bucket", F.floor(F.col(seq) / bucket))
              .withColumn("_span", F.floor(F.col("_bucket") / SPAN_BUCKETS)))
    buckets = marked.groupBy("_span", "_bucket").agg(F.count("*").alias("_n"))
    spans = buckets.groupBy("_span").agg(F.sum("_n").alias("_n"))
    earlier = W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    span_start = spans.select("_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_span_start"))
    in_span = W.partitionBy("_span").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (buckets.withColumn("_before", F.coalesce(F.sum("_n").over(in_span), F.lit(0)))
              .join(span_start, "_span")
              .select("_bucket", (F.col("_span_start") + F.col("_before")).alias("_start")))
    in_bucket = W.partitionBy("_bucket").orderBy(seq)
    return (marked.join(starts, "_bucket")
            .withColumn("row_no", F.col("_start") + F.row_number().over(in_bucket) - 1)
            .withColumn("batch_id", F.floor(F.col("row_no") / size))
            .drop("_bucket", "_span", "_start"))


def payloads(batched: DataFrame, event: Column, order: str = "seq") -> DataFrame:
    """One row per batch: the number of events and the JSON array of them in order.

    The events go out whole; verbosity does not apply here.
    """
    return (batched.groupBy("batch_id")
            .agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), event.alias("e")))).alias("_rows"))
            .select("batch_id", "n", F.concat(
                F.lit("["), F.array_join(F.transform("_rows", lambda r: r["e"]), ","), F.lit("]")).alias("body")))
