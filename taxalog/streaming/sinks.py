"""Sinks: plain callables ``sink(events, batch_id)``, usable in batch and in ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalog.operators.batching import PAYLOAD_EVENTS, local_batches, payloads
from taxalog.operators.normalize import event_json

Sink = Callable[[DataFrame, int], None]


def _batch_path(path: str, batch_id: int) -> str:
    # One directory per micro-batch, overwritten: a repeated batch leaves no copies. One-shot
    # jobs pass a new number each, so they append; a stream with a new checkpoint needs a new path.
    return f"{path.rstrip('/')}/batch={batch_id}"


def ndjson(path: str, verbosity: str = "standard", pretty: bool = False, max_records_per_file: int = 0,
           by_severity: bool = False) -> Sink:
    """JSON lines; new files instead of rotation, ``max_records_per_file`` bounds their size."""
    def write(events: DataFrame, batch_id: int) -> None:
        lines = events.select(*(["severity"] if by_severity else []), event_json(verbosity, pretty).alias("value"))
        writer = lines.write.mode("overwrite")
        if max_records_per_file:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        if by_severity:
            writer = writer.partitionBy("severity")
        writer.text(_batch_path(path, batch_id))
    return write


def console(verbosity: str = "standard", n: int = 0) -> Sink:
    """All events, or the first ``n``, as JSON on the driver's standard output, a partition at a time."""
    def write(events: DataFrame, batch_id: int) -> None:
        lines = events.select(event_json(verbosity).alias("json"))
        for row in (lines.limit(n) if n > 0 else lines).toLocalIterator():
            print(row["json"])
    return write


def payload_table(path: str, size: int = PAYLOAD_EVENTS) -> Sink:
    """JSON-array payloads for a delivery service to pick up."""
    def write(events: DataFrame, batch_id: int) -> None:
        payloads(local_batches(events, size), event_json("full")).write.mode("overwrite").parquet(
            _batch_path(path, batch_id))
    return write


def parquet(path: str) -> Sink:
    def write(events: DataFrame, batch_id: int) -> None:
        events.write.mode("overwrite").parquet(_batch_path(path, batch_id))
    return write


def fan_out(*sinks: Sink) -> Sink:
    """Every sink gets every event; errors are raised together after the last one."""
    def write(events: DataFrame, batch_id: int) -> None:
        errors = []
        events.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for sink in sinks:
                try:
                    sink(events, batch_id)
                except Exception as error:
                    errors.append(error)
        finally:
            events.unpersist()
        if errors:
            raise ExceptionGroup("sinks failed", errors)
    return write


def in_first_order(events: DataFrame) -> DataFrame:
    """Order of first occurrence, for sinks that keep an order."""
    return events.orderBy(F.col("seq"))
