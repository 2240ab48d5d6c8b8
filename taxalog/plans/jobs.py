"""Whole jobs: source, normalization, collapse of repeats, sinks."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession

from taxalog.operators.dedup import deduplicate
from taxalog.operators.evaluate import observe_counts
from taxalog.operators.normalize import Normalizer, default_time, normalize, split_rejects
from taxalog.options import check_range
from taxalog.sources import logs as sources
from taxalog.storage import stored
from taxalog.streaming.sinks import Sink, fan_out, in_first_order


def spread(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """``rows`` dealt out to ``partitions`` tasks.

    Without a number the session setting ``taxalog.partitions`` holds, and without
    that the rows stay in the splits of their scan. A number is worth its shuffle
    only where a table has fewer splits than the cluster has cores.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("taxalog.partitions", "0"))
    return rows.repartition(partitions) if partitions else rows


def query(spark: SparkSession, source: str, sinks: list[Sink], start: datetime, end: datetime,
          normalizer: Normalizer | None = None, dedup: bool = True, order: str = "arrival",
          partitions: int | None = None, ordered: bool = False, counts: Observation | None = None, **source_options) -> DataFrame:
    """One-shot run over ``[start, end)``; returns the rejected rows.

    Runs append: each writes below a batch number of its own. The normalized events
    are stored before the collapse, which reads them twice, and before the sinks,
    which read the result once each. ``ordered`` sorts the events by first
    occurrence, for sinks that keep an order. ``counts``, an observation, gets the
    numbers of ``written`` and ``skipped`` rows. ``partitions``: see ``spread``.
    """
    check_range(start, end)
    normalizer = normalizer or Normalizer(spark)
    options = normalizer.options
    rows = sources.read(spark, source, start=start, end=end, n=options.limit, **source_options)
    events = normalize(default_time(spread(rows, partitions)), normalizer.labels, normalizer.embedder, options)
    events = stored(events if counts is None else observe_counts(events, counts), "events")
    good, rejected = split_rejects(events)
    if dedup:
        good = deduplicate(good, options.dedup_window_s, order)
    fan_out(*sinks)(in_first_order(good) if ordered else good, uuid.uuid4().int >> 65)
    return rejected
