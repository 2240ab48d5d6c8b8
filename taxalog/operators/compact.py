"""Shortening of raw text by verbosity, and what it saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxalog.functions.jsonfields import strip_fields
from taxalog.functions.text import estimate_tokens, let, shorten_trace, truncate

# Kept stack frames and code points per verbosity.
LIMITS = {"minimal": (5, 200), "standard": (10, 2000)}


def compact(raw: Column, event_type: Column, verbosity: str = "standard", fields=None) -> Column:
    """A shortened trace is kept whole; only texts without one are cut."""
    if verbosity == "full":
        return raw
    frames, length = LIMITS[verbosity]

    def shorten(text):
        trace = F.when(event_type == "ERROR", shorten_trace(text, frames)).otherwise(text)
        return let(trace, lambda t: F.when(t != text, t).otherwise(truncate(text, length)))
    return let(strip_fields(raw, fields), shorten)


def compaction_report(rows: DataFrame, keys: list[str], before: str = "raw", after: str = "compacted") -> DataFrame:
    """Token estimates before and after, and the saved share in percent."""
    totals = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.sum(estimate_tokens(F.col(before))).alias("tokens_before"),
        F.sum(estimate_tokens(F.col(after))).alias("tokens_after"))
    saved = (F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before") * 100
    return totals.withColumn("saved_pct", F.when(F.col("tokens_before") > 0, saved).otherwise(F.lit(0.0)))
