"""Headline queries, one JSON line. Environment: BENCH_SF_DIR, BENCH_CPUS.

Every query runs once to warm the session up and is then timed once, reading
the tables and producing all rows of its result (no-op sink). Rates count rows and
text bytes of the table that a query reads. Several BENCH_CPUS ("1,2,4,8") add a
run each below "by_cpus"; the last one is the headline.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from taxalog.plans.catalog import Tables, queries

HEADLINE = [
    "normalize_documents", "label_counts", "classify_by_term_join", "classify_dense", "classify_with_model",
    "compact_minimal", "compaction_ratio", "summarize", "token_estimate", "strip_json_fields", "shorten_trace",
    "dedup_event_time", "dedup_arrival_order", "threshold_sweep", "accuracy_by_label", "top_per_chunk",
    "vercel_pages", "payload_batches", "mean_pool", "redact_urls", "word_piece_ids", "stream_direct",
]
#: Tables behind the rates, and the column whose bytes count.
INPUTS = {"normalize_documents": ("documents", "text"), "compact_minimal": ("documents", "text"),
          "classify_by_term_join": ("documents", "text"), "classify_with_model": ("conversations", "text"),
          "dedup_event_time": ("events", "props"), "dedup_arrival_order": ("events", "props"), "stream_direct": ("documents", "text")}


def run(frame):
    frame.write.format("noop").mode("overwrite").save()


def timed(path, cpus, names):
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("taxalog.partitions", cpus)  # one-file tables have too few splits for the cores
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = queries(), {}
    for name in names:
        run(known[name](spark, path))
        start = time.perf_counter()
        run(known[name](spark, path))
        seconds[name] = round(time.perf_counter() - start, 3)
    sizes = {(table, column): Tables(spark, path)[table].selectExpr("count(*)", f"sum(octet_length({column}))").first()
             for table, column in {INPUTS[n] for n in seconds if n in INPUTS}}
    rates = {n: {"rows_per_sec": round(sizes[INPUTS[n]][0] / seconds[n]), "bytes_per_sec": round(sizes[INPUTS[n]][1] / seconds[n])}
             for n in seconds if n in INPUTS}
    spark.stop()
    return seconds, rates


def main():
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = {cpus: timed(path, cpus, sys.argv[1:] or HEADLINE) for cpus in os.environ.get("BENCH_CPUS", "8").split(",")}
    cpus = list(runs)[-1]
    seconds, rates = runs[cpus]
    out = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
           "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "rates": rates}
    if len(runs) > 1:
        out["by_cpus"] = {c: {"queries": s, "rates": r} for c, (s, r) in runs.items()}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
