import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from taxalog.functions.text import format_duration
from taxalog.operators.dedup import anchored_groups, arrival_clock, deduplicate, total_count, windows_per_chunk

T0 = datetime(2026, 3, 1, tzinfo=timezone.utc)
COLUMNS = "seq long, type string, category string, severity string, timestamp timestamp, summary string, confidence double, raw string, count int"


def events(spark, rows, summary="s"):
    """rows: (key letter, seconds) in arrival order"""
    data = [(i, k, "c", "error", T0 + timedelta(microseconds=round(t * 1e6)), summary, 0.9, "r", 0)
            for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS)


def run(spark, rows, window=5.0, **kw):
    out = deduplicate(events(spark, rows), window, **kw).orderBy("seq").collect()
    return [(r["type"], r["seq"], r["count"]) for r in out]


def model(rows, window):
    """(key, ts, seq) in order to {(key, anchor): [n, latest, first seq]}"""
    open_, groups = {}, {}
    for key, ts, seq in rows:
        if key in open_ and ts - open_[key] <= window:
            g = groups[key, open_[key]]
            g[0] += 1
            g[1] = max(g[1], ts)
        else:
            open_[key] = ts
            groups[key, ts] = [1, ts, seq]
    return groups


@pytest.mark.parametrize("rows, want", [
    ([("A", 0), ("B", 1), ("C", 2)], [("A", 0, 0), ("B", 1, 0), ("C", 2, 0)]),
    ([("A", t) for t in range(5)], [("A", 0, 5)]),
    ([("A", 0), ("B", .5), ("A", 1), ("A", 2), ("B", 3)], [("A", 0, 3), ("B", 1, 2)]),
    ([("A", t) for t in (0, 2, 4, 10, 12)], [("A", 0, 3), ("A", 3, 2)]),
    ([("A", 0), ("A", 5)], [("A", 0, 2)]),
    ([("A", 0), ("A", 5.000001)], [("A", 0, 0), ("A", 1, 0)]),
    ([("A", 0), ("A", 6), ("A", 1), ("A", 11.5)], [("A", 0, 0), ("A", 1, 2), ("A", 3, 0)]),
    ([("A", 1), ("A", 1), ("A", 1)], [("A", 0, 3)]),
])
def test_small_cases(spark, rows, want):
    assert run(spark, rows) == want


def test_time_order_sorts_first(spark):
    assert run(spark, [("A", 6), ("A", 0), ("A", 1)], order="time") == [("A", 0, 0), ("A", 1, 2)]


def test_empty_input(spark):
    assert run(spark, []) == []


def test_summary_and_head(spark):
    rows = events(spark, [("A", i * 6) for i in range(47)], "connection refused")
    [row] = deduplicate(rows, 600).collect()
    assert row["summary"] == "connection refused (x47 in 4m36s)"
    assert row["timestamp"].replace(tzinfo=timezone.utc) == T0 or row["seq"] == 0


@pytest.mark.parametrize("seed", range(4))
def test_against_model(spark, seed):
    """Dense, sparse and bursty keys, with chunks and spans small enough to be crossed often."""
    rnd = random.Random(seed)
    rows, window = [], 1000
    for key, step in (("hot", 3), ("mid", 400), ("rare", 2500), ("grid", 0)):
        t = rnd.randrange(10_000)
        for _ in range(1500):
            t += rnd.randrange(2 * step) if step else 250
            if rnd.random() < .01:
                t += 20_000
            rows.append((key, t))
    rows.sort(key=lambda r: r[1])
    rows = [(k, t, i) for i, (k, t) in enumerate(rows)]
    want = {k: tuple(v) for k, v in model(rows, window).items()}
    points = spark.createDataFrame(rows, "key string, ts long, seq long").repartition(5)
    got = anchored_groups(points, window, chunk_windows=rnd.choice([1, 3, 8]), span_chunks=rnd.choice([2, 5])).collect()
    assert {(r["key"], r["anchor"]): (r["n"], r["latest"], r["first_seq"]) for r in got} == want


def test_chunks_follow_the_density(spark):
    dense = spark.range(1000).select(F.lit("a").alias("key"), F.col("id").alias("ts"))
    assert windows_per_chunk(dense, 100, aim=1000) == 10
    assert windows_per_chunk(dense, 1000, aim=50) == 1
    assert windows_per_chunk(dense.filter("false"), 100) == windows_per_chunk(dense.filter("ts % 100 = 0"), 1) == 4096


@pytest.mark.parametrize("seed", range(3))
def test_arrival_order_against_model(spark, seed):
    rnd = random.Random(100 + seed)
    rows, t = [], {"a": 0, "b": 0}
    for i in range(3000):
        key = rnd.choice("aaab")
        t[key] += rnd.randrange(200)
        rows.append((key, t[key] - rnd.choice([0, 0, 0, rnd.randrange(3000)]), i))
    want = {k: tuple(v) for k, v in model(rows, 1000).items()}
    points = spark.createDataFrame(rows, "key string, ts long, seq long").repartition(5)
    clock = arrival_clock(points, "key", "ts", "seq", bucket=64)
    got = anchored_groups(clock, 1000, chunk_windows=2, span_chunks=3).collect()
    assert {(r["key"], r["anchor"]): (r["n"], r["latest"], r["first_seq"]) for r in got} == want


def test_counts_are_conserved_for_any_partitioning(spark):
    rnd = random.Random(5)
    rows = events(spark, [(rnd.choice("AB"), i * .7) for i in range(400)])
    results = []
    for parts in (1, 8):
        out = deduplicate(rows.repartition(parts), 10)
        assert total_count(out).first()["total"] == 400
        results.append(sorted(out.select("seq", "count", "summary").collect()))
    assert results[0] == results[1]


@pytest.mark.parametrize("ms, text", [
    (0, "0ms"), (999, "999ms"), (2500, "2s"), (3500, "4s"), (59700, "60s"), (60000, "1m"), (61000, "1m1s"), (3600000, "60m"),
])
def test_duration_text(spark, ms, text):
    assert spark.range(1).select(format_duration(F.lit(ms * 1000))).first()[0] == text
