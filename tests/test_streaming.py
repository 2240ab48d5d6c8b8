import json
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taxalog.operators.batching import local_batches, ordered_batches, payloads
from taxalog.operators.classify import ModelEmbedder
from taxalog.operators.dedup import deduplicate, total_count
from taxalog.operators.evaluate import observe_counts
from taxalog.operators.normalize import Normalizer, event_json, normalize
from taxalog.options import Options
from taxalog.plans.catalog import PickyModel
from taxalog.plans.jobs import query
from taxalog.storage import work_path
from taxalog.sources.logs import stream_lines, stream_pages
from taxalog.streaming import sinks
from taxalog.streaming.streams import (UNTIL_END, CountListener, buffered, counted_events, event_time_dedup, fold_times, left_open, start,
                                       use_rocksdb, with_rejects)

T0 = datetime(2026, 3, 1, tzinfo=timezone.utc)
COLUMNS = "seq long, type string, category string, severity string, timestamp timestamp, summary string, confidence double, raw string, count int"


def event_rows(pairs):
    return [(i, k, "c", "error", T0 + timedelta(microseconds=round(t * 1e6)), f"s{i}", 0.9, f"r{i}", 0)
            for i, (k, t) in enumerate(pairs)]


def landed(spark, tmp_path, parts):
    """One parquet file per part, in order of arrival; returns the stream."""
    path = str(tmp_path / "in")
    seq = 0
    for i, part in enumerate(parts):
        rows = [(seq + r[0], *r[1:]) for r in event_rows(part)]
        seq += len(rows)
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)
    return path, spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_micro_batches_do_not_share_groups(spark, tmp_path):
    path, stream = landed(spark, tmp_path, [[("A", 0), ("A", 1)], [("A", 2), ("B", 3)]])
    out = str(tmp_path / "out")
    buffered(stream, sinks.parquet(out), 5, str(tmp_path / "cp"), UNTIL_END, direct=True).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted(r["count"] for r in rows.collect()) == [0, 0, 2]
    assert total_count(rows).first()["total"] == 4


def short(rows):
    return sorted((r["type"], r["seq"], r["count"], r["summary"], r["timestamp"]) for r in rows.collect())


def settle(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()


@pytest.fixture
def listener(spark):
    use_rocksdb(spark)
    listener = CountListener()
    spark.streams.addListener(listener)
    yield listener
    spark.streams.removeListener(listener)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_event_time_stream_equals_batch(spark, tmp_path, listener):
    parts = [[("A", 0), ("A", 4), ("B", 1), ("A", 1)], [("A", 3), ("A", 6), ("B", 5.5)], [("A", 20), ("B", 7), ("A", 20)],
             [("Z", 40)], [("A", 10)], [("A", 3.5)], [("Z", 500)]]  # 10 comes just in time, 3.5 a batch too late
    path, stream = landed(spark, tmp_path, parts)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    start(event_time_dedup(stream, 5, "18 seconds"), sinks.parquet(out), checkpoint).awaitTermination()
    settle(spark)
    kept = spark.read.parquet(path).filter("timestamp <> '2026-03-01 00:00:03.5'")
    got = short(spark.read.parquet(out))
    assert got == short(deduplicate(kept, 5, "time", direct=True).filter("type <> 'Z' OR timestamp < '2026-03-01 00:05:00'"))
    assert len(got) == 6
    got = sorted(got + short(left_open(spark, checkpoint, 5, direct=True)))
    assert got == short(deduplicate(kept, 5, "time", direct=True)) and len(got) == 7
    assert sum(n for _, n in listener.late) == 1
    assert sum(seen for _, seen, _ in listener.timed) == 14 and not sum(b[2] for b in listener.timed)


def test_event_time_stream_goes_on_after_a_restart(spark, tmp_path, listener):
    parts = [[("A", 0), ("A", 4), ("B", 1)], [("A", 6), ("B", 5.5), ("A", 5)]]
    path, stream = landed(spark, tmp_path, parts)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    start(event_time_dedup(stream, 5, "2 seconds"), sinks.parquet(out), checkpoint).awaitTermination()
    assert short(left_open(spark, checkpoint, 5, direct=True))
    more = [(100 + r[0], *r[1:]) for r in event_rows([("A", 7), ("A", 14), ("B", 300)])]
    spark.createDataFrame(more, COLUMNS).coalesce(1).write.mode("append").parquet(path)
    start(event_time_dedup(stream, 5, "2 seconds"), sinks.parquet(out), checkpoint).awaitTermination()
    got = short(spark.read.parquet(out).unionByName(left_open(spark, checkpoint, 5, direct=True), allowMissingColumns=True))
    assert got == short(deduplicate(spark.read.parquet(path), 5, "time", direct=True))


def test_rows_without_time_or_number_are_counted_and_kept(spark, tmp_path, listener):
    rows = [(None, k, "c", "error", t, f"s{i}", None, f"r{i}", 0)
            for i, (k, t) in enumerate([("A", T0), ("A", None), ("B", None), ("A", T0), (None, T0)])]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    start(event_time_dedup(stream, 5, "1 second"), sinks.parquet(out), checkpoint).awaitTermination()
    settle(spark)
    both = spark.read.parquet(out).unionByName(left_open(spark, checkpoint, 5), allowMissingColumns=True)
    assert total_count(both).first()["total"] == 5
    assert sum(b[1] for b in listener.timed) == 5 and sum(b[2] for b in listener.timed) == 2
    assert sum(n for _, n in listener.late) == 0


def test_fold_of_times():
    rng = np.random.default_rng(0)
    for _ in range(50):
        ts = np.unique(rng.integers(0, 60, 25))
        n, heads = rng.integers(1, 4, len(ts)), pd.DataFrame({"seq": ts * 10})
        cut = int(rng.integers(0, len(ts) + 1))
        want = []
        for t, k in zip(ts.tolist(), n.tolist()):
            if want and t - want[-1][0] <= 7:
                want[-1] = (want[-1][0], t, want[-1][2] + k, want[-1][3])
            else:
                want.append((t, t, k, t * 10))
        first = fold_times(None, ts[:cut], n[:cut], heads[:cut], 7)
        held = first.pop() if first else None
        assert first + fold_times(held, ts[cut:], n[cut:], heads[cut:], 7) == want


def test_rejects_of_a_stream_are_counted_and_kept(spark, tmp_path, listener):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("one\ntwo @ home\n  \nthree\n")
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    rows = counted_events(stream_lines(spark, str(logs)), embedder=ModelEmbedder(PickyModel))
    start(rows, with_rejects(sinks.parquet(out), sinks.parquet(bad)), str(tmp_path / "cp")).awaitTermination()
    settle(spark)
    assert spark.read.parquet(out).count() == 3
    assert [(r.raw, r.error) for r in spark.read.parquet(bad).select("raw", "error").collect()] == [("two @ home", "ValueError: at sign")]
    assert [b[1:] for b in listener.batches] == [(3, 1)]


def test_text_stream_to_events_with_counts(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("connection refused by peer\n\n   \nlogin failed wrong password\r\n")
    listener = CountListener()
    spark.streams.addListener(listener)
    try:
        seen = observe_counts(normalize(stream_lines(spark, str(logs))), "events")
        out = str(tmp_path / "out")
        start(seen, sinks.ndjson(out), str(tmp_path / "cp")).awaitTermination()
        for _ in range(50):
            if listener.batches:
                break
            time.sleep(.1)
    finally:
        spark.streams.removeListener(listener)
    events = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert len(events) == 3
    assert listener.batches[0][1:] == (3, 0)


def test_fan_out_isolates_a_failing_sink(spark):
    seen = []

    def bad(events, batch_id):
        raise RuntimeError("down")

    def good(events, batch_id):
        seen.append(events.count())

    rows = spark.createDataFrame(event_rows([("A", 0), ("B", 1)]), COLUMNS)
    with pytest.raises(ExceptionGroup) as caught:
        sinks.fan_out(bad, good)(rows, 0)
    assert seen == [2] and "down" in str(caught.value.exceptions[0])


def test_payloads(spark):
    rows = spark.createDataFrame(event_rows([("A", i) for i in range(130)]), COLUMNS).repartition(7)
    out = payloads(ordered_batches(rows, bucket=16), event_json("full")).orderBy("batch_id").collect()
    assert [r["n"] for r in out] == [50, 50, 30]
    first = json.loads(out[0]["body"])
    assert [e["summary"] for e in first] == [f"s{i}" for i in range(50)]
    assert list(first[0]) == ["type", "category", "severity", "timestamp", "summary", "confidence", "raw"]
    local = payloads(local_batches(rows), event_json("full"))
    assert local.agg(F.sum("n"), F.max("n")).first()[0] == 130


def test_event_json(spark):
    rows = spark.createDataFrame(event_rows([("A", 0.5)]), COLUMNS)
    text = rows.select(event_json("minimal").alias("m"), event_json().alias("s"),
                       event_json(pretty=True).alias("p")).first()
    assert json.loads(text["m"]) == {"type": "A", "category": "c", "severity": "error",
                                     "timestamp": "2026-03-01T00:00:00.5Z", "summary": "s0"}
    assert json.loads(text["s"])["raw"] == "r0" and "count" not in json.loads(text["s"])
    assert "\n" in text["p"]


def test_query_job(spark, tmp_path):
    log = tmp_path / "app.log"
    log.write_text("connection refused by peer\n" * 10 + "login failed wrong password\n")
    out = str(tmp_path / "out")
    rejected = query(spark, "file", [sinks.ndjson(out, "minimal")], T0, T0 + timedelta(hours=1),
                     Normalizer(spark, options=Options(threshold=0.2)), path=str(log))
    events = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert rejected.count() == 0
    assert [(e["type"], e["category"], e.get("count")) for e in events] == [
        ("ERROR", "connection_failure", 10), ("ACCESS", "login_failure", None)]
    assert events[0]["summary"].startswith("connection refused by peer (x10 in ")


def test_work_path_uses_the_session_setting(spark):
    assert work_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_work_path_needs_a_folder_on_a_cluster(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_path(Session(), "x")
    assert work_path(Session(), "x", "/shared").startswith("/shared/x-")


def test_rows_without_id_are_kept(spark, tmp_path):
    rows = [{"message": f"m{k}", "timestamp": 1700000000000 + k, "source": "lambda", "level": "info"} for k in range(4)]
    rows.append(dict(rows[0], id="a"))
    (tmp_path / "in").mkdir()
    for name in ("1.json", "2.json"):  # landed twice
        (tmp_path / "in" / name).write_text(json.dumps({"data": rows, "pagination": {}}))
    out = str(tmp_path / "out")
    stream = stream_pages(spark, "vercel", str(tmp_path / "in"))
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    assert sorted(r["raw"] for r in spark.read.parquet(out).collect()) == ["m0", "m0", "m1", "m2", "m3"]
