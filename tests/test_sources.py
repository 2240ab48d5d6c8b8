import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from taxalog import schemas
from taxalog.sources import logs as S
from taxalog.streaming import sinks
from taxalog.streaming.streams import start

T0 = datetime(2026, 2, 23, 10, tzinfo=timezone.utc)


def land(path, *pages):
    path.mkdir(parents=True, exist_ok=True)
    for i, page in enumerate(pages):
        (path / f"page{i}.json").write_text(json.dumps(page))
    return str(path)


def instant(row, column="ts"):
    return row[column].astimezone(timezone.utc) if row[column] else None


def test_text_lines(spark, tmp_path):
    log = tmp_path / "app.log"
    log.write_bytes(b"first\r\n\n   \nlone\rreturn\n" + b"x" * (S.MAX_LINE_BYTES + 1) + b"\nlast")
    lines, too_long = S.text_lines(spark, str(log))
    rows = lines.collect()
    assert [r["raw"] for r in rows] == ["first", "   ", "lone\rreturn", "last"]
    assert {(r["source"], r["metadata"]["file"]) for r in rows} == {("file", "app.log")}
    assert lines.columns == schemas.RAW_LOG.fieldNames() and too_long.count() == 1
    assert S.read(spark, "file", path=str(log), n=2).count() == 2


@pytest.mark.parametrize("split", [16, 64, 4096, 128 << 20])
def test_lines_are_numbered_by_file_and_line(spark, tmp_path, split):
    texts = {"a.log": "lone", "b.log": "".join(f"b{i}\r\n" + "\n" * (i % 3) for i in range(200)), "c.log": "", "d.log": "\n" * 90 + "end",
             "e.log": "same\nsame\n" + "x" * (S.MAX_LINE_BYTES + 1) + "\nafter\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    want, at = [], 0
    for name in sorted(texts):
        lines = texts[name].split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        want += [(at + i, name, line.rstrip("\r")) for i, line in enumerate(lines) if line.rstrip("\r")]
        at += len(lines)
    if split < 4096:  # a task per split: no megabyte there
        del want[-2]
        (tmp_path / "e.log").write_text("same\nsame\nafter\n")
        want[-1] = (want[-1][0] - 1, *want[-1][1:])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = S.read(spark, "file", path=str(tmp_path)).collect()
        assert sorted((r["seq"], r["metadata"]["file"], r["raw"]) for r in rows) == want
        first = S.read(spark, "file", path=str(tmp_path), n=7).collect()
        assert [(r["seq"], r["metadata"]["file"], r["raw"]) for r in first] == want[:7]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_line_at_all(spark, tmp_path):
    (tmp_path / "empty.log").write_text("")
    assert S.read(spark, "file", path=str(tmp_path)).collect() == []


def test_vercel(spark, tmp_path):
    entry = {"id": "log_abc", "message": "GET /api/hello 200 in 12ms", "timestamp": 1700000000000, "source": "lambda", "level": "info",
             "proxy": {"statusCode": 200, "path": "/api/hello", "method": "GET", "host": "my-app.vercel.app"}}
    plain = {"id": "log_x", "message": "build", "timestamp": 1700000000500, "source": "build", "level": "info"}
    path = land(tmp_path / "v", {"data": [entry, plain], "pagination": {"next": "c"}}, {"data": [dict(plain, id="p2")], "pagination": {}})
    rows = {r["metadata"]["id"]: r for r in S.read(spark, "vercel", path=path).collect()}
    first = rows["log_abc"]
    assert first["metadata"] == {
        "level": "info", "source": "lambda", "id": "log_abc", "status_code": "200", "path": "/api/hello", "method": "GET", "host": "my-app.vercel.app"}
    assert first["raw"].startswith("GET") and first["source"] == "vercel"
    assert instant(first) == datetime.fromtimestamp(1700000000, timezone.utc)
    assert set(rows["log_x"]["metadata"]) == {"level", "source", "id"} and len(rows) == 3
    assert S.read(spark, "vercel", path=path, n=2).count() == 2


def test_flyio(spark, tmp_path):
    def entry(i, stamp, **meta):
        return {"id": i, "type": "log", "attributes": {"timestamp": stamp, "message": f"m{i}", "level": "info", "instance": "i1", "region": "ord", "meta": meta}}
    path = land(tmp_path / "f", {"data": [entry("1", "2026-02-23T09:00:00Z"), entry("2", "2026-02-23T10:30:00.123Z", custom="value", region="x"),
                                          entry("3", "2026-02-23T12:00:00Z"), entry("4", "broken")], "meta": {}})
    kept = S.read(spark, "flyio", path=path, start=T0, end=T0 + timedelta(hours=1), now=T0 + timedelta(hours=9)).collect()
    assert [(r["raw"], r["metadata"]) for r in kept] == [
        ("m2", {"level": "info", "instance": "i1", "region": "x", "id": "2", "custom": "value"})]
    everything = S.read(spark, "flyio", path=path, now=T0)
    assert {r["raw"]: instant(r) for r in everything.collect()}["m4"] == T0


def test_supabase(spark, tmp_path):
    base = 1700000000123456
    row = {"id": "uuid-123", "timestamp": base, "event_message": "POST /rest/v1/users 200", "extra_field": "extra_value"}
    land(tmp_path / "s" / "table=edge_logs", {"result": [row, dict(row, id="late", timestamp=base + 5_000_000)]})
    land(tmp_path / "s" / "table=auth_logs", {"result": [dict(row, id="mid", timestamp=base + 1_000_000, table="own", n=3, event_message=7)]})
    land(tmp_path / "s" / "table=realtime_logs", {"result": [dict(row, id="other")]})
    start_ = datetime.fromtimestamp(1700000000, timezone.utc)
    rows = S.read(spark, "supabase", path=str(tmp_path / "s"), start=start_, end=start_ + timedelta(hours=48)).collect()
    assert [r["metadata"]["id"] for r in rows] == ["uuid-123", "mid", "late"]
    assert rows[0]["metadata"] == {"table": "edge_logs", "id": "uuid-123", "timestamp": str(base), "extra_field": "extra_value"}
    assert rows[0]["raw"] == "POST /rest/v1/users 200" and instant(rows[0]).microsecond == 123456
    assert rows[1]["raw"] == "" and rows[1]["metadata"]["table"] == "own" and rows[1]["metadata"]["n"] == "3"
    one = S.read(spark, "supabase", path=str(tmp_path / "s"), start=start_, end=start_ + timedelta(hours=1), tables=" realtime_logs ,", n=5)
    assert [r["metadata"]["id"] for r in one.collect()] == ["other"]


def test_supabase_times_that_are_no_numbers(spark, tmp_path):
    land(tmp_path / "p", {"result": [{"id": "a", "timestamp": "soon", "event_message": "x"}, {"id": "b", "event_message": "y"}]})
    pages = spark.read.schema(schemas.SUPABASE_PAGE).json(str(tmp_path / "p")).withColumn("table", F.lit("edge_logs"))
    assert [r["ts"] for r in S.supabase_logs(pages).collect()] == [None, None]


def test_tables_are_checked():
    assert S.select_tables(None) == S.DEFAULT_TABLES and S.select_tables(" , ") == S.DEFAULT_TABLES
    with pytest.raises(ValueError, match="DROP"):
        S.select_tables("users; DROP TABLE--")


def test_chunks(spark):
    rows = spark.range(96).select(F.col("id"), F.lit("edge_logs").alias("table"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    top = S.chunked_top(rows, T0, T0 + timedelta(hours=48), per_chunk=3)
    assert sorted((r["chunk"], r["id"]) for r in top.collect()) == [(0, 0), (0, 1), (0, 2), (1, 24), (1, 25), (1, 26)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert ", Partial" in plan, "rows are cut before the shuffle"


def test_ranges_and_intervals():
    hour = timedelta(hours=1)
    assert S.default_range(None, None, T0) == (T0 - hour, T0)
    assert S.default_range(None, T0) == (T0 - hour, T0)
    assert S.default_range(T0 - 5 * hour, None, T0) == (T0 - 5 * hour, T0)
    assert [S.poll_seconds(t, 5.0) for t in ("2s", "1m30s", "150ms", "", None, "x", "-3s", "0s", "1.5h")] == [2, 90, .15, 5, 5, 5, 5, 5, 5400]
    assert S.poll_trigger("supabase", {}) == {"processingTime": "10000 milliseconds"}


def test_registry(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown source"):
        S.read(spark, "nope")
    with pytest.raises(ValueError, match="stream"):
        S.read(spark, "stdin")
    S.register("numbers", lambda spark, **_: S.read(spark, "file", path=str(tmp_path / "a.log")))
    (tmp_path / "a.log").write_text("one\ntwo\n")
    try:
        assert "numbers" in S.source_names()
        both = S.fan_in(spark, ("numbers", {}), ("file", {"path": str(tmp_path / "a.log")}))
        assert both.count() == 4 and both.select("seq").distinct().count() == 4
    finally:
        del S.SOURCES["numbers"]


def test_marks_per_table(spark):
    rows = spark.createDataFrame([("fast", T0 + timedelta(seconds=s)) for s in (1, 5, 9)] + [("slow", T0 + timedelta(seconds=s)) for s in (2, 4)],
                                 "table string, ts timestamp")
    marks = spark.createDataFrame([("fast", T0 + timedelta(seconds=5))], "table string, mark timestamp")
    new = S.newer_than(rows, marks, T0 + timedelta(seconds=9), T0)
    assert sorted((r["table"], (instant(r) - T0).seconds) for r in new.collect()) == [("slow", 2), ("slow", 4)]
    after = {r["table"]: (instant(r, "mark") - T0).seconds for r in S.next_marks(marks, new).collect()}
    assert after == {"fast": 5, "slow": 4}


def test_page_stream_drops_copies(spark, tmp_path):
    entry = {"id": "a", "message": "m", "timestamp": 1700000000000, "source": "lambda", "level": "info"}
    path = land(tmp_path / "pages", {"data": [entry, dict(entry, id="b")]}, {"data": [dict(entry, id="b"), dict(entry, id="c")]})
    out = str(tmp_path / "out")
    start(S.stream_pages(spark, "vercel", path, maxFilesPerTrigger=1), sinks.parquet(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["metadata"]["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
