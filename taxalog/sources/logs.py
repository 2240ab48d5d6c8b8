"""Log sources: text files and landed provider responses, as raw-log rows.

Every reader gives the columns of ``schemas.RAW_LOG``. Provider responses are
JSON files, one page per line or file, read with an explicit schema.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxalog import schemas
from taxalog.functions.text import basename, parse_rfc3339
from taxalog.storage import stored

# Fixed values of the sources.
MAX_LINE_BYTES = 1024 * 1024
CHUNK_HOURS = 24
DEFAULT_TABLES = ("edge_logs", "postgres_logs", "auth_logs", "function_logs")
ALLOWED_TABLES = DEFAULT_TABLES + ("storage_logs", "function_edge_logs", "realtime_logs")
POLL_SECONDS = {"vercel": 5.0, "flyio": 5.0, "supabase": 10.0}


def _no_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def _raw_log(rows: DataFrame, ts: Column, source: str, raw: Column, metadata: Column, *keep: str) -> DataFrame:
    # A stream is numbered per micro-batch, where its order is known.
    seq = F.lit(None).cast("long") if rows.isStreaming else F.monotonically_increasing_id()
    return rows.select(seq.alias("seq"), ts.alias("ts"), F.lit(source).alias("source"),
                       raw.alias("raw"), metadata.alias("metadata"), *keep)


# --- limits, ranges -------------------------------------------------------------

def limit(rows: DataFrame, n: int) -> DataFrame:
    """Zero and below mean no limit."""
    return rows.limit(n) if n > 0 else rows


def in_range(rows: DataFrame, start: datetime | None, end: datetime | None, ts: str = "ts") -> DataFrame:
    """Half-open; a missing bound is open."""
    if start is not None:
        rows = rows.filter(F.col(ts) >= F.lit(start))
    return rows if end is None else rows.filter(F.col(ts) < F.lit(end))


def default_range(start: datetime | None, end: datetime | None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """The last hour, or the hour before a given end."""
    end_or_now = end or now or datetime.now(timezone.utc)
    return start or end_or_now - timedelta(hours=1), end_or_now


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def poll_seconds(text: str | None, default: float) -> float:
    """``1m30s`` to 90.0; anything invalid or not positive gives the default."""
    number_unit = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)"
    if not text or not re.fullmatch(rf"\+?(?:{number_unit})+", text):
        return default
    seconds = sum(float(n) * _UNITS[u] for n, u in re.findall(number_unit, text))
    return seconds if seconds > 0 else default


def select_tables(text: str | None) -> tuple[str, ...]:
    """Comma list of tables, checked against the allowed names before any read."""
    names = tuple(t for t in (part.strip() for part in (text or "").split(",")) if t) or DEFAULT_TABLES
    unknown = [n for n in names if n not in ALLOWED_TABLES]
    if unknown:
        raise ValueError(f"tables not in the allow-list: {', '.join(map(repr, unknown))}")
    return names


# --- text lines -----------------------------------------------------------------

def _lines(lines: DataFrame, source: str, metadata: Column, *keep: str) -> DataFrame:
    text = F.regexp_replace(F.col("value"), r"\r\z", "")
    return (_raw_log(lines, F.current_timestamp(), source, text, metadata, *keep)
            .filter(F.col("raw") != ""))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the start of their split and a number that rises within the split."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"))


def split_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``_file, _start``, the ``_first`` number of each split and the lines before it in ``_offset``.

    One thin row per split is counted inside the scan. Splits are numbered in ranges of
    file name and start: running sums inside a range, and one sum per range before it.
    """
    splits = _placed(spark, path).groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ranged = stored(splits.repartitionByRange("_file", "_start").withColumn("_range", F.spark_partition_id()), "splits")
    before = F.sum("_n").over(W.partitionBy("_range").orderBy("_file", "_start")) - F.col("_n")
    ranges = ranged.groupBy("_range").agg(F.sum("_n").alias("_total"))
    earlier = F.sum("_total").over(W.orderBy("_range")) - F.col("_total")
    return stored(ranged.withColumn("_before", before).join(ranges.select("_range", earlier.alias("_earlier")), "_range")
                  .select("_file", "_start", "_first", (F.col("_earlier") + F.col("_before")).alias("_offset")), "offsets")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines, long ones too; ``seq`` is the number of the line over all files by name, from 0, blank ones counted.

    The scan's own order follows file sizes, so the text is scanned once more to count the
    lines of each split. The offsets are a stored table: Spark broadcasts it while it is below
    its limit and joins by shuffle beyond.
    """
    lines = _placed(spark, path).join(split_offsets(spark, path), ["_file", "_start"])
    seq = F.col("_offset") + F.col("_at") - F.col("_first")
    rows = lines.select("value", F.create_map(F.lit("file"), basename("_file")).alias("_name"), seq.alias("_seq"))
    return _lines(rows, "file", F.col("_name"), "_seq").withColumn("seq", F.col("_seq")).drop("_seq")


def text_lines(spark: SparkSession, path: str, n: int = 0) -> tuple[DataFrame, DataFrame]:
    """Lines of text files as numbered by ``numbered_lines``, and apart from them the lines over 1 MiB.

    ``n`` over 0 keeps the first lines, else all are returned.
    """
    lines = numbered_lines(spark, path)
    fits = F.octet_length("raw") <= MAX_LINE_BYTES
    return first_lines(lines.filter(fits), n), lines.filter(~fits)


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    return limit(lines.orderBy("seq"), n) if n > 0 else lines


def _file_name() -> Column:
    return F.create_map(F.lit("file"), basename(F.col("_metadata.file_path")))


def stream_lines(spark: SparkSession, path: str, source: str = "file", files_per_trigger: int = 0) -> DataFrame:
    """All lines, long ones too, as a stream over a directory; ``source="stdin"`` carries no metadata."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    metadata = _file_name() if source == "file" else _no_metadata()
    return _lines(reader.text(path), source, metadata)


# --- provider pages ---------------------------------------------------------------

def _merged(base: Column, overlay: Column) -> Column:
    """Keys of ``overlay`` win, without relying on a session setting."""
    left = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(overlay), k))
    return F.map_concat(left, overlay)


def vercel_logs(pages: DataFrame, *keep: str) -> DataFrame:
    """Rows of pages in the ``VERCEL_PAGE`` schema, with the position in the page."""
    rows = pages.select(*keep, F.posexplode("data").alias("pos", "e"))
    base = F.create_map(F.lit("level"), F.col("e.level"), F.lit("source"), F.col("e.source"), F.lit("id"), F.col("e.id"))
    proxy = F.create_map(
        F.lit("status_code"), F.coalesce(F.col("e.proxy.statusCode"), F.lit(0)).cast("string"),
        F.lit("path"), F.coalesce(F.col("e.proxy.path"), F.lit("")),
        F.lit("method"), F.coalesce(F.col("e.proxy.method"), F.lit("")),
        F.lit("host"), F.coalesce(F.col("e.proxy.host"), F.lit("")))
    metadata = F.when(F.col("e.proxy").isNotNull(), F.map_concat(base, proxy)).otherwise(base)
    return _raw_log(rows, F.timestamp_millis("e.timestamp"), "vercel", F.coalesce("e.message", F.lit("")), metadata,
                    "pos", *keep)


def flyio_logs(pages: DataFrame, *keep: str, now: datetime | None = None) -> DataFrame:
    """Rows of pages in the ``FLYIO_PAGE`` schema; a bad time becomes ``now``."""
    rows = pages.select(*keep, F.posexplode("data").alias("pos", "e"))
    a = "e.attributes."
    arrival = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    base = F.create_map(F.lit("level"), F.col(a + "level"), F.lit("instance"), F.col(a + "instance"),
                        F.lit("region"), F.col(a + "region"), F.lit("id"), F.col("e.id"))
    meta = F.coalesce(F.col(a + "meta"), _no_metadata())
    return _raw_log(rows, F.coalesce(parse_rfc3339(F.col(a + "timestamp")), arrival), "flyio",
                    F.coalesce(a + "message", F.lit("")), _merged(base, meta), "pos", *keep)


def _text(value: Column) -> Column:
    """A JSON string as its text, any other value as JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def supabase_logs(pages: DataFrame, *keep: str, table: str = "table") -> DataFrame:
    """Rows of pages in the ``SUPABASE_PAGE`` schema plus the name of their table."""
    rows = pages.select(*{table: 0, **dict.fromkeys(keep)}, F.posexplode("result").alias("pos", "e"))
    stamp, message = F.col("e")["timestamp"], F.col("e")["event_message"]
    is_number = F.schema_of_variant(stamp).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    micros = F.when(is_number, F.try_variant_get(stamp, "$", "double").cast("long"))
    is_text = F.schema_of_variant(message) == "STRING"
    raw = F.when(is_text, F.try_variant_get(message, "$", "string"))
    others = F.map_filter("e", lambda k, v: k != "event_message")
    columns = F.transform_values(others, lambda k, v: _text(v))
    metadata = _merged(F.create_map(F.lit("table"), F.col(table)), columns)
    return _raw_log(rows, F.timestamp_micros(micros), "supabase", F.coalesce(raw, F.lit("")), metadata,
                    "pos", *dict.fromkeys([table, *keep]))


def page_order(rows: DataFrame, n: int = 0, page: str = "page_no") -> DataFrame:
    """Pages one after the other, cut inside a page when the limit is reached."""
    return limit(rows.orderBy(page, "pos"), n)


# --- chunked range scans ----------------------------------------------------------

def chunked_top(rows: DataFrame, start: datetime, end: datetime, table: str = "table", ts: str = "ts",
                tie: str = "id", chunk_hours: float = CHUNK_HOURS, per_chunk: int = 1000) -> DataFrame:
    """The first ``per_chunk`` rows of each table and chunk of ``[start, end)``.

    Spark keeps at most ``per_chunk`` rows per chunk in every task before it
    shuffles, so a table with most of the rows costs no more than the others.
    """
    stamp = F.unix_micros(F.col(ts).cast("timestamp"))
    begin = F.unix_micros(F.lit(start).cast("timestamp"))
    chunk = F.floor((stamp - begin) / F.lit(round(chunk_hours * 3_600_000_000)))
    order = W.partitionBy(table, "chunk").orderBy(ts, tie)
    return (in_range(rows, start, end, ts).withColumn("chunk", chunk)
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= per_chunk))


def merged(parts: list[DataFrame], n: int = 0, order=("ts",)) -> DataFrame:
    """Rows of several tables or sources in one order."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return limit(rows.orderBy(*order), n)


# --- incremental reads --------------------------------------------------------------

def newer_than(rows: DataFrame, marks: DataFrame, now: datetime, floor: datetime, table: str = "table",
               ts: str = "ts") -> DataFrame:
    """Rows after their table's mark and before ``now``.

    The mark is kept per table: with one mark for all, a slow table would lose
    rows older than the newest row of a fast one. Tables without a mark start at
    ``floor``.
    """
    mark = marks.select(table, F.col("mark").alias("_mark"))
    return (rows.filter((F.col(ts) < F.lit(now)))
            .join(mark, table, "left")
            .filter(F.col(ts) > F.coalesce(F.col("_mark"), F.lit(floor).cast("timestamp"))).drop("_mark"))


def next_marks(marks: DataFrame, taken: DataFrame, table: str = "table", ts: str = "ts") -> DataFrame:
    seen = taken.groupBy(table).agg(F.max(ts).alias("mark"))
    return marks.select(table, "mark").unionByName(seen).groupBy(table).agg(F.max("mark").alias("mark"))


# --- registry -----------------------------------------------------------------------

def _read_file(spark, path, n=0, **_):
    return first_lines(numbered_lines(spark, path), n)


def _read_stdin(spark, **_):
    raise ValueError("stdin can only be streamed")


def _landed(spark, schema, path):
    """Pages with their place in the landing: file name, then position in the file."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return spark.read.schema(schema).json(path).withColumn("page_no", place)


def _read_vercel(spark, path, start=None, end=None, n=0, **_):
    pages = _landed(spark, schemas.VERCEL_PAGE, path)
    return page_order(in_range(vercel_logs(pages, "page_no"), start, end), n).drop("page_no", "pos")


def _read_flyio(spark, path, start=None, end=None, n=0, now=None, **_):
    pages = _landed(spark, schemas.FLYIO_PAGE, path)
    return page_order(in_range(flyio_logs(pages, "page_no", now=now), start, end), n).drop("page_no", "pos")


def _read_supabase(spark, path, start=None, end=None, n=0, tables=None, now=None, per_chunk=0, **_):
    """Landed pages partitioned by table: ``path/table=edge_logs/*.json``.

    ``per_chunk`` over 0 keeps that many rows of each table and day, as a provider
    that answers a request per day with a page does.
    """
    names = select_tables(tables)
    start, end = default_range(start, end, now)
    pages = (spark.read.schema(schemas.SUPABASE_PAGE).json(path).filter(F.col("table").isin(*names)))
    rows = supabase_logs(pages).withColumn("id", F.col("metadata")["id"])
    kept = chunked_top(rows, start, end, per_chunk=per_chunk) if per_chunk > 0 else in_range(rows, start, end)
    return limit(kept.orderBy("ts", "table", "id"), n).select(*schemas.RAW_LOG.fieldNames())


SOURCES = {"file": _read_file, "stdin": _read_stdin, "vercel": _read_vercel, "flyio": _read_flyio,
           "supabase": _read_supabase}


def register(name: str, reader) -> None:
    """``reader(spark, **options)`` returns raw-log rows."""
    SOURCES[name] = reader


def source_names() -> list[str]:
    return sorted(SOURCES)


def read(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in SOURCES:
        raise ValueError(f"unknown source: {name}")
    return SOURCES[name](spark, **options)


def fan_in(spark: SparkSession, *requests: tuple[str, dict]) -> DataFrame:
    """Rows of several sources; ``seq`` is unique per source only, so it is renumbered."""
    return merged([read(spark, name, **options) for name, options in requests]).withColumn(
        "seq", F.monotonically_increasing_id())


def poll_trigger(name: str, options: dict) -> dict:
    """Arguments for ``writeStream.trigger`` from the source's poll interval."""
    seconds = poll_seconds(options.get("poll_interval"), POLL_SECONDS[name])
    return {"processingTime": f"{max(round(seconds * 1000), 1)} milliseconds"}


def stream_pages(spark: SparkSession, name: str, path: str, delay: str = "10 minutes", **options) -> DataFrame:
    """Stream of landed pages. A page may be landed twice; its rows come out once."""
    schema, rows_of = {"vercel": (schemas.VERCEL_PAGE, vercel_logs), "flyio": (schemas.FLYIO_PAGE, flyio_logs),
                       "supabase": (schemas.SUPABASE_PAGE, supabase_logs)}[name]
    pages = spark.readStream.schema(schema).options(**options).json(path)
    return once(rows_of(pages).drop("pos"), delay)


def once(rows: DataFrame, delay: str) -> DataFrame:
    """Rows of pages landed twice come out once, known by table and id; by time, text and metadata where there is no id."""
    entries = F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))))
    own = F.sha2(F.to_json(F.struct("ts", "raw", entries.alias("metadata"))), 256)
    return (rows.withColumn("_table", F.col("metadata")["table"]).withColumn("_id", F.coalesce(F.col("metadata")["id"], own))
            .withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source", "_table", "_id"]).drop("_table", "_id"))
