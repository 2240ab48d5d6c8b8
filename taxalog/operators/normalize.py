"""Raw log rows to canonical events."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalog.functions.text import is_blank, summarize
from taxalog.operators.classify import MODEL_THRESHOLD, UNCLASSIFIED, LexicalEmbedder, path_category, path_type, resolve
from taxalog.operators.compact import compact
from taxalog.operators.taxonomy import by_root, taxonomy
from taxalog.options import Options
from taxalog.schemas import EVENT_FIELDS

EMPTY = "empty_input"


def default_time(logs: DataFrame, now: datetime | None = None, column: str = "ts") -> DataFrame:
    """Rows without a time get one common time of arrival."""
    arrival = F.lit(now or datetime.now(timezone.utc)).cast("timestamp")
    return logs.withColumn(column, F.coalesce(F.col(column).cast("timestamp"), arrival))


def classify(logs: DataFrame, labels: DataFrame, embedder=None, threshold: float | None = None,
             raw: str = "raw") -> DataFrame:
    """Adds ``type, category, severity, confidence, error``; blank rows skip the embedder.

    Without a threshold that of the embedder holds.
    """
    text, embedder = F.col(raw), embedder or LexicalEmbedder()
    if threshold is None:
        threshold = getattr(embedder, "threshold", MODEL_THRESHOLD)
    match, error = embedder.match(F.when(~is_blank(text), text), labels)
    blank = F.struct(F.lit(f"{UNCLASSIFIED}.{EMPTY}").alias("path"), F.lit("warning").alias("severity"),
                     F.lit(0.0).alias("confidence"))
    matched = logs.withColumn("_match", match).withColumn("error", error)
    found = matched.withColumn("_found", F.when(is_blank(text), blank)
                               .otherwise(resolve(F.col("_match"), labels, threshold)))
    return (found.withColumn("type", path_type(F.col("_found.path")))
            .withColumn("category", path_category(F.col("_found.path")))
            .withColumn("severity", F.col("_found.severity"))
            .withColumn("confidence", F.col("_found.confidence"))
            .drop("_match", "_found"))


def normalize(logs: DataFrame, labels: DataFrame | None = None, embedder=None,
              options: Options = Options()) -> DataFrame:
    """``seq`` plus the canonical event columns plus ``error``.

    Rows whose embedding failed keep their ``error`` and are to be split off
    with ``split_rejects``; source and metadata are not carried over.
    """
    options.validate()
    labels = taxonomy(logs.sparkSession) if labels is None else labels
    found = classify(logs, labels, embedder, options.threshold)
    raw, blank = F.col("raw"), is_blank(F.col("raw"))
    shortened = compact(F.when(~blank, raw), F.col("type"), options.verbosity, options.strip_fields)
    return found.select(
        "seq", "type", "category", "severity", F.col("ts").alias("timestamp"),
        F.when(blank, F.lit("")).otherwise(summarize(raw)).alias("summary"),
        "confidence",
        F.when(blank, raw).otherwise(shortened).alias("raw"),
        F.lit(0).alias("count"), "error")


def split_rejects(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and the rows a failing model call left behind."""
    return (events.filter(F.col("error").isNull()).drop("error"),
            events.filter(F.col("error").isNotNull()))


def by_severity(events: DataFrame, *levels: str) -> DataFrame:
    return events.filter(F.col("severity").isin(*levels))


class Normalizer:
    """The call surface for users: taxonomy, embedder and options in one place."""

    def __init__(self, spark: SparkSession, roots=None, embedder=None, options: Options = Options()):
        self.spark = spark
        self.options = options.validate()
        self.embedder = embedder or LexicalEmbedder()
        self.labels = taxonomy(spark, roots)

    def classify_logs(self, logs: DataFrame, now: datetime | None = None) -> DataFrame:
        """Events of structured logs; a missing time becomes the time of the call."""
        return self.classify_or_reject(logs, now)[0]

    def classify_or_reject(self, logs: DataFrame, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
        """The events, and the rows that the model failed on, with their ``error``."""
        good, rejected = split_rejects(normalize(default_time(logs, now), self.labels, self.embedder, self.options))
        return good.select("seq", *EVENT_FIELDS), rejected

    def classify_texts(self, texts: DataFrame, text: str = "text", now: datetime | None = None) -> DataFrame:
        """Events of a DataFrame with one text column."""
        logs = texts.select(F.monotonically_increasing_id().alias("seq"), F.lit(None).cast("timestamp").alias("ts"),
                            F.col(text).alias("raw"))
        return self.classify_logs(logs, now)

    def taxonomy(self) -> DataFrame:
        return by_root(self.labels)


def event_fields(events: DataFrame, verbosity: str) -> DataFrame:
    """Minimal output carries neither the raw text nor the confidence."""
    if verbosity != "minimal":
        return events
    return events.withColumn("raw", F.lit("")).withColumn("confidence", F.lit(0.0))


def event_json(verbosity: str = "standard", pretty: bool = False) -> Column:
    """JSON text of an event; zero confidence, raw and count are left out."""
    names = [n for n in EVENT_FIELDS if verbosity != "minimal" or n not in ("raw", "confidence")]
    empty = {"confidence": F.lit(0.0), "raw": F.lit(""), "count": F.lit(0)}
    stamp = F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    # Only the fraction loses its trailing zeros, and the dot with the last of them.
    fields = [(F.regexp_replace(stamp, r"(T[0-9:]+)(?:\.0+|(\.[0-9]*[1-9])0*)(Z|[+-][0-9]{2}:[0-9]{2})$", "$1$2$3") if n == "timestamp" else
               F.nullif(F.col(n), empty[n]) if n in empty else F.col(n)).alias(n) for n in names]
    return F.to_json(F.struct(*fields), {"pretty": "true"} if pretty else {})
