"""Quality reports over predictions joined with their expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from taxalog.functions.text import is_blank
from taxalog.operators.classify import UNCLASSIFIED

# Fixed values
THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85)
SEVERITIES = ("error", "warning", "info", "debug")
MIN_GAP = 0.05
MIN_ROWS_PER_LEAF = 2


def judge(predictions: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """``predictions(key, path, severity, confidence)`` with ``expected(key, expected_path, expected_severity)``."""
    return (predictions.join(expected, key)
            .withColumn("is_correct", F.col("path") == F.col("expected_path"))
            .withColumn("is_unclassified", F.col("path") == UNCLASSIFIED))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def _outcomes() -> list[Column]:
    correct, unclassified = F.col("is_correct"), F.col("is_unclassified")
    return [F.count("*").alias("total"), F.count_if(correct).alias("correct"),
            F.count_if(~correct & ~unclassified).alias("incorrect"),
            F.count_if(~correct & unclassified).alias("unclassified")]


def accuracy(judged: DataFrame) -> DataFrame:
    return judged.agg(*_outcomes()).withColumn("accuracy_pct", _percent(F.col("correct"), F.col("total")))


def accuracy_by_path(judged: DataFrame) -> DataFrame:
    return (judged.groupBy("expected_path").agg(*_outcomes())
            .withColumn("accuracy_pct", _percent(F.col("correct"), F.col("total"))))


def misclassified(judged: DataFrame) -> DataFrame:
    return judged.filter(~F.col("is_correct"))


def confidence_distribution(judged: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return judged.groupBy("is_correct").agg(
        F.count("*").alias("n"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))


def threshold_sweep(judged: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Kept rows per threshold; all thresholds are counted in one aggregate."""
    def kept(t, correct):
        right = F.col("is_correct") if correct else ~F.col("is_correct")
        return F.count_if((F.col("confidence") >= t) & right)
    wide = judged.agg(F.array(*[
        F.struct(F.lit(t).alias("threshold"), kept(t, True).alias("correct"), kept(t, False).alias("incorrect"))
        for t in thresholds]).alias("rows"))
    return (wide.select(F.inline("rows"))
            .withColumn("net_accuracy_pct", _percent(F.col("correct"), F.col("correct") + F.col("incorrect"))))


def threshold_suggestion(judged: DataFrame) -> DataFrame:
    """Midpoint between the worst correct and the mean incorrect row, unless the two overlap."""
    c, right = F.col("confidence"), F.col("is_correct")
    gap = F.col("correct_min") - F.col("incorrect_mean")
    return (judged.agg(F.min(F.when(right, c)).alias("correct_min"), F.avg(F.when(~right, c)).alias("incorrect_mean"))
            .withColumn("gap", gap)
            .withColumn("overlap", gap < MIN_GAP)
            .withColumn("suggested", F.when(gap >= MIN_GAP, (F.col("correct_min") + F.col("incorrect_mean")) / 2)))


def severity_consistency(judged: DataFrame) -> DataFrame:
    """Only correctly classified rows are checked."""
    return judged.filter("is_correct").agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("severity") != F.col("expected_severity")).alias("mismatches"))


def leaf_coverage(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Corpus rows per leaf; ``corpus`` has an ``expected_path``. Counted before the join."""
    counts = corpus.groupBy("expected_path").agg(F.count("*").alias("_n"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    return (labels.join(counts, labels["path"] == counts["expected_path"], "left")
            .select("ord", "path", n.alias("n_rows"), (n == 0).alias("missing"),
                    (n < MIN_ROWS_PER_LEAF).alias("too_few")))


def corpus_problems(corpus: DataFrame) -> DataFrame:
    """Blank required fields and severities outside the domain."""
    def empty(name):
        return F.count_if(F.col(name).isNull() | is_blank(F.col(name)))
    return corpus.agg(
        F.count("*").alias("n_rows"),
        empty("raw").alias("blank_raw"), empty("expected_type").alias("blank_type"),
        empty("expected_category").alias("blank_category"), empty("expected_severity").alias("blank_severity"),
        F.count_if(~F.coalesce(F.col("expected_severity"), F.lit("")).isin(*SEVERITIES)).alias("invalid_severity"))


def observe_counts(events: DataFrame, into: Observation | str) -> DataFrame:
    """Written and skipped rows, counted while the events pass by.

    Give an ``Observation`` for a batch, a name for a stream (see ``CountListener``).
    """
    return events.observe(into, F.count_if(F.col("error").isNull()).alias("written"),
                          F.count_if(F.col("error").isNotNull()).alias("skipped"))
