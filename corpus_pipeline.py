"""From raw documents to a training set, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and hands the table to the next stage.
"""

from pyspark.sql import DataFrame, SparkSession

from taxalog.llm import decontaminate, language, line_dedup, mixing, simhash_dedup
from taxalog.storage import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model, trained on the labelled ones, recognises."""
    return language.known(docs, language.train(docs))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the long lines that at least five documents share."""
    return line_dedup.drop_shared_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that SimHash prints of four-word shingles connect at four bits or fewer."""
    return simhash_dedup.keep_first(docs, simhash_dedup.WIDTH, simhash_dedup.RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix takes, in training order."""
    return mixing.arrange(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", shared_lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mix", source_mix),
]

#: The model of the first stage has no SQL form; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
