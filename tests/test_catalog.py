import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from compare import database, rows_of, sql_rows
from taxalog.plans import catalog

TABLES = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent

needs_tables = pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return database(TABLES)


@needs_tables
@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    out = entry_points.queries()[name](spark, TABLES)
    names, want = sql_rows(db, entry_points.oracle_sql()[name])
    assert sorted(out.columns) == names
    assert rows_of(out.columns, out.collect()) == want


@needs_tables
@pytest.mark.parametrize("name", ["stream_direct", "stream_counts"])
def test_stream_of_a_folder_of_files(spark, db, tmp_path, name):
    spark.read.parquet(f"{TABLES}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = entry_points.queries()[name](spark, str(tmp_path))
    names, want = sql_rows(db, entry_points.oracle_sql()[name])
    assert sorted(out.columns) == names
    assert rows_of(out.columns, out.collect()) == want


@needs_tables
def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_normalization_is_one_narrow_stage(spark):
    from pyspark.sql import functions as F
    from taxalog.operators.normalize import normalize
    logs = spark.range(5).select(F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), F.lit("x").alias("raw"))
    plan = normalize(logs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


@needs_tables
def test_scans_are_pruned_and_filtered(spark):
    plan = entry_points.queries()["time_range_limit"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in plan
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    plan = entry_points.queries()["dedup_event_time"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "value:double" not in plan


def test_no_forbidden_calls():
    for path in ROOT.glob("taxalog/**/*.py"):
        names = {n.attr for n in ast.walk(ast.parse(path.read_text(encoding="utf-8"))) if isinstance(n, ast.Attribute)}
        assert not names & {"localCheckpoint", "crossJoin", "toPandas", "rdd"}, path
