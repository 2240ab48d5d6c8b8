"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a session whose driver and executors are one process gets
    a temporary folder; on a cluster there is no folder to guess, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share, or pass a path")
    app = spark.conf.get("spark.app.id", "")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="taxalog-")
    return _LOCAL[app]


def work_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path below ``folder``, by default below the shared folder."""
    return f"{(folder or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str, folder: str | None = None, **options) -> DataFrame:
    """Write once, read back: cuts the plan where it would be evaluated several times. ``options`` are the writer's."""
    path = work_path(rows.sparkSession, name, folder)
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
