"""Tables written to the cluster's shared folder, to cut lineage so that a lost executor costs no restart."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
_of_app: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all runs in one process (as in tests), one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def _app_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when its driver ends."""
    path = f"{shared_dir(spark)}/assaylake-{spark.sparkContext.applicationId}"
    if path not in _of_app:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        store.mkdirs(at)
        store.deleteOnExit(at)
        _of_app.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared folder and read back: its lineage is now files.

    drop() deletes it once nothing reads it; what is read by a result that is handed on stays until the driver ends.
    Spark deletes the shuffles of the writing as soon as it has ended, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path  # type: ignore[attr-defined]
    return out


def drop(df: DataFrame | None) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_written_at", None)
    if path is not None:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
