"""What files the tables have, and whether they are still those that a stored manifest states."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORED = "manifest.json"  # a line of JSON (file, bytes, sha256) for each file
_FIELDS = "file string, bytes long, sha256 string"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of every Parquet file under the folder, file as the path from there.

    Files are read in pieces where executors can open them, so that one of any size takes little memory; those of
    another file system come as binaryFile rows, which hold a whole file of 2 GB at most.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString().rstrip("/")
    file = F.expr(f"substr(path, {len(root) + 2})").alias("file")
    if not root.startswith("file:"):
        return found.select(file, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def digest(path: str) -> str:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"file": b["file"], "bytes": b["bytes"], "sha256": [digest("/" + p.removeprefix("file:").lstrip("/")) for p in b["path"]]})

    return found.select("path", file, F.col("length").alias("bytes")).repartition("path").mapInPandas(run, _FIELDS)


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{STORED}")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return None
    return spark.read.schema(_FIELDS).json(f"{folder}/{STORED}")


def compare(actual: DataFrame, stated: DataFrame | None) -> DataFrame:
    """(file, bytes, sha256, status): same, stale (size or digest is another), missing (stated only) or unlisted."""
    if stated is None:
        return actual.withColumn("status", F.lit("unlisted"))
    a, b = actual.alias("a"), stated.alias("b")
    same = (F.col("a.bytes") == F.col("b.bytes")) & (F.col("a.sha256") == F.col("b.sha256"))
    status = F.when(F.col("a.file").isNull(), "missing").when(F.col("b.file").isNull(), "unlisted").when(same, "same").otherwise("stale")
    return a.join(b, F.col("a.file") == F.col("b.file"), "full_outer").select(F.coalesce("a.file", "b.file").alias("file"), "a.bytes", "a.sha256", status.alias("status"))
