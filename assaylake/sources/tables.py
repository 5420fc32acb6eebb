"""Reading and writing at the edges: strings-only metadata, wide and long matrices, CSV, JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions.scratch import shared_dir
from assaylake.model import missing_to_null


def read_metadata(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The first of `paths` that exists, every column a string; lists all of them if none does."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(p, header=True)
    raise FileNotFoundError(", ".join(paths))


def as_strings(df: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata written as CSV and read as strings, without inference."""
    path = f"{shared_dir(df.sparkSession)}/metadata-{uuid.uuid4().hex}"
    df.select(columns).write.csv(path, header=True)
    return read_metadata(df.sparkSession, [path + "-elsewhere", path], columns)


def to_wide(cells: DataFrame, features: list[str]) -> DataFrame:
    """Sample by feature in the given column order; the axis is given, so no pass is spent on finding it."""
    return cells.groupBy("sample_id").pivot("feature_id", features).agg(F.first("value"))


def to_long(wide: DataFrame, features: list[str]) -> DataFrame:
    """One array of the columns, exploded; what was not detected gives no row."""
    v = F.array(*[missing_to_null(F.col(f"`{c}`").cast("double")) for c in features])
    long = wide.select("sample_id", F.posexplode(v).alias("feature_idx", "value")).where("value IS NOT NULL")
    return long.withColumn("feature_id", F.element_at(F.array(*[F.lit(c) for c in features]), F.col("feature_idx") + 1))


def align_check(metadata: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row: identifiers in the metadata only, in the matrix only, in both."""
    both = metadata.select("sample_id", F.lit(1).alias("a")).join(matrix.select("sample_id", F.lit(1).alias("b")), "sample_id", "full")
    return both.agg(F.count(F.when(F.col("b").isNull(), 1)).alias("metadata_only"), F.count(F.when(F.col("a").isNull(), 1)).alias("matrix_only"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both_have"))


def schema_probe(named: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, distinct ids and columns of each table; only the id column is read."""
    out = None
    for name, (df, key) in named.items():
        one = df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_ids")).select(F.lit(name).alias("name"), "n_rows", "n_ids", F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


def long_parquet(df: DataFrame, partition: str) -> DataFrame:
    """Written as Parquet partitioned by cohort, and read back: a filter on the cohort prunes files."""
    path = f"{shared_dir(df.sparkSession)}/long-{uuid.uuid4().hex}"
    df.write.partitionBy(partition).parquet(path)
    return df.sparkSession.read.parquet(path)


def csv_round_trip(cells: DataFrame) -> DataFrame:
    """Five decimals, as written to CSV with a header."""
    path = f"{shared_dir(cells.sparkSession)}/predictions-{uuid.uuid4().hex}"
    cells.select("sample_id", "feature_id", F.format_string("%.5f", "value").alias("value")).write.csv(path, header=True)
    return cells.sparkSession.read.schema("sample_id string, feature_id string, value string").csv(path, header=True)


def strict_json(df: DataFrame, numeric: list[str]) -> DataFrame:
    """A JSON report per row; what is not finite is null, and null fields are kept."""
    return df.withColumn("report", F.to_json(F.struct(*[missing_to_null(c).alias(c) if c in numeric else F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))


def csv_annotated(meta: DataFrame) -> DataFrame:
    """Metadata with each sample's role, written back as CSV."""
    role = F.when(F.col("compound").isin("Water", "DMSO"), "control").when(F.col("compound") == "Quality Control", "qc").otherwise("treatment")
    return as_strings(meta.withColumn("sample_role", role), [*meta.columns, "sample_role"])


def export_csv(df: DataFrame) -> DataFrame:
    """Written as CSV with a header and read back, every column a string."""
    path = f"{shared_dir(df.sparkSession)}/export-{uuid.uuid4().hex}"
    df.write.csv(path, header=True)
    return read_metadata(df.sparkSession, [path], df.columns)
