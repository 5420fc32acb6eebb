"""Operations of a training-data pipeline over whole texts."""

from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts cross to Python in batches of fewer rows than Spark's default, so that a task holds few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
