"""Tables kept in the shared folder between the jobs of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalogq.session import new_folder


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder; gives it as read back, and its path."""
    spark = df.sparkSession
    path = new_folder(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keep(df: DataFrame, label: str) -> DataFrame:
    """store() for a table that the result still reads."""
    return store(df, label)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
