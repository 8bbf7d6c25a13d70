"""Writers that publish a result once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.operators import fingerprint


def publish(report: DataFrame, path: str, *partition: str) -> None:
    """The whole report or nothing; a path that exists is refused.

    Spark's commit protocol writes _SUCCESS last; readers take that as the sign.
    """
    report.write.partitionBy(*partition).mode("errorifexists").parquet(path)


def append_once(new: DataFrame, path: str, key: str, content: str) -> DataFrame:
    """Append rows whose id is not there yet; returns the rows that are there with other content."""
    spark: SparkSession = new.sparkSession
    fresh, _, conflicts = fingerprint.appended(spark.read.parquet(path), new, key, content)
    conflicts = conflicts.persist()
    conflicts.count()
    fresh.write.mode("append").parquet(path)
    return conflicts


def export_history(history: DataFrame, path: str) -> None:
    history.write.mode("errorifexists").json(path)
