"""Outcomes as a stream (an extension): files of finished pages are picked up as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id long, page_id long, status string, step string, at timestamp"


def outcome_stream(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_summary(outcomes: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Completed, skipped and failed pages per run and window; rows later than the watermark are not counted."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return outcomes.withWatermark("at", late).groupBy("run_id", F.window("at", window)).agg(n("completed"), n("skipped"), n("failed")).select("run_id", F.col("window.start").alias("start"), "completed", "skipped", "failed")
