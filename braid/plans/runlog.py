"""Summaries of the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braid.operators.ranking import upper_median


def events(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("kind") == "event")


def latency_summary(runs: DataFrame) -> DataFrame:
    """Runs, least, greatest, upper-median and mean end-to-end time, mean analytics time. Zero times count as absent."""
    rows = events(runs).select(
        F.nullif(F.col("total_ms"), F.lit(0.0)).alias("total_ms"), F.nullif(F.col("analytics_ms"), F.lit(0.0)).alias("analytics_ms")
    )
    middle = F.lit(upper_median(rows, "total_ms")).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("runs"),
        F.min("total_ms").alias("min_ms"),
        F.max("total_ms").alias("max_ms"),
        F.avg("total_ms").alias("mean_ms"),
        F.avg("analytics_ms").alias("mean_analytics_ms"),
    ).withColumn("median_ms", middle)


def hop_means(runs: DataFrame) -> DataFrame:
    """Mean time per hop over all runs."""
    hops = events(runs).select(F.explode("hops").alias("hop", "ms"))
    return hops.groupBy("hop").agg(F.count(F.lit(1)).alias("runs"), F.avg("ms").alias("mean_ms"))
