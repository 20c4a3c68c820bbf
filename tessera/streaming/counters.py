"""Evaluation counters over a stream: the batch aggregates are associative, so they run incrementally as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import margin_of_threshold


def read_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def confusion_stream(scored: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Running confusion counts by ``keys``; for output mode complete or update."""
    p, y = F.col("margin") > margin_of_threshold(threshold), F.col("label") == 1
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    return scored.groupBy(*keys).agg(count(p & y, "tp"), count(p & ~y, "fp"), count(~p & y, "fn"), count(~p & ~y, "tn"))


def windowed_scores(scored: DataFrame, time: str, every: str, late: str) -> DataFrame:
    """Means by tumbling window; rows later than ``late`` are left out."""
    return scored.withWatermark(time, late).groupBy(F.window(time, every)).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"))
