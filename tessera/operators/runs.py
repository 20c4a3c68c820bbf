"""Run logs: append-only JSON lines, the latest record of each run, series of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(records: DataFrame, line: str = "line_no") -> DataFrame:
    """The last record of each run, known by ``run_id`` or else ``output_dir``; a maximum, combined map-side.

    A record with neither, null or empty, is a run of its own.
    """
    name = F.coalesce(F.nullif("run_id", F.lit("")), F.nullif("output_dir", F.lit("")))
    key = F.struct(name.alias("name"), F.when(name.isNull(), F.col(line)).alias("own"))
    rest = [c for c in records.columns if c != line]
    best = records.groupBy(key.alias("__key")).agg(F.max(F.struct(F.col(line), *[F.col(c) for c in rest])).alias("r"))
    return best.select("r.*")


def last_records(records: DataFrame, n: int, line: str = "line_no") -> DataFrame:
    return records.orderBy(F.desc(line)).limit(n)


def series(history: DataFrame, split: str, name: str, scope: str | None = None) -> DataFrame:
    """``step, value`` of a metric: rows of the split, and scope if given, whose step and value are numbers."""
    rows = history.where(F.col("split") == split)
    if scope is not None:
        rows = rows.where(F.col("scope") == scope)
    return rows.select("step", F.col(name).cast("double").alias("value")).where("step is not null and value is not null")


def newest(reports: DataFrame, group: list[str], stamp: str = "modified") -> DataFrame:
    """The newest report of each group."""
    return reports.groupBy(*group).agg(F.max_by("path", stamp).alias("path"), F.max(stamp).alias(stamp))


def matching_reports(reports: DataFrame, checkpoint: str, identity: dict[str, str]) -> DataFrame:
    """Reports of a checkpoint with ``problems``: identity fields that differ or are missing on either side."""
    differs = [F.when(F.coalesce(F.col(k) != F.lit(v), F.lit(True)), F.lit(k)) for k, v in identity.items()]
    return reports.where(F.col("checkpoint_sha256") == checkpoint).withColumn("problems", F.array_compact(F.array(*differs)))
