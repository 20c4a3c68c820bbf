"""Hard negatives from scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.tables import read_table, write_table

PAIR = ["frame0_id", "frame1_id", "delta"]


def hard_negatives(scored: DataFrame, top_k: int, floor: float | None = None, most: int | None = None) -> DataFrame:
    """Best ``top_k`` distinct negative pairs of each source version, best first, with ``rank_in_video`` from 0.

    A pair counts once, with its best score (a map-side maximum); ties go by frame and delta. ``most`` keeps the best
    rows of all.
    """
    rows = scored.where("label = 0")
    if floor is not None:
        rows = rows.where(F.col("p_positive") >= floor)
    pairs = rows.groupBy("source_version_id", "stable_source_id", "game", "video_id", *PAIR).agg(F.max("p_positive").alias("p_positive"))
    order = Window.partitionBy("source_version_id").orderBy(F.desc("p_positive"), *PAIR)
    kept = pairs.withColumn("rank_in_video", F.row_number().over(order) - 1).where(F.col("rank_in_video") < top_k)
    if most is None:
        return kept
    return kept.orderBy(F.desc("p_positive"), "source_version_id", "rank_in_video").limit(most)


def collapse(mined: DataFrame, subtype: str | None = None) -> DataFrame:
    """One row a source: its hardest pair's score, and the first version in order that has it. Sources with several versions are in :func:`mixed_versions`."""
    best = mined.groupBy("stable_source_id").agg(F.min_by("source_version_id", F.struct(-F.col("p_positive"), "source_version_id")).alias("source_version_id"), F.max("p_positive").alias("p_positive"))
    return best.withColumn("negative_subtype", F.lit(subtype).cast("string"))


def mixed_versions(mined: DataFrame) -> DataFrame:
    """Sources with more than one version, or rows without one."""
    versions = mined.groupBy("stable_source_id").agg(F.count_distinct("source_version_id").alias("n_versions"), F.sum((F.coalesce("source_version_id", F.lit("")) == "").cast("int")).alias("n_missing"))
    return versions.where("n_versions > 1 or n_missing > 0")


def stale(mined: DataFrame, index: DataFrame) -> DataFrame:
    """Mined sources whose version is not the index's now; a source that is gone is stale too."""
    now = index.select("stable_source_id", F.col("source_version_id").alias("current_version")).distinct()
    return mined.join(now, "stable_source_id", "left").where(~F.col("source_version_id").eqNullSafe(F.col("current_version")))


MANIFEST = "stable_source_id string, source_version_id string, negative_subtype string, p_positive double, rank_in_video int"


def write_manifest(mined: DataFrame, path: str) -> None:
    """Mined rows with the manifest's columns and types; what a row does not bring is empty text, 0 or null."""
    defaults = {"stable_source_id": F.lit(""), "source_version_id": F.lit(""), "negative_subtype": F.lit(None), "p_positive": F.lit(None), "rank_in_video": F.lit(0)}
    wanted = [(c.split()[0], c.split()[1]) for c in MANIFEST.split(", ")]
    columns = [(F.coalesce(F.col(name), defaults[name]) if name in mined.columns else defaults[name]).cast(kind).alias(name) for name, kind in wanted]
    write_table(mined.select(*columns), path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, [c.split()[0] for c in MANIFEST.split(", ")])
