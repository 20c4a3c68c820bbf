"""Packed frames: fixed-size payloads in numbered shards, read by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.pairs import VIDEO


def layout(frames: DataFrame, per_shard: int = 4096, payload_bytes: int = 1) -> DataFrame:
    """Distinct frames with ``frame_index`` (gapless, by game, label, video, frame), ``shard_id`` and ``offset``.

    Numbers run inside videos and are shifted by the sizes of what comes before, so nothing is sorted in one place but
    the videos of a (game, label).
    """
    rows = frames.select(*VIDEO, "frame_id").distinct()
    per_video = rows.groupBy(*VIDEO).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("game", "label").orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1)
    per_group = per_video.groupBy("game", "label").agg(F.sum("n").alias("n"))
    shift = per_group.withColumn("shift", F.sum("n").over(Window.orderBy("game", "label").rowsBetween(Window.unboundedPreceding, -1))).drop("n")  # a row a group
    starts = per_video.withColumn("before", F.sum("n").over(before)).join(shift, ["game", "label"])
    starts = starts.select(*VIDEO, (F.coalesce("before", F.lit(0)) + F.coalesce("shift", F.lit(0))).alias("start"))
    index = F.col("start") + F.row_number().over(Window.partitionBy(*VIDEO).orderBy("frame_id")) - 1
    return rows.join(starts, VIDEO).withColumn("frame_index", index).drop("start").withColumns(
        {"shard_id": F.floor(F.col("frame_index") / per_shard).cast("long"), "offset": F.pmod("frame_index", F.lit(per_shard)) * F.lit(payload_bytes)}
    )


def contiguity(packed: DataFrame) -> DataFrame:
    """One row: whether indexes run from 0 without a gap or a repeat. Bitmaps tell how many differ, combined before the exchange; null is no index."""
    place = F.col("frame_index").cast("long") + 1
    rows = packed.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
    parts = rows.agg(F.count(F.lit(1)).alias("n"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(place))).alias("different"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    sums = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.sum("different").alias("different"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("different") == F.col("n"))
    return sums.select("n", F.when(F.col("n") == 0, F.lit(True)).otherwise(F.coalesce(whole, F.lit(False))).alias("contiguous"))


def write(packed: DataFrame, path: str) -> None:
    packed.repartitionByRange("shard_id").sortWithinPartitions("frame_index").write.partitionBy("shard_id").parquet(path)


def fetch(packed: DataFrame, wanted: DataFrame, per_shard: int = 4096) -> DataFrame:
    """Rows of the wanted ``frame_index``; the shard in the join key prunes partitions at run time."""
    asked = wanted.select("frame_index").distinct().withColumn("shard_id", F.floor(F.col("frame_index") / per_shard).cast("long"))
    return packed.join(asked, ["shard_id", "frame_index"])


def identity_problems(packed_entries: DataFrame, source_entries: DataFrame) -> DataFrame:
    """``problem`` by video: keys on one side only, other frames, or another content id."""
    a = packed_entries.select(*VIDEO, F.col("frame_ids").alias("__a"), F.col("content_version_id").alias("__ca"), F.lit(1).alias("__in_a"))
    b = source_entries.select(*VIDEO, F.col("frame_ids").alias("__b"), F.col("content_version_id").alias("__cb"), F.lit(1).alias("__in_b"))
    problem = (
        F.when(F.col("__in_a").isNull(), "missing_in_pack").when(F.col("__in_b").isNull(), "unknown_in_source")
        .when(F.col("__a") != F.col("__b"), "frames_differ").when(~F.col("__ca").eqNullSafe(F.col("__cb")), "content_differs")
    )
    return a.join(b, VIDEO, "full_outer").select(*VIDEO, problem.alias("problem")).where("problem is not null")
