"""Videos, legal frame pairs and what is counted over them.

A pair joins a frame with the one ``delta`` later in the same ``(game, label, video)``. Counts never join: on distinct
frames, a RANGE frame of exactly ``delta`` says whether the partner exists, so all deltas cost one shuffle by video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import stable_source_id
from tessera.schemas import DELTAS

VIDEO = ["game", "label", "video_id"]


def distinct_frames(frames: DataFrame, keys: list[str] = VIDEO) -> DataFrame:
    return frames.select(*keys, "frame_id").distinct()


def has_partner(delta: int, keys: list[str] = VIDEO) -> Column:
    """1 where a frame ``delta`` later exists; for distinct frames."""
    window = Window.partitionBy(*keys).orderBy("frame_id").rangeBetween(delta, delta)
    return F.count(F.lit(1)).over(window)


def with_partners(frames: DataFrame, deltas: tuple[int, ...] = DELTAS, keys: list[str] = VIDEO) -> DataFrame:
    """Distinct frames with ``pairs_d`` flags, one for each delta."""
    return distinct_frames(frames, keys).withColumns({f"pairs_{d}": has_partner(d, keys) for d in deltas})


def pair_counts(frames: DataFrame, deltas: tuple[int, ...] = DELTAS) -> DataFrame:
    """``game, label, delta, n_pairs``."""
    sums = with_partners(frames, deltas).groupBy("game", "label").agg(*[F.sum(f"pairs_{d}").alias(str(d)) for d in deltas])
    return sums.unpivot(["game", "label"], [str(d) for d in deltas], "delta", "n_pairs").withColumn("delta", F.col("delta").cast("int"))


def build_pairs(frames: DataFrame, delta: int) -> DataFrame:
    """``game, label, video_id, frame0_id, frame1_id, delta``: the pairs themselves, by a self join on the video's key."""
    if delta <= 0:
        raise ValueError("delta is positive")
    left = distinct_frames(frames)
    right = left.select(*VIDEO, (F.col("frame_id") - delta).alias("frame_id"), F.col("frame_id").alias("frame1_id"))
    joined = left.join(right, [*VIDEO, "frame_id"])
    return joined.select(*VIDEO, F.col("frame_id").alias("frame0_id"), "frame1_id", F.lit(delta).alias("delta"))


def enumerate_pairs(frames: DataFrame, deltas: tuple[int, ...] = DELTAS) -> DataFrame:
    """Pairs of all deltas from one pass: a lead over each video, no join."""
    flags = with_partners(frames, deltas)
    wanted = F.explode(F.array_compact(F.array(*[F.when(F.col(f"pairs_{d}") > 0, F.lit(d)) for d in deltas])))
    pairs = flags.select(*VIDEO, F.col("frame_id").alias("frame0_id"), wanted.alias("delta"))
    return pairs.withColumn("frame1_id", F.col("frame0_id") + F.col("delta"))


def summarize_videos(frames: DataFrame, keys: list[str] = VIDEO, deltas: tuple[int, ...] = DELTAS) -> DataFrame:
    """Per video: distinct frames, first, last, and pairs of each delta."""
    sums = [F.sum(f"pairs_{d}").cast("long").alias(f"pairs_delta{d}") for d in deltas]
    return with_partners(frames, deltas, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frame_count"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), *sums
    )


def video_entries(frames: DataFrame, deltas: tuple[int, ...] = DELTAS) -> DataFrame:
    """Per video: sorted frame ids, and for each delta the positions at which a pair can start."""
    flags = [f"pairs_{d}" for d in deltas]
    rows = with_partners(frames, deltas).groupBy(*VIDEO).agg(F.array_sort(F.collect_list(F.struct("frame_id", *flags))).alias("rows"))

    def starts(flag: str) -> Column:
        positions = F.sequence(F.lit(0), F.size("rows") - 1)
        return F.filter(positions, lambda i: F.get("rows", i)[flag] > 0)

    return rows.select(*VIDEO, F.col("rows.frame_id").alias("frame_ids"), *[starts(flag).alias(f"valid_starts_delta{d}") for flag, d in zip(flags, deltas)])


def source_groups(frames: DataFrame, mode: str, deltas: tuple[int, ...] = DELTAS) -> DataFrame:
    """Per stable source id: its labels, and per label its frames and pairs; pairs never join labels."""
    flags = with_partners(frames, deltas).withColumn("stable_source_id", stable_source_id(mode=mode))
    measure = lambda label, c, name: F.coalesce(F.sum(F.when(F.col("label") == label, F.col(c) if c else F.lit(1))), F.lit(0)).cast("long").alias(name)
    columns = []
    for label in (0, 1):
        columns.append(measure(label, None, f"frame_count_label{label}"))
        columns += [measure(label, f"pairs_{d}", f"valid_pair_count_label{label}_delta{d}") for d in deltas]
    return flags.groupBy("game", "stable_source_id").agg(F.array_sort(F.collect_set("label")).alias("labels"), *columns)


def strata(groups: DataFrame, delta: int) -> DataFrame:
    """Per ``(game, label)``: sources and pairs; a source with both labels counts in both."""
    per = [F.struct(F.lit(x).alias("label"), F.col(f"valid_pair_count_label{x}_delta{delta}").alias("pairs")) for x in (0, 1)]
    each = groups.select("game", "stable_source_id", "labels", F.explode(F.array(*per)).alias("s")).where(F.array_contains("labels", F.col("s.label")))
    return each.groupBy("game", F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n_sources"), F.sum("s.pairs").alias("total_pairs"))


def identity_precheck(groups: DataFrame, delta: int = 2) -> DataFrame:
    """Sources with one label and with both, and their totals."""
    mixed = F.size("labels") > 1
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.groupBy("game").agg(
        F.sum((~mixed).cast("long")).alias("single_label_sources"),
        F.sum(mixed.cast("long")).alias("mixed_label_sources"),
        *[total(f"frame_count_label{x}").alias(f"frames_label{x}") for x in (0, 1)],
        *[total(f"valid_pair_count_label{x}_delta{delta}").alias(f"pairs_label{x}") for x in (0, 1)],
    )


def games_missing_labels(frames: DataFrame) -> DataFrame:
    seen = frames.groupBy("game").agg(F.collect_set("label").alias("seen"))
    return seen.select("game", F.explode(F.array_except(F.array(F.lit(0), F.lit(1)), "seen")).alias("missing_label"))


def split_report(frames: DataFrame) -> DataFrame:
    """Counts of a frame table by game, by label, by both and in total, in one pass over the groups."""
    grouped = frames.groupBy("game", "label", "video_id").agg(F.count(F.lit(1)).alias("n"))
    sets = grouped.cube("game", "label").agg(F.sum("n").alias("n_frames"), F.count_distinct("game", "label", "video_id").alias("n_videos"), F.grouping_id().alias("g"))
    level = F.element_at(F.array(F.lit("game_label"), F.lit("game"), F.lit("label"), F.lit("all")), F.col("g").cast("int") + 1)
    return sets.select(level.alias("level"), "game", "label", "n_frames", "n_videos")


def ordered_positions(pairs: DataFrame) -> DataFrame:
    """Pairs with ``position``, their rank in the order delta, game, label, video, frame.

    Ranks are counted within videos and shifted by running counts of videos within ``(delta, game, label)`` and of
    those groups, so no task sorts more than the videos of one group.
    """
    group = ["delta", "game", "label"]
    inside = Window.partitionBy(*group, "video_id").orderBy("frame0_id")
    per_video = pairs.groupBy(*group, "video_id").agg(F.count(F.lit(1)).alias("n"))
    videos = per_video.withColumn("before", F.sum("n").over(Window.partitionBy(*group).orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1)))
    per_group = per_video.groupBy(*group).agg(F.sum("n").alias("n"))
    groups = per_group.withColumn("shift", F.sum("n").over(Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1))).drop("n")  # a row a group
    starts = videos.join(groups, group).select(*group, "video_id", (F.coalesce("before", F.lit(0)) + F.coalesce("shift", F.lit(0))).alias("start"))
    return pairs.withColumn("r", F.row_number().over(inside)).join(starts, [*group, "video_id"]).withColumn("position", F.col("start") + F.col("r") - 1).drop("r", "start")


def subsample(positioned: DataFrame, k: int) -> DataFrame:
    """``k`` rows spread evenly over the positions, ends included, all if there are no more: the positions that
    ``i * ((n - 1) / (k - 1))`` truncates to, in doubles, the last one exact."""
    n = positioned.agg(F.max("position")).first()[0]
    n = 0 if n is None else n + 1
    if n <= k:
        return positioned
    step = (n - 1) / (k - 1) if k > 1 else 0.0
    at = [int(i * step) for i in range(k - 1)] + [n - 1 if k > 1 else 0]
    return positioned.where(F.col("position").isin(sorted(set(at)))) if k <= 10_000 else _subsample_wide(positioned, n, k, step)


def _subsample_wide(positioned: DataFrame, n: int, k: int, step: float) -> DataFrame:
    spark = positioned.sparkSession
    wanted = spark.range(k).select(F.when(F.col("id") == k - 1, F.lit(n - 1)).otherwise(F.floor(F.col("id") * F.lit(step))).cast("long").alias("position"))
    return positioned.join(wanted.distinct(), "position", "left_semi")


def shard(positioned: DataFrame, rank: int, world: int) -> DataFrame:
    """The rows one of ``world`` workers evaluates."""
    return positioned.where(F.pmod("position", F.lit(world)) == rank)


def cap_starts(entries: DataFrame, most: int, deltas: tuple[int, ...] = DELTAS) -> DataFrame:
    """At most the first ``most`` starts of each video and delta."""
    return entries.withColumns({f"valid_starts_delta{d}": F.slice(f"valid_starts_delta{d}", 1, most) for d in deltas})


def index_bytes(entries: DataFrame, deltas: tuple[int, ...] = DELTAS) -> DataFrame:
    """Payload bytes of the index, by game."""
    arrays = ["frame_ids", *[f"valid_starts_delta{d}" for d in deltas]]
    size = F.octet_length("game") + F.octet_length("video_id") + sum((4 * F.size(a) for a in arrays), F.lit(0))
    return entries.groupBy("game").agg(F.sum(size).cast("long").alias("payload_bytes"))


def pair_index(pairs: DataFrame) -> DataFrame:
    """Starts by ``game, label, video_id, delta``."""
    return pairs.groupBy("game", "label", "video_id", "delta").agg(F.array_sort(F.collect_list("frame0_id")).alias("starts"))


def pair_lookup(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """Places in ``frame_ids`` of the frames of asked pairs (a video's key, ``frame_id``, ``delta``).

    ``position`` and ``partner`` count from 0; a frame that the video does not have has none.
    """
    place = lambda x: F.nullif(F.array_position("frame_ids", x), F.lit(0)) - 1
    joined = asked.join(entries.select(*VIDEO, "frame_ids"), VIDEO, "left")
    return joined.select(*VIDEO, "frame_id", "delta", place(F.col("frame_id")).alias("position"), place(F.col("frame_id") + F.col("delta")).alias("partner"))


def group_catalog(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` with ``group_id``, gapless from 0 in their order; numbered inside the first key and shifted by what comes before."""
    rows = pairs.select(*keys).distinct()
    per_first = rows.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(keys[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a game
    shifts = per_first.select(keys[0], before.alias("shift"))
    inside = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys)) - 1
    return rows.join(shifts, keys[0]).select(*keys, (F.col("shift") + inside).cast("long").alias("group_id"))
