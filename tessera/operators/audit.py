"""Duplicate and leakage audits: what crosses splits or labels, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import SPLITS

#: Severities of the three kinds of repeated content unless a policy says otherwise.
SEVERITY = {"identical_content_with_conflicting_labels": "error", "same_label_content_overlap_across_splits": "warning", "duplicate_content_within_split": "warning"}


def content_duplicates(frames: DataFrame, severity: dict[str, str] | None = None, samples: int = 20) -> DataFrame:
    """``content_sha256, n, labels, splits, kind, severity, samples`` of contents found more than once.

    Contents are counted first; only the first samples of repeated ones are gathered, by their order in the table of
    splits, games and frames.
    """
    severity = SEVERITY | (severity or {})
    hashed = frames.where(F.coalesce("content_sha256", F.lit("")) != "")
    groups = hashed.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("split")).alias("splits")).where("n > 1")
    kinds = list(SEVERITY)
    kind = F.when(F.size("labels") > 1, kinds[0]).when(F.size("splits") > 1, kinds[1]).otherwise(kinds[2])
    level = F.create_map(*[F.lit(x) for pair in severity.items() for x in pair])
    return groups.withColumn("kind", kind).withColumn("severity", level[F.col("kind")])


def duplicate_samples(frames: DataFrame, duplicates: DataFrame, most: int = 20) -> DataFrame:
    """At most ``most`` frames of each repeated content; ranks are cut before the shuffle."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("content_sha256").orderBy("split", "game", "label", "video_id", "frame_id", "path")
    rows = frames.join(duplicates.select("content_sha256"), "content_sha256", "left_semi")
    return rows.withColumn("sample", F.row_number().over(order)).where(F.col("sample") <= most)


def repeated_names(frames: DataFrame) -> DataFrame:
    """Groups of equal file names, and their records: information only."""
    groups = frames.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("group_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"))


def split_overlap(frames: DataFrame, key: list[str]) -> DataFrame:
    """``left_split, right_split, key...``: keys found in two splits, splits in their own order."""
    order = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    held = frames.select(*key, "split").distinct().groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "split"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["o"] > a["o"]), lambda b: F.struct(a["split"].alias("l"), b["split"].alias("r")))))
    return held.where(F.size("s") > 1).select(*key, F.explode(pairs).alias("p")).select(F.col("p.l").alias("left_split"), F.col("p.r").alias("right_split"), *key)


def overlap_content(frames: DataFrame, uid: str = "stable_source_id") -> DataFrame:
    """For each id in two splits: frames of either side whose content the other side has too.

    0 points to numbers used twice; more is a leak. Contents are counted by split first, then compared as arrays of
    three splits at most.
    """
    hashed = frames.where(F.coalesce("content_sha256", F.lit("")) != "")
    counts = hashed.groupBy(uid, "content_sha256", "split").agg(F.count(F.lit(1)).alias("n"))
    a, b = counts.alias("a"), counts.alias("b")
    both = a.join(b, (F.col(f"a.{uid}") == F.col(f"b.{uid}")) & (F.col("a.content_sha256") == F.col("b.content_sha256")) & (F.col("a.split") != F.col("b.split")))
    shared = both.groupBy(F.col(f"a.{uid}").alias(uid), F.col("a.split").alias("left_split"), F.col("b.split").alias("right_split")).agg((F.sum(F.col("a.n") + F.col("b.n"))).alias("shared"))
    over = split_overlap(frames, [uid])
    joined = over.join(shared, [uid, "left_split", "right_split"], "left")
    n = F.coalesce("shared", F.lit(0))
    return joined.select("left_split", "right_split", uid, n.alias("shared_content_frames"), F.when(n == 0, "numbering collision").otherwise("real leakage").alias("hint"))


def findings_by_kind(findings: DataFrame) -> DataFrame:
    return findings.groupBy("split", "severity", "kind").agg(F.count(F.lit(1)).alias("n"))


def violations(
    frames: DataFrame, pair_counts: DataFrame, duplicates: DataFrame, findings: DataFrame | None = None, *, minimum_pairs: dict[int, int] | None = None, test_delta: int = 2, require_hash: bool = True
) -> DataFrame:
    """``rule, subject, detail``: everything that makes a dataset unfit; no rows means it passes.

    ``pair_counts``: ``split, game, label, delta, n_pairs``. Content that crosses splits counts whatever severity a
    policy gave it.
    """
    rules = []
    text = lambda rule, subject, detail: (F.lit(rule).alias("rule"), subject.alias("subject"), detail.alias("detail"))
    spark = frames.sparkSession
    splits = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    present = frames.select("split").distinct()
    rules.append(splits.where("split = 'train'").join(present, "split", "left_anti").select(*text("missing_split", F.col("split"), F.lit("no frames"))))
    missing = frames.groupBy("split", "game").agg(F.collect_set("label").alias("seen"))
    absent = F.array_except(F.array(F.lit(0), F.lit(1)), "seen")
    rules.append(missing.where(F.size(absent) > 0).select(*text("missing_label", F.concat_ws("/", "split", "game"), F.array_join(absent.cast("array<string>"), ","))))
    if minimum_pairs:
        wanted = spark.createDataFrame(list(minimum_pairs.items()), "delta int, minimum long")
        grid = pair_counts.select("split", "game").distinct().crossJoin(F.broadcast(spark.createDataFrame([(0,), (1,)], "label int"))).crossJoin(F.broadcast(wanted))  # a few rows a game
        short = grid.join(pair_counts, ["split", "game", "label", "delta"], "left").withColumn("n", F.coalesce("n_pairs", F.lit(0))).where("n < minimum")
        rules.append(short.select(*text("too_few_pairs", F.concat_ws("/", "split", "game", F.col("label").cast("string"), F.col("delta").cast("string")), F.concat(F.col("n").cast("string"), F.lit(" < "), F.col("minimum").cast("string")))))
    legal = pair_counts.where(F.col("delta") == test_delta).groupBy("split").agg(F.sum("n_pairs").alias("n"))
    needed = splits.where("split = 'test'").unionByName(present.where("split = 'val'")).distinct()
    rules.append(needed.join(legal, "split", "left").where("coalesce(n, 0) <= 0").select(*text("no_legal_pairs", F.col("split"), F.lit(f"delta {test_delta}"))))
    if require_hash:
        from tessera.operators.identity import covers_content

        rules.append(covers_content(frames).where("not content_hash_check_enabled").select(*text("content_not_hashed", F.lit("frames"), F.lit("a frame has no hash"))))
    crossing = F.col("kind") == "same_label_content_overlap_across_splits"
    rules.append(duplicates.where((F.col("severity") == "error") | crossing).select(*text("duplicate_content", F.col("content_sha256"), F.col("kind"))))
    rules.append(split_overlap(frames, ["stable_source_id"]).select(*text("source_in_two_splits", F.col("stable_source_id"), F.concat_ws("/", "left_split", "right_split"))))
    if findings is not None:
        rules.append(findings.where("severity = 'error'").select(*text("finding", F.coalesce("path", F.lit("")), F.col("kind"))))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def require_clean(problems: DataFrame, most: int = 100) -> None:
    """Raises with the first problems, if there are any."""
    rows = problems.orderBy("rule", "subject").limit(most).collect()
    if rows:
        raise RuntimeError("dataset audit failed: " + "; ".join(f"{r['rule']} {r['subject']}: {r['detail']}" for r in rows))
