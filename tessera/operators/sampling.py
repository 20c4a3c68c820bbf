"""Reproducible hierarchical sampling: every draw is a hash of where it is drawn, so any step can be drawn alone.

A slot of a batch draws a delta, then a game, a label, a bucket of negatives, a video and a start, each by its own
uniform number from SHA-256 of ``seed|epoch|step|slot|level|attempt``. Choices by weight are joins on running sums, which
are as small as the catalogue of games, or partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def uniform(seed: int, epoch: int, step: Column, slot: Column, level: str, attempt: Column | int = 0) -> Column:
    """A number in [0, 1): the first 13 hex digits of the hash over 2^52."""
    attempt = attempt if isinstance(attempt, Column) else F.lit(attempt)
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), step.cast("string"), slot.cast("string"), F.lit(level), attempt.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def slots(spark: SparkSession, steps: int, batch: int, start_step: int = 0) -> DataFrame:
    """``step, slot`` of all batches; resuming later is a filter, for no draw depends on another."""
    rows = spark.range(steps * batch).select(F.floor(F.col("id") / batch).cast("int").alias("step"), (F.col("id") % batch).cast("int").alias("slot"))
    return rows.where(F.col("step") >= start_step)


def pick(u: Column, weights: dict) -> Column:
    """The key in whose share of the weights ``u`` falls."""
    total = float(sum(weights.values()))
    if not weights or total <= 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights are not negative and not all zero")
    out, at = None, 0.0
    items = [(k, w) for k, w in weights.items() if w > 0]
    for key, w in items[:-1]:
        at += w / total
        out = F.when(u < at, F.lit(key)) if out is None else out.when(u < at, F.lit(key))
    return F.lit(items[-1][0]) if out is None else out.otherwise(F.lit(items[-1][0]))


def shares(weighted: DataFrame, group: list[str], key: str, weight: str) -> DataFrame:
    """``group, key, lo, hi``: each key's part of [0, 1) within its group, by order of key; weights over 0 only."""
    rows = weighted.where(F.col(weight) > 0)
    over = Window.partitionBy(*group).orderBy(key)
    total = F.sum(weight).over(Window.partitionBy(*group))
    hi = F.sum(weight).over(over.rowsBetween(Window.unboundedPreceding, 0)) / total
    last = F.row_number().over(over) == F.count(F.lit(1)).over(Window.partitionBy(*group))
    out = rows.select(*group, key, F.when(last, F.lit(1.0)).otherwise(hi).alias("hi"))  # sums may round to less than 1
    return out.withColumn("lo", F.coalesce(F.lag("hi").over(over), F.lit(0.0)))


def game_probabilities(entries: DataFrame, alpha: float) -> DataFrame:
    """``game, n_videos, probability``: videos to the power ``alpha``, normalised."""
    counts = entries.groupBy("game").agg(F.count_distinct("label", "video_id").alias("n_videos"))
    power = F.pow(F.greatest(F.lit(1), "n_videos").cast("double"), F.lit(float(alpha)))
    return counts.withColumn("probability", power / F.sum(power).over(Window.partitionBy()))  # a row a game


def buckets(entries: DataFrame, hard: list[str], ordinary: list[str] | None = None) -> DataFrame:
    """Negatives with ``bucket``: hard or ordinary; null for subtypes left out of a non-empty ``ordinary`` list."""
    subtype = F.col("negative_subtype")
    rest = F.when(F.coalesce(subtype.isin(ordinary), F.lit(False)), "ordinary") if ordinary else F.lit("ordinary")
    return entries.where("label = 0").withColumn("bucket", F.when(F.coalesce(subtype.isin(hard or [""]), F.lit(False)), "hard").otherwise(rest))


def bucket_summary(bucketed: DataFrame, pairs: str, minimum: int) -> DataFrame:
    """Per game and bucket: videos, pairs, and whether there are too few videos."""
    rows = bucketed.groupBy("game", F.coalesce("bucket", F.lit("excluded")).alias("bucket"))
    return rows.agg(F.count_distinct("video_id").alias("n_videos"), F.sum(pairs).cast("long").alias("n_pairs")).withColumn("undersized", F.col("n_videos") < minimum)


def require_weights(entries: DataFrame) -> None:
    """No uniform fallback: a game and label without a positive weight is an error."""
    bad = entries.groupBy("game", "label").agg(F.max(F.coalesce("sample_weight", F.lit(0.0))).alias("w")).where("w <= 0").limit(1).collect()
    if bad:
        raise ValueError(f"all weights of game {bad[0]['game']!r}, label {bad[0]['label']} are zero")


def draw(entries: DataFrame, draws: DataFrame, seed: int, epoch: int, delta_p: dict[int, float], label_p: dict[int, float], alpha: float, mix: dict[str, float] | None = None, attempt: int = 0) -> DataFrame:
    """``step, slot, delta, game, label, bucket, video_id, start``.

    ``entries``: ``game, label, video_id, sample_weight, bucket`` (null: ordinary) and ``starts_d`` arrays. A delta is
    drawn first, then everything below it among videos with a pair of that delta; where a negative bucket is empty the
    other is used. Videos are found by a join on the drawn ``(delta, game, label, bucket)`` and a range of shares.
    """
    u = lambda level: uniform(seed, epoch, F.col("step"), F.col("slot"), level, attempt)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("delta"), F.col(f"starts_{d}").alias("starts")) for d in delta_p]))
    pool = entries.select("game", "label", "video_id", "sample_weight", F.when(F.col("label") == 0, F.coalesce("bucket", F.lit("ordinary"))).otherwise("all").alias("bucket"), each.alias("e"))
    pool = pool.select("*", "e.delta", "e.starts").drop("e").where(F.size("starts") > 0)

    games = pool.groupBy("delta", "game").agg(F.count_distinct("label", "video_id").alias("n"))
    games = shares(games.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha)))), ["delta"], "game", "w")
    rows = draws.withColumns({"delta": pick(u("delta"), delta_p).cast("int"), "ug": u("game"), "ul": u("label"), "ub": u("bucket"), "uv": u("video"), "us": u("start")})
    games = games.select(F.col("delta").alias("__d"), "game", "lo", "hi")
    inside = lambda number: (F.col(number) >= F.col("lo")) & (F.col(number) < F.col("hi"))
    rows = rows.join(games, (F.col("delta") == F.col("__d")) & inside("ug")).drop("__d", "lo", "hi", "ug")

    held = pool.groupBy("delta", "game", "label").agg(F.collect_set("bucket").alias("held"))
    weight = F.lit(0.0)
    for label, p in label_p.items():
        weight = F.when(F.col("label") == label, F.lit(float(p))).otherwise(weight)
    labels = shares(held.withColumn("w", weight), ["delta", "game"], "label", "w").join(held, ["delta", "game", "label"])
    labels = labels.select(F.col("delta").alias("__d"), F.col("game").alias("__g"), "label", "held", "lo", "hi")
    rows = rows.join(labels, (F.col("delta") == F.col("__d")) & (F.col("game") == F.col("__g")) & inside("ul")).drop("__d", "__g", "lo", "hi", "ul")

    wanted = pick(F.col("ub"), mix) if mix else F.lit("ordinary")
    bucket = F.when(F.col("label") == 1, "all").when(F.array_contains("held", wanted), wanted).otherwise(F.element_at("held", 1))
    rows = rows.withColumn("bucket", bucket).drop("held", "ub")
    key = ["delta", "game", "label", "bucket"]
    videos = shares(pool, key, "video_id", "sample_weight").join(pool.select(*key, "video_id", "starts"), [*key, "video_id"])
    found = rows.join(videos, [*key]).where(inside("uv"))
    start = F.element_at("starts", (F.least(F.floor(F.col("us") * F.size("starts")), F.size("starts") - 1) + 1).cast("int"))
    return found.select("step", "slot", *key, "video_id", start.alias("start"))


def deduplicated(candidates: DataFrame, level: str = "pair") -> DataFrame:
    """In each step, slots in order take their first candidate that no earlier slot took; ``duplicate`` where none is left.

    ``candidates``: draws of all attempts with ``attempt``. One step's slots are folded in one group: a batch.
    """
    import pandas as pd

    keys = {"none": [], "pair": ["game", "label", "video_id", "delta", "start"], "video": ["game", "label", "video_id"]}[level]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for _, rows in pdf.sort_values(["slot", "attempt"]).groupby("slot"):
            chosen, again = rows.iloc[0], bool(keys)
            for _, row in rows.iterrows():
                key = tuple(row[k] for k in keys)
                if not keys or key not in taken:
                    chosen, again = row, False
                    break
            taken.add(tuple(chosen[k] for k in keys))
            out.append({**chosen.to_dict(), "duplicate": again})
        return pd.DataFrame(out)

    schema = T.StructType([*candidates.schema.fields, T.StructField("duplicate", T.BooleanType())])
    return candidates.groupBy("step").applyInPandas(fold, schema)


def sampled_counts(drawn: DataFrame) -> DataFrame:
    """Counts by (game, label, delta), with shares of all."""
    n = drawn.groupBy("game", "label", "delta").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def uniform_index(spark: SparkSession, n: int, steps: int, batch: int, seed: int, epoch: int, start_step: int = 0) -> DataFrame:
    """``step, slot, index``: uniform draws with replacement from ``n`` rows."""
    u = uniform(seed, epoch, F.col("step"), F.col("slot"), "index")
    return slots(spark, steps, batch, start_step).withColumn("index", F.least(F.floor(u * n), F.lit(n - 1)).cast("long"))


def rank_slice(drawn: DataFrame, rank: int, world: int) -> DataFrame:
    """One worker's part of every global batch."""
    return drawn.where(F.pmod("slot", F.lit(world)) == rank)
