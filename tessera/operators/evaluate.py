"""Evaluation of scored pairs: confusion counts, rank metrics, histograms, calibration and losses.

Input: ``label`` (0/1), ``p`` (probability of 1), and ``margin`` where a decision or loss needs it. Rank metrics first
group by score, so ties are exact and the rows that are ordered are distinct scores; running totals are taken over score
buckets first and inside buckets next, so no task orders all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import confidence_bucket, cross_entropy, error_type, margin_loss, margin_of_threshold, ratio, score_bin, threshold_band

COUNTS = ("tp", "fp", "fn", "tn")
LEVELS = ("game_label_video", "game_label", "game", "global")


def decide(scored: DataFrame, threshold: float) -> DataFrame:
    """``predicted``: the margin is strictly over the threshold's; one that is null is not."""
    return scored.withColumn("predicted", F.when(F.col("margin") > F.lit(margin_of_threshold(threshold)), 1).otherwise(0))


def _counts(predicted: str = "predicted", label: str = "label") -> list[Column]:
    p, y = F.col(predicted) == 1, F.col(label) == 1
    return [F.sum(c.cast("long")).alias(n) for n, c in zip(COUNTS, (p & y, p & ~y, ~p & y, ~p & ~y))]


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """Counts globally, by game, by (game, label) and by video, in one shuffle of per-video partial counts."""
    base = decide(scored, threshold).groupBy("game", "label", "video_id").agg(*_counts())
    sets = base.groupingSets(
        [["game", "label", "video_id"], ["game", "label"], ["game"], []], "game", "label", "video_id"
    ).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, LEVELS[0]).when(F.col("g") == 1, LEVELS[1]).when(F.col("g") == 3, LEVELS[2]).otherwise(LEVELS[3])
    return sets.select(level.alias("level"), "game", "label", "video_id", *COUNTS)


def confusion_by_subtype(scored: DataFrame, threshold: float, subtype: str = "negative_subtype") -> DataFrame:
    """Counts as :func:`confusion` has them and by (game, label, subtype) too, from the same partial counts; rows without a subtype are in no such group."""
    base = decide(scored, threshold).groupBy("game", "label", "video_id", F.nullif(F.col(subtype), F.lit("")).alias("subtype")).agg(*_counts())
    sets = base.groupingSets(
        [["game", "label", "video_id"], ["game", "label", "subtype"], ["game", "label"], ["game"], []], "game", "label", "video_id", "subtype"
    ).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 1, LEVELS[0]).when(F.col("g") == 2, "game_label_subtype").when(F.col("g") == 3, LEVELS[1]).when(F.col("g") == 7, LEVELS[2]).otherwise(LEVELS[3])
    return sets.where((F.col("g") != 2) | F.col("subtype").isNotNull()).select(level.alias("level"), "game", "label", "video_id", "subtype", *COUNTS)


def quick_sample(rows: DataFrame, limit: int, world: int, position: str = "position") -> DataFrame:
    """What each of ``world`` ranks keeps in a quick run: its first rows, as many as the limit divided by the ranks, rounded up."""
    rank, turn = F.pmod(F.col(position), F.lit(world)), F.floor(F.col(position) / world)
    return rows.withColumn("rank", rank).where(turn < -(-limit // world))


def union_groups(*groups: DataFrame) -> DataFrame:
    """Rows of several groupings under one header: all their columns in order of name, null where a grouping has none."""
    names = sorted({c for df in groups for c in df.columns})
    out = groups[0]
    for df in groups[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*names)


def group_counts(scored: DataFrame, threshold: float, *keys: str) -> DataFrame:
    return decide(scored, threshold).groupBy(*keys).agg(*_counts())


def metrics(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    """The usual ratios of confusion counts; 0 where the denominator is."""
    tp, fp, fn, tn = (F.col(c) for c in (tp, fp, fn, tn))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {
        "precision": ratio(tp, tp + fp),
        "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "specificity": specificity,
        "balanced_accuracy": (recall + specificity) / 2,
        "fpr": ratio(fp, fp + tn),
    }


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.withColumns(metrics())


def game_label_rows(scored: DataFrame, threshold: float) -> DataFrame:
    """Label-conditional metrics by (game, label): what the other label would define is null."""
    rows = group_counts(scored, threshold, "game", "label")
    positive = F.col("label") == 1
    on = lambda cond, value: F.when(cond, value)
    return rows.select(
        "game", "label", *COUNTS,
        on(positive, ratio("tp", F.col("tp") + F.col("fn"))).alias("recall"),
        on(positive, ratio("fn", F.col("tp") + F.col("fn"))).alias("fn_rate"),
        on(~positive, ratio("tn", F.col("tn") + F.col("fp"))).alias("specificity"),
        on(~positive, ratio("fp", F.col("tn") + F.col("fp"))).alias("fp_rate"),
        ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
    )


def video_rows(scored: DataFrame, threshold: float) -> DataFrame:
    """Per video: counts, accuracy, and mean, least and greatest confidence."""
    rows = decide(scored, threshold).groupBy("game", "label", "video_id").agg(
        *_counts(), F.avg("p").alias("mean_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"), F.count(F.lit(1)).alias("n")
    )
    return rows.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), "n"))


def worst_groups(counts: DataFrame, subtype: bool = False) -> DataFrame:
    """Greatest false-positive rate of groups with negatives, least recall of groups with positives.

    Without any such group the answer is 0; for subtypes it is null where there is no group at all.
    """
    fpr = F.max(F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn")))
    recall = F.min(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))
    empty = F.count(F.lit(1)) == 0 if subtype else F.lit(False)
    return counts.agg(F.when(~empty, F.coalesce(fpr, F.lit(0.0))).alias("worst_fpr"), F.when(~empty, F.coalesce(recall, F.lit(0.0))).alias("worst_recall"))


def macro_f1(counts: DataFrame) -> DataFrame:
    f1 = metrics()["f1"]
    return counts.agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"), F.coalesce(F.min(f1), F.lit(0.0)).alias("worst_f1"))


def subtype_negatives(counts: DataFrame) -> DataFrame:
    """``fp + tn`` by ``game::label::subtype``."""
    return counts.select(F.concat_ws("::", "game", F.col("label").cast("string"), "negative_subtype").alias("key"), (F.col("fp") + F.col("tn")).alias("n_negatives"))


# rank metrics


def by_score(scored: DataFrame, score: Column | str = "p", group: list[str] | None = None) -> DataFrame:
    """``group, score, pos, neg``: one row a distinct score."""
    s = F.col(score) if isinstance(score, str) else score
    return scored.groupBy(*(group or []), s.alias("score")).agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum((1 - F.col("label")).cast("long")).alias("neg"))


def running(scores: DataFrame, ascending: bool, group: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """``scores`` with ``pos_before, neg_before``: totals of the scores before each, in order, by group.

    A score's bucket grows with it (``buckets`` of [0, 1], the ends open), so the total before a bucket is a window over
    bucket sums, and the rest is a window inside the bucket.
    """
    group = group or []
    bucket = F.least(F.greatest(F.floor(F.col("score") * buckets), F.lit(-1)), F.lit(buckets))
    rows = scores.withColumn("bucket", bucket)
    order = (lambda c: F.asc(c)) if ascending else (lambda c: F.desc(c))
    sums = rows.groupBy(*group, "bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    over = Window.partitionBy(*group).orderBy(order("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "bucket", F.coalesce(F.sum("p").over(over), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"))
    inside = Window.partitionBy(*group, "bucket").orderBy(order("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, start: F.col(start) + F.coalesce(F.sum(c).over(inside), F.lit(0))
    return rows.join(starts, [*group, "bucket"]).withColumns({"pos_before": before("pos", "p0"), "neg_before": before("neg", "n0")}).drop("p0", "n0", "bucket")


def roc_auc(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with half for ties; 0 where a class is empty. ``scores`` as of :func:`by_score`, or bins."""
    group = group or []
    rows = running(scores, True, group)
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.lit(0.5) * F.col("neg")))
    out = rows.groupBy(*group).agg(area.alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(*group, F.coalesce(ratio("a", F.col("p") * F.col("n")), F.lit(0.0)).alias("roc_auc"))


def average_precision(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Sum of recall steps times precision, tied scores together; 0 without positives."""
    group = group or []
    rows = running(scores, False, group)
    tp = F.col("pos_before") + F.col("pos")
    total = tp + F.col("neg_before") + F.col("neg")
    out = rows.groupBy(*group).agg(F.sum(F.col("pos") * tp / total).alias("a"), F.sum("pos").alias("p"))
    return out.select(*group, F.coalesce(ratio("a", "p"), F.lit(0.0)).alias("average_precision"))


def histogram(scored: DataFrame, bins: int, p: str = "p") -> DataFrame:
    """``bin, pos, neg`` of non-empty bins."""
    return by_score(scored, score_bin(p, bins)).withColumnRenamed("score", "bin")


def _as_scores(hist: DataFrame, bins: int) -> DataFrame:
    return hist.withColumn("score", (F.col("bin") + 0.5) / bins)


def histogram_auc(hist: DataFrame, bins: int) -> DataFrame:
    scores = _as_scores(hist, bins).select("score", "pos", "neg")
    return roc_auc(scores).crossJoin(average_precision(scores))  # one row each


def low_fpr(hist: DataFrame, bins: int, bound: float) -> DataFrame:
    """Normalised area under the ROC curve up to false-positive rate ``bound``, and the recall there.

    From the strictest bin on, trapezoids; the segment that reaches the bound is cut on its line; a curve that never
    reaches it goes on flat. Both are 0 if a class is empty or the bound is not positive. Works on at most ``bins`` rows.
    """
    window = Window.orderBy(F.desc("bin"))
    whole = Window.partitionBy()
    rows = hist.withColumns({"P": F.sum("pos").over(whole), "N": F.sum("neg").over(whole)})
    r, f = F.sum("pos").over(window) / F.col("P"), F.sum("neg").over(window) / F.col("N")
    rows = rows.where("P > 0 and N > 0").withColumns({"r": r, "f": f})
    rows = rows.withColumns({"pr": F.coalesce(F.lag("r").over(window), F.lit(0.0)), "pf": F.coalesce(F.lag("f").over(window), F.lit(0.0))})
    b = F.lit(float(bound))
    cut = F.col("f") >= b
    share = F.coalesce(F.try_divide(b - F.col("pf"), F.col("f") - F.col("pf")), F.lit(0.0))
    end_r = F.when(cut, F.col("pr") + (F.col("r") - F.col("pr")) * share).otherwise(F.col("r"))
    end_f = F.when(cut, b).otherwise(F.col("f"))
    kept = rows.where(F.col("pf") < b).select(((F.col("pr") + end_r) / 2 * (end_f - F.col("pf"))).alias("area"), end_r.alias("er"), end_f.alias("ef"))
    total = kept.agg(F.sum("area").alias("area"), F.max("er").alias("er"), F.max("ef").alias("ef"))
    if bound <= 0:
        return total.select(F.lit(0.0).alias("partial_auc"), F.lit(0.0).alias("recall_at_fpr"))
    return total.select(
        F.coalesce((F.col("area") + F.col("er") * (b - F.col("ef"))) / b, F.lit(0.0)).alias("partial_auc"),
        F.coalesce("er", F.lit(0.0)).alias("recall_at_fpr"),
    )


def percentiles(hist: DataFrame, bins: int, quantiles: list[float], count: str = "neg") -> DataFrame:
    """``quantile, value``: centre of the first bin whose cumulative count reaches ``max(1, ceil(q n))``; null if empty."""
    cdf = hist.select("bin", F.sum(count).over(Window.orderBy("bin")).alias("cdf"), F.sum(count).over(Window.partitionBy()).alias("n"))
    target = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n")))
    first = lambda q: F.min(F.when((F.col("cdf") >= target(q)) & (F.col("n") > 0), (F.col("bin") + 0.5) / bins))
    each = F.array(*[F.struct(F.lit(str(q)).alias("quantile"), first(q).alias("value")) for q in quantiles])
    return cdf.agg(each.alias("each")).select(F.explode("each").alias("e")).select("e.*")


def margin_of_bin(value: Column | str) -> Column:
    """The margin of a bin's centre, away from the ends."""
    v = F.least(F.greatest(F.col(value) if isinstance(value, str) else value, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(v / (1 - v))


def max_score(hist: DataFrame, bins: int) -> DataFrame:
    """Centre of the highest non-empty bin, by class."""
    top = lambda c: ((F.max(F.when(F.col(c) > 0, F.col("bin"))) + 0.5) / bins).alias(f"max_{c}")
    return hist.agg(top("pos"), top("neg"))


def calibration_bins(scored: DataFrame, bins: int = 20) -> DataFrame:
    return scored.groupBy(score_bin("p", bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"), F.sum(F.col("label").cast("long")).alias("sum_y"))


def ece(calibration: DataFrame, bins: int = 20, tail_from: float | None = None) -> DataFrame:
    """Expected calibration error; with ``tail_from`` over the bins that end above it, weighed by their own rows."""
    rows = calibration if tail_from is None else calibration.where((F.col("bin") + 1) / bins > tail_from)
    gap = F.sum(F.abs(F.col("sum_p") - F.col("sum_y")))
    return rows.agg(F.coalesce(ratio(gap, F.sum("n")), F.lit(0.0)).alias("ece"))


def confidence_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy(confidence_bucket("p").alias("bucket"), "label").agg(F.count(F.lit(1)).alias("n"))


# losses


def loss_summary(scored: DataFrame, threshold: float, safety: float, temperature: float, ce_weight: float = 1.0, threshold_weight: float = 1.0) -> DataFrame:
    """Means of cross entropy, Brier score and threshold loss, their weighted objective, and the share of positives over the margin."""
    cutoff = margin_of_threshold(threshold)
    over = F.when(F.col("label") == 1, F.when(F.col("margin") > cutoff + safety, 1.0).otherwise(0.0))
    means = scored.agg(
        F.avg(cross_entropy()).alias("cross_entropy"),
        F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"),
        F.avg(margin_loss("margin", "label", cutoff, safety, temperature)).alias("threshold_loss"),
        F.avg(over).alias("positive_margin_pass_rate"),
    )
    return means.withColumn("objective", ce_weight * F.col("cross_entropy") + threshold_weight * F.col("threshold_loss"))


def tail_loss(scored: DataFrame, loss: Column, k: int | None) -> DataFrame:
    """Mean of the ``k`` greatest losses of negatives; of all if ``k`` is None; 0 without negatives.

    Only the top ``k`` of each task move.
    """
    rows = scored.where("label = 0").select(loss.alias("loss"))
    if k is not None:
        rows = rows.orderBy(F.desc("loss")).limit(k)
    return rows.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("tail_loss"))


def ranking_penalty(scored: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Mean over positives of the worst ``max(0, margin - positive + negative)`` against hard negatives.

    For a positive the worst hard negative is the greatest, so one number replaces the product of both sides.
    """
    cutoff = margin_of_threshold(threshold)
    hard = scored.agg(F.max(F.when((F.col("label") == 0) & (F.col("margin") >= cutoff - margin), F.col("margin"))).alias("hardest"))
    penalty = F.greatest(F.lit(0.0), F.lit(float(margin)) - F.col("margin") + F.col("hardest"))
    return scored.where("label = 1").crossJoin(F.broadcast(hard)).agg(F.coalesce(F.avg(penalty), F.lit(0.0)).alias("ranking_penalty"))  # one row


# rows for review


def report_rows(scored: DataFrame, threshold: float) -> DataFrame:
    """Errors, and rows near the threshold whether right or wrong."""
    rows = decide(scored, threshold).withColumns({"error_type": error_type(), "threshold_band": threshold_band("p")})
    return rows.where(F.col("error_type").isNotNull() | F.col("threshold_band").isNotNull())


def interval_means(series: DataFrame, every: int, value: str, weight: str) -> DataFrame:
    """Weighted means between log points; null without weight."""
    rows = series.groupBy(F.floor((F.col("step") - 1) / every).alias("interval"))
    return rows.agg(F.sum(weight).alias("weight"), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))
