"""Queries over scored pairs and run logs: metrics, losses, mining, gates, selection, histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import learning_rate_factor, margin_loss, margin_of_threshold, threshold_weight
from tessera.operators import evaluate, gates, mining, runs, selection
from tessera.plans import views as V
from tessera.session import load

BINS = 1000
T = V.THRESHOLD


def _rounded(df, *names, places=9):
    return df.withColumns({n: F.round(n, places) for n in names})


def confusion_grouping_sets(spark, d):
    return evaluate.confusion(V.scored(spark, d), T)


def game_metrics(spark, d):
    rows = evaluate.with_metrics(evaluate.group_counts(V.scored(spark, d), T, "game"))
    return _rounded(rows, "precision", "recall", "f1", "accuracy", "specificity", "balanced_accuracy", "fpr")


def game_label_rows(spark, d):
    return _rounded(evaluate.game_label_rows(V.scored(spark, d), T), "recall", "fn_rate", "specificity", "fp_rate", "accuracy")


def video_rows(spark, d):
    return _rounded(evaluate.video_rows(V.scored(spark, d), T), "mean_p", "min_p", "max_p", "accuracy")


def worst_group_metrics(spark, d):
    return _rounded(evaluate.worst_groups(evaluate.group_counts(V.scored(spark, d), T, "game")), "worst_fpr", "worst_recall")


def worst_subtype_metrics(spark, d):
    e = V.events(spark, d).withColumnRenamed("event_type", "negative_subtype")
    return _rounded(evaluate.worst_groups(evaluate.group_counts(e, 0.9, "game", "label", "negative_subtype"), True), "worst_fpr", "worst_recall")


def subtype_negative_counts(spark, d):
    e = V.events(spark, d).withColumnRenamed("event_type", "negative_subtype")
    return evaluate.subtype_negatives(evaluate.group_counts(e, 0.9, "game", "label", "negative_subtype"))


def macro_f1(spark, d):
    return _rounded(evaluate.macro_f1(evaluate.group_counts(V.scored(spark, d), T, "game")), "macro_f1", "worst_f1")


def exact_roc_auc(spark, d):
    return _rounded(evaluate.roc_auc(evaluate.by_score(V.scored(spark, d))), "roc_auc")


def exact_roc_auc_by_game(spark, d):
    return _rounded(evaluate.roc_auc(evaluate.by_score(V.events(spark, d), "p", ["game"]), ["game"]), "roc_auc")


def average_precision(spark, d):
    return _rounded(evaluate.average_precision(evaluate.by_score(V.events(spark, d))), "average_precision")


def score_histogram(spark, d):
    return evaluate.histogram(V.events(spark, d), BINS)


def histogram_auc(spark, d):
    return _rounded(evaluate.histogram_auc(evaluate.histogram(V.events(spark, d), BINS), BINS), "roc_auc", "average_precision")


def low_fpr_partial_auc(spark, d):
    return _rounded(evaluate.low_fpr(evaluate.histogram(V.events(spark, d), BINS), BINS, 0.01), "partial_auc", "recall_at_fpr")


def score_percentiles(spark, d):
    p = evaluate.percentiles(evaluate.histogram(V.events(spark, d), BINS), BINS, [0.5, 0.9, 0.99, 0.999])
    return p.select("quantile", F.round("value", 9).alias("value"), F.round(evaluate.margin_of_bin("value"), 9).alias("margin"))


def max_score_bin(spark, d):
    return _rounded(evaluate.max_score(evaluate.histogram(V.scored(spark, d), BINS), BINS), "max_pos", "max_neg")


def ece_20(spark, d):
    return _rounded(evaluate.ece(evaluate.calibration_bins(V.scored(spark, d))), "ece")


def ece_tail(spark, d):
    return _rounded(evaluate.ece(evaluate.calibration_bins(V.scored(spark, d)), tail_from=0.95), "ece")


def calibration_table(spark, d):
    return _rounded(evaluate.calibration_bins(V.events(spark, d)), "sum_p", places=6)


def confidence_buckets(spark, d):
    return evaluate.confidence_counts(V.events(spark, d))


def loss_summary(spark, d):
    rows = evaluate.loss_summary(V.events(spark, d), 0.9, 0.5, 2.0, 1.0, 0.25)
    return _rounded(rows, "cross_entropy", "brier", "threshold_loss", "positive_margin_pass_rate", "objective", places=6)


def tail_ohem(spark, d):
    loss = margin_loss("margin", "label", margin_of_threshold(0.9), 0.5, 2.0)
    return _rounded(evaluate.tail_loss(V.events(spark, d), loss, 100), "tail_loss", places=6)


def pairwise_rank_penalty(spark, d):
    return _rounded(evaluate.ranking_penalty(V.events(spark, d), 0.9, 1.0), "ranking_penalty", places=6)


def error_rows(spark, d):
    rows = evaluate.report_rows(V.scored(spark, d), T).where("error_type is not null")
    return rows.groupBy("game", "video_id", "frame0_id", "error_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("p"), 9).alias("max_p"))


def near_threshold_rows(spark, d):
    rows = evaluate.report_rows(V.events(spark, d), T).where("threshold_band is not null")
    return rows.select("step", "game", "label", "threshold_band", F.round("p", 9).alias("p"))


def interval_means(spark, d):
    e = V.events(spark, d).withColumn("weight", (F.col("step") % 4).cast("double"))
    return _rounded(evaluate.interval_means(e, 250, "p", "weight"), "mean", places=8)


def _pool(spark, d):
    uid = F.concat_ws("::", "game", "video_id")
    return V.scored(spark, d).withColumn("stable_source_id", uid).withColumn("source_version_id", F.concat(uid, F.lit("#v1"))).withColumnRenamed("p", "p_positive")


def hard_negative_topk(spark, d):
    return _rounded(mining.hard_negatives(_pool(spark, d), 2, 0.5), "p_positive")


def hard_negative_cap(spark, d):
    return _rounded(mining.hard_negatives(_pool(spark, d), 2, 0.5, 100), "p_positive").groupBy("p_positive").agg(F.count(F.lit(1)).alias("n"))


def mining_collapse(spark, d):
    return _rounded(mining.collapse(mining.hard_negatives(_pool(spark, d), 2, 0.5), "mined"), "p_positive")


def stale_mining(spark, d):
    mined = mining.collapse(mining.hard_negatives(_pool(spark, d), 2, 0.5))
    digit = F.substring(F.sha2("stable_source_id", 256), 1, 1)
    index = mined.where(digit < "c").select("stable_source_id", F.when(digit < "6", F.col("source_version_id")).otherwise(F.lit("other")).alias("source_version_id"))
    return mining.stale(mined, index).select("stable_source_id", "source_version_id", "current_version")


def gate_checks(spark, d):
    counts = evaluate.with_metrics(evaluate.group_counts(V.scored(spark, d), T))
    values = gates.unpivot(counts, ["precision", "recall", "fpr", "accuracy"])
    specs = spark.createDataFrame([("fpr", "<=", 0.01), ("recall", ">=", 0.8), ("precision", ">", 0.2), ("accuracy", "<", 0.99), ("absent", ">=", 0.5)], "name string, op string, bound double")
    return _rounded(gates.check(values, specs), "value")


def _history(spark, d, *group):
    """Evaluations of each group, or of each game: 200 events are one, its metrics are means over them."""
    e = V.events(spark, d).withColumn("step", F.floor((F.col("step") - 1) / 200).cast("long"))
    return e.groupBy(*(group or ["game"]), "step").agg(F.avg("p").alias("global_recall"), F.avg(F.col("label").cast("double")).alias("worst_game_recall"), F.max("p").alias("negative_score_p999"), F.min("p").alias("global_fpr"), F.avg(1 - F.col("p")).alias("worst_game_f1"))


SELECT = selection.Selection("constrained", {"max_global_fpr": 0.02, "min_positive_recall": 0.4}, 0.3)


def _one_run(spark, d):
    """All events as the evaluations of one run."""
    return _history(spark, d, F.lit(0).alias("run")).drop("run")


def selection_ranking(spark, d):
    return selection.ranked(_one_run(spark, d), SELECT).select("step", "eligible", "place")


def topk_registry(spark, d):
    return selection.top_k(_one_run(spark, d), SELECT, 5).select("step", "eligible")


def composite_ranking(spark, d):
    s = selection.Selection("composite", weights={"global_recall": 2.0, "worst_game_recall": 1.0})
    return _rounded(selection.ranked(_one_run(spark, d), s).select("step", "place", "key0"), "key0")


def best_so_far(spark, d):
    rows = selection.best_so_far(_history(spark, d), "global_recall", ["game"])
    return _rounded(rows.select("game", "step", "best", "improved"), "best")


def early_stopping_fold(spark, d):
    return _rounded(selection.early_stopping(_history(spark, d), ["game"], "global_recall", 3, 0.002, 5), "best_value")


def degradation_marker(spark, d):
    return _rounded(selection.degradation(_history(spark, d), ["game"], "global_recall", "global_fpr"), "best")


def generalization_gap(spark, d):
    h = _history(spark, d, (F.col("game") < "g2").alias("probe"))  # games are known or probes
    return _rounded(selection.generalization_gap(h.where("not probe"), h.where("probe"), "global_recall"), "gap")


def latest_run_records(spark, d):
    e = load(spark, d, "events").select(F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("run"), F.col("user_id").cast("string"))).alias("run_id"), F.concat(F.lit("/out/"), F.col("user_id").cast("string")).alias("output_dir"), F.col("event_id").alias("line_no"), "event_type")
    return runs.latest(e).select("run_id", "output_dir", "event_type")


def last_run_records(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").alias("line_no"), "event_type")
    return runs.last_records(e, 25)


def metric_series(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("split"), F.when(F.col("user_id") % 2 == 0, "full").otherwise("quick").alias("scope"), F.when(F.col("value") > 100, F.col("value")).alias("loss"))
    return runs.series(e, "purchase", "loss", "full")


def config_diff(spark, d):
    left = spark.createDataFrame([("a.lr", "0.1"), ("a.steps", "10"), ("b", None), ("seed", "7")], "key string, value string")
    right = spark.createDataFrame([("a.lr", "0.2"), ("b", None), ("c.new", "x"), ("seed", "7")], "key string, value string")
    return gates.difference(left, right, ["a.lr"])


def schedules(spark, d):
    steps = spark.range(0, 200).select(F.col("id").alias("step"))
    return steps.select("step", F.round(threshold_weight("step", 20, 50, 0.8), 9).alias("threshold_weight"), F.round(learning_rate_factor("step", 10, 150, 0.05), 9).alias("rate"))


_S, _E = "WITH " + V.SCORED, "WITH " + V.EVENTS
_CNT = "CAST(sum(CASE WHEN predicted = 1 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN predicted = 1 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN predicted = 0 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN predicted = 0 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn"
_C9 = "ln(CAST(0.9 AS DOUBLE) / (1 - CAST(0.9 AS DOUBLE)))"
_D9 = f"d AS (SELECT *, CASE WHEN margin > {_C9} THEN 1 ELSE 0 END AS predicted FROM ev)"


def _div(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0), 9)"


def _auc(table: str, score: str, group: str = "") -> str:
    g, over = (f"{group}, ", f"PARTITION BY {group} ") if group else ("", "")
    by = f" GROUP BY {group}" if group else ""
    return f"""s AS (SELECT {g}{score} AS score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM {table} GROUP BY {g}{score}),
r AS (SELECT *, coalesce(sum(neg) OVER ({over}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, sum(pos) OVER ({over}ORDER BY score DESC) AS tp, sum(neg) OVER ({over}ORDER BY score DESC) AS fp FROM s),
auc AS (SELECT {g}{_div('sum(pos * (nb + neg / 2))', 'sum(pos) * sum(neg)')} AS roc_auc, {_div('sum(pos * tp / (tp + fp))', 'sum(pos)')} AS average_precision FROM r{by})"""


_BIN = f"least(CAST(floor(p * {BINS}) AS INTEGER), {BINS - 1})"
_HIST = f"h AS (SELECT {_BIN} AS bin, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM {{0}} GROUP BY 1)"
_CAL = "c AS (SELECT least(CAST(floor(p * 20) AS INTEGER), 19) AS bin, count(*) AS n, sum(p) AS sum_p, CAST(sum(label) AS BIGINT) AS sum_y FROM {0} GROUP BY 1)"
_SOFT = "(greatest({0}, 0) + ln(1 + exp(-abs({0}))))"
_WRONG = f"((CASE WHEN label = 1 THEN {_C9} + CAST(0.5 AS DOUBLE) - margin ELSE margin - {_C9} + CAST(0.5 AS DOUBLE) END) / 2)"
_TL = f"2 * {_SOFT.format(_WRONG)}"
_CE = _SOFT.format("(CASE WHEN label = 1 THEN -margin ELSE margin END)")
_POOL = "pool AS (SELECT *, game || '::' || video_id AS stable_source_id, game || '::' || video_id || '#v1' AS source_version_id FROM scored), pp AS (SELECT source_version_id, stable_source_id, game, video_id, frame0_id, frame1_id, delta, max(p) AS p_positive FROM pool WHERE label = 0 AND p >= 0.5 GROUP BY ALL), top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_version_id ORDER BY p_positive DESC, frame0_id, frame1_id, delta) - 1 AS INTEGER) AS rank_in_video FROM pp) WHERE rank_in_video < 2)"
_MINED = "mined AS (SELECT stable_source_id, max(p_positive) AS p_positive, max(source_version_id) AS source_version_id FROM top GROUP BY 1)"
_HISTORY = "hist AS (SELECT game, CAST(floor(CAST(step - 1 AS DOUBLE) / 200) AS BIGINT) AS step, avg(p) AS global_recall, avg(CAST(label AS DOUBLE)) AS worst_game_recall, max(p) AS negative_score_p999, min(p) AS global_fpr, avg(1 - p) AS worst_game_f1 FROM ev GROUP BY 1, 2)"
_RUN = "run AS (SELECT CAST(floor(CAST(step - 1 AS DOUBLE) / 200) AS BIGINT) AS step, avg(p) AS global_recall, avg(CAST(label AS DOUBLE)) AS worst_game_recall, max(p) AS negative_score_p999, min(p) AS global_fpr, avg(1 - p) AS worst_game_f1 FROM ev GROUP BY 1)"
_RANKED = "rk AS (SELECT step, global_fpr <= CAST(0.02 AS DOUBLE) AND global_recall >= CAST(0.4 AS DOUBLE) AND worst_game_f1 >= CAST(0.3 AS DOUBLE) AS eligible, global_recall, worst_game_recall, negative_score_p999 FROM run), pl AS (SELECT step, eligible, CAST(row_number() OVER (ORDER BY eligible DESC, global_recall DESC, worst_game_recall DESC, negative_score_p999, step) AS INTEGER) AS place FROM rk)"

SQL = {
    "confusion_grouping_sets": f"{_S} SELECT CASE WHEN grouping(video_id) = 0 THEN 'game_label_video' WHEN grouping(label) = 0 THEN 'game_label' WHEN grouping(game) = 0 THEN 'game' ELSE 'global' END AS level, game, label, video_id, {_CNT} FROM d GROUP BY GROUPING SETS ((game, label, video_id), (game, label), (game), ())",
    "game_metrics": f"{_S}, c AS (SELECT game, {_CNT} FROM d GROUP BY game) SELECT game, tp, fp, fn, tn, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall, {_div('2 * tp', '2 * tp + fp + fn')} AS f1, {_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_div('tn', 'tn + fp')} AS specificity, round((coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) + coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0)) / 2, 9) AS balanced_accuracy, {_div('fp', 'fp + tn')} AS fpr FROM c",
    "game_label_rows": f"{_S}, c AS (SELECT game, label, {_CNT} FROM d GROUP BY game, label) SELECT game, label, tp, fp, fn, tn, CASE WHEN label = 1 THEN {_div('tp', 'tp + fn')} END AS recall, CASE WHEN label = 1 THEN {_div('fn', 'tp + fn')} END AS fn_rate, CASE WHEN label = 0 THEN {_div('tn', 'tn + fp')} END AS specificity, CASE WHEN label = 0 THEN {_div('fp', 'tn + fp')} END AS fp_rate, {_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy FROM c",
    "video_rows": f"{_S} SELECT game, label, video_id, {_CNT}, round(avg(p), 9) AS mean_p, round(min(p), 9) AS min_p, round(max(p), 9) AS max_p, count(*) AS n, round(CAST(sum(CASE WHEN predicted = label THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS accuracy FROM d GROUP BY game, label, video_id",
    "worst_group_metrics": f"{_S}, c AS (SELECT game, {_CNT} FROM d GROUP BY game) SELECT round(coalesce(max(CAST(fp AS DOUBLE) / nullif(fp + tn, 0)), 0), 9) AS worst_fpr, round(coalesce(min(CAST(tp AS DOUBLE) / nullif(tp + fn, 0)), 0), 9) AS worst_recall FROM c",
    "worst_subtype_metrics": f"{_E}, {_D9}, c AS (SELECT game, label, event_type, {_CNT} FROM d GROUP BY 1, 2, 3) SELECT round(coalesce(max(CAST(fp AS DOUBLE) / nullif(fp + tn, 0)), 0), 9) AS worst_fpr, round(coalesce(min(CAST(tp AS DOUBLE) / nullif(tp + fn, 0)), 0), 9) AS worst_recall FROM c",
    "subtype_negative_counts": f"{_E}, {_D9} SELECT game || '::' || label || '::' || event_type AS key, CAST(sum(1 - label) AS BIGINT) AS n_negatives FROM d GROUP BY 1",
    "macro_f1": f"{_S}, c AS (SELECT game, {_CNT} FROM d GROUP BY game), f AS (SELECT coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c) SELECT round(avg(f1), 9) AS macro_f1, round(min(f1), 9) AS worst_f1 FROM f",
    "exact_roc_auc": f"{_S}, {_auc('scored', 'p')} SELECT roc_auc FROM auc",
    "exact_roc_auc_by_game": f"{_E}, {_auc('ev', 'p', 'game')} SELECT game, roc_auc FROM auc",
    "average_precision": f"{_E}, {_auc('ev', 'p')} SELECT average_precision FROM auc",
    "score_histogram": f"{_E}, {_HIST.format('ev')} SELECT * FROM h",
    "histogram_auc": f"{_E}, {_auc('ev', _BIN)} SELECT roc_auc, average_precision FROM auc",
    "low_fpr_partial_auc": f"""{_E}, {_HIST.format('ev')},
t AS (SELECT bin, CAST(sum(pos) OVER (ORDER BY bin DESC) AS DOUBLE) / sum(pos) OVER () AS r, CAST(sum(neg) OVER (ORDER BY bin DESC) AS DOUBLE) / sum(neg) OVER () AS f FROM h),
l AS (SELECT r, f, coalesce(lag(r) OVER (ORDER BY bin DESC), 0) AS pr, coalesce(lag(f) OVER (ORDER BY bin DESC), 0) AS pf FROM t),
k AS (SELECT pr, pf, CASE WHEN f >= CAST(0.01 AS DOUBLE) THEN pr + (r - pr) * ((CAST(0.01 AS DOUBLE) - pf) / (f - pf)) ELSE r END AS er, least(f, CAST(0.01 AS DOUBLE)) AS ef FROM l WHERE pf < CAST(0.01 AS DOUBLE))
SELECT round((sum((pr + er) / 2 * (ef - pf)) + max(er) * (CAST(0.01 AS DOUBLE) - max(ef))) / CAST(0.01 AS DOUBLE), 9) AS partial_auc, round(max(er), 9) AS recall_at_fpr FROM k""",
    "score_percentiles": f"""{_E}, {_HIST.format('ev')}, c AS (SELECT bin, sum(neg) OVER (ORDER BY bin) AS cdf, sum(neg) OVER () AS n FROM h),
q AS (SELECT quantile, min((bin + CAST(0.5 AS DOUBLE)) / {BINS}) FILTER (cdf >= greatest(1, ceil(CAST(quantile AS DOUBLE) * n))) AS value FROM c, (VALUES ('0.5'), ('0.9'), ('0.99'), ('0.999')) v(quantile) GROUP BY quantile)
SELECT quantile, round(value, 9) AS value, round(ln(value / (1 - value)), 9) AS margin FROM q""",
    "max_score_bin": f"{_S}, {_HIST.format('scored')} SELECT round((max(bin) FILTER (pos > 0) + CAST(0.5 AS DOUBLE)) / {BINS}, 9) AS max_pos, round((max(bin) FILTER (neg > 0) + CAST(0.5 AS DOUBLE)) / {BINS}, 9) AS max_neg FROM h",
    "ece_20": f"{_S}, {_CAL.format('scored')} SELECT round(sum(abs(sum_p - sum_y)) / sum(n), 9) AS ece FROM c",
    "ece_tail": f"{_S}, {_CAL.format('scored')} SELECT round(coalesce(sum(abs(sum_p - sum_y)) / sum(n), 0), 9) AS ece FROM c WHERE bin = 19",
    "calibration_table": f"{_E}, {_CAL.format('ev')} SELECT bin, n, round(sum_p, 6) AS sum_p, sum_y FROM c",
    "confidence_buckets": f"{_E} SELECT CAST(CASE WHEN p >= CAST(0.999 AS DOUBLE) THEN 4 WHEN p >= CAST(0.995 AS DOUBLE) THEN 3 WHEN p >= CAST(0.99 AS DOUBLE) THEN 2 WHEN p >= CAST(0.98 AS DOUBLE) THEN 1 ELSE 0 END AS INTEGER) AS bucket, label, count(*) AS n FROM ev GROUP BY 1, 2",
    "loss_summary": f"{_E}, m AS (SELECT avg({_CE}) AS ce, avg((p - label) * (p - label)) AS br, avg({_TL}) AS tl, avg(CASE WHEN label = 1 THEN CASE WHEN margin > {_C9} + CAST(0.5 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END END) AS pr FROM ev) SELECT round(ce, 6) AS cross_entropy, round(br, 6) AS brier, round(tl, 6) AS threshold_loss, round(pr, 6) AS positive_margin_pass_rate, round(ce + CAST(0.25 AS DOUBLE) * tl, 6) AS objective FROM m",
    "tail_ohem": f"{_E} SELECT round(avg(l), 6) AS tail_loss FROM (SELECT {_TL} AS l FROM ev WHERE label = 0 ORDER BY l DESC LIMIT 100)",
    "pairwise_rank_penalty": f"{_E}, h AS (SELECT max(margin) AS m FROM ev WHERE label = 0 AND margin >= {_C9} - 1) SELECT round(coalesce(avg(greatest(0, 1 - margin + m)), 0), 6) AS ranking_penalty FROM ev, h WHERE label = 1",
    "error_rows": f"{_S} SELECT game, video_id, frame0_id, CASE WHEN predicted = 1 THEN 'FP' ELSE 'FN' END AS error_type, count(*) AS n, round(max(p), 9) AS max_p FROM d WHERE predicted <> label GROUP BY 1, 2, 3, 4",
    "near_threshold_rows": f"{_E} SELECT step, game, label, CASE WHEN p < CAST(0.99 AS DOUBLE) THEN '0.980-0.990' ELSE '0.990-0.995' END AS threshold_band, round(p, 9) AS p FROM ev WHERE p >= CAST(0.98 AS DOUBLE) AND p <= CAST(0.995 AS DOUBLE)",
    "interval_means": f"{_E} SELECT CAST(floor((step - 1) / 250) AS BIGINT) AS interval, CAST(sum(step % 4) AS DOUBLE) AS weight, round(sum(p * (step % 4)) / nullif(sum(step % 4), 0), 8) AS mean FROM ev GROUP BY 1",
    "hard_negative_topk": f"{_S}, {_POOL} SELECT * REPLACE (round(p_positive, 9) AS p_positive) FROM top",
    "hard_negative_cap": f"{_S}, {_POOL} SELECT p_positive, count(*) AS n FROM (SELECT round(p_positive, 9) AS p_positive FROM top ORDER BY p_positive DESC LIMIT 100) GROUP BY 1",
    "mining_collapse": f"{_S}, {_POOL}, {_MINED} SELECT stable_source_id, source_version_id, round(p_positive, 9) AS p_positive, 'mined' AS negative_subtype FROM mined",
    "stale_mining": f"{_S}, {_POOL}, {_MINED}, g AS (SELECT stable_source_id, source_version_id, substr(sha256(stable_source_id), 1, 1) AS x FROM mined) SELECT stable_source_id, source_version_id, CASE WHEN x < 'c' THEN 'other' END AS current_version FROM g WHERE x >= '6'",
    "early_stopping_fold": f"""{_E.replace('WITH ', 'WITH RECURSIVE ')}, {_HISTORY},
n AS (SELECT game, step, global_recall AS v, row_number() OVER (PARTITION BY game ORDER BY step) AS i FROM hist),
f(game, i, best, best_step, bad, stop) AS (
  SELECT DISTINCT game, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), 0, CAST(NULL AS BIGINT) FROM n
  UNION ALL
  SELECT f.game, n.i,
    CASE WHEN stop IS NULL AND (best IS NULL OR v > best + CAST(0.002 AS DOUBLE)) THEN v ELSE best END,
    CASE WHEN stop IS NULL AND (best IS NULL OR v > best + CAST(0.002 AS DOUBLE)) THEN n.step ELSE best_step END,
    CASE WHEN stop IS NOT NULL THEN bad WHEN best IS NULL OR v > best + CAST(0.002 AS DOUBLE) THEN 0 WHEN n.step < 5 THEN bad ELSE bad + 1 END,
    CASE WHEN stop IS NOT NULL THEN stop WHEN best IS NULL OR v > best + CAST(0.002 AS DOUBLE) THEN NULL WHEN n.step >= 5 AND bad + 1 >= 3 THEN n.step END
  FROM f JOIN n ON n.game = f.game AND n.i = f.i + 1)
SELECT game, round(best, 9) AS best_value, best_step, bad AS bad_count, stop AS stop_step FROM f WHERE i = (SELECT max(i) FROM n WHERE n.game = f.game)""",
    "gate_checks": f"{_S}, c AS (SELECT {_CNT} FROM d), v AS (SELECT unnest(['precision', 'recall', 'fpr', 'accuracy']) AS name, unnest([{_div('tp', 'tp + fp')}, {_div('tp', 'tp + fn')}, {_div('fp', 'fp + tn')}, {_div('tp + tn', 'tp + fp + fn + tn')}]) AS value FROM c), g(name, op, bound) AS (VALUES ('fpr', '<=', CAST(0.01 AS DOUBLE)), ('recall', '>=', 0.8), ('precision', '>', 0.2), ('accuracy', '<', 0.99), ('absent', '>=', 0.5)), r AS (SELECT name, op, bound, value, coalesce(CASE op WHEN '<=' THEN value <= bound WHEN '<' THEN value < bound WHEN '>=' THEN value >= bound ELSE value > bound END, FALSE) AS passed FROM g LEFT JOIN v USING (name)) SELECT *, CASE WHEN value IS NULL THEN 'metric absent' WHEN passed THEN 'ok' ELSE 'failed' END AS detail FROM r",
    "selection_ranking": f"{_E}, {_RUN}, {_RANKED} SELECT step, eligible, place FROM pl",
    "topk_registry": f"{_E}, {_RUN}, {_RANKED} SELECT step, eligible FROM pl WHERE place <= 5",
    "composite_ranking": f"{_E}, {_RUN}, k AS (SELECT step, (global_recall * 2 + worst_game_recall) / 3 AS key0 FROM run) SELECT step, CAST(row_number() OVER (ORDER BY key0 DESC, step) AS INTEGER) AS place, round(key0, 9) AS key0 FROM k",
    "best_so_far": f"{_E}, {_HISTORY}, b AS (SELECT game, step, global_recall AS v, max(global_recall) OVER (PARTITION BY game ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM hist) SELECT game, step, round(greatest(v, coalesce(last, v)), 9) AS best, coalesce(v > last, TRUE) AS improved FROM b",
    "degradation_marker": f"{_E}, {_HISTORY}, t AS (SELECT game, max(global_recall) AS best, min(global_fpr) AS low FROM hist GROUP BY game), m AS (SELECT game, best, (SELECT min(step) FROM hist h WHERE h.game = t.game AND h.global_recall = best) AS best_step, (SELECT min(step) FROM hist h WHERE h.game = t.game AND h.global_fpr = low) AS least_loss_step FROM t) SELECT game, round(best, 9) AS best, best_step, least_loss_step, (SELECT min(step) FROM hist h WHERE h.game = m.game AND h.step > best_step AND h.global_recall < best) AS degraded_step FROM m",
    "generalization_gap": f"{_E}, h AS (SELECT CAST(floor(CAST(step - 1 AS DOUBLE) / 200) AS BIGINT) AS step, game < 'g2' AS probe, avg(p) AS global_recall FROM ev GROUP BY 1, 2) SELECT step, round(b.global_recall - a.global_recall, 9) AS gap FROM h a JOIN h b USING (step) WHERE NOT a.probe AND b.probe",
    "latest_run_records": "WITH r AS (SELECT CASE WHEN user_id % 3 <> 0 THEN 'run' || user_id END AS run_id, '/out/' || user_id AS output_dir, event_id, event_type FROM events) SELECT run_id, output_dir, event_type FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(run_id, output_dir) ORDER BY event_id DESC) AS n FROM r) WHERE n = 1",
    "last_run_records": "SELECT event_id AS line_no, event_type FROM events ORDER BY event_id DESC LIMIT 25",
    "metric_series": "SELECT event_id AS step, value FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 AND value > 100",
    "config_diff": "SELECT * FROM (VALUES ('a.lr', 'changed', '0.1', '0.2', TRUE), ('a.steps', 'removed', '10', NULL, FALSE), ('c.new', 'added', NULL, 'x', FALSE)) v(key, status, left_value, right_value, critical)",
    "schedules": "SELECT step, round(CASE WHEN step <= 20 THEN 0 WHEN step >= 70 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) * (step - 20) / 50 END, 9) AS threshold_weight, round(CASE WHEN step < 10 THEN CAST(step + 1 AS DOUBLE) / 10 ELSE CAST(0.05 AS DOUBLE) + CAST(0.95 AS DOUBLE) * CAST(0.5 AS DOUBLE) * (1 + cos(pi() * least(CAST(1 AS DOUBLE), CAST(step - 10 AS DOUBLE) / 140))) END, 9) AS rate FROM range(0, 200) r(step)",
}
