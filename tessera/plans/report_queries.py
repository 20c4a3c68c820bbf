"""Queries over groups, look-ups and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import evaluate, gates, pairs, selection
from tessera.plans import score_queries as S
from tessera.plans import views as V
from tessera.session import load


def confusion_with_subtypes(spark, d):
    return evaluate.confusion_by_subtype(V.events(spark, d), 0.9, "event_type")


def pair_lookup(spark, d):
    frames = V.frames(spark, d)
    asked = frames.select(*pairs.VIDEO, "frame_id", F.lit(2).alias("delta"))
    return pairs.pair_lookup(pairs.video_entries(frames), asked)


def group_catalog(spark, d):
    return pairs.group_catalog(V.frames(spark, d), ["game", "label", "video_id"])


def gate_name_differences(spark, d):
    counts = evaluate.group_counts(V.events(spark, d), 0.9, "game", "event_type")
    values = counts.select(F.concat_ws("/", "game", "event_type").alias("name"), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).alias("value"))
    asked = V.events(spark, d).select(F.concat_ws("/", "game", F.concat("event_type", F.when(F.col("p") > 0.9, F.lit("!")).otherwise(F.lit("")))).alias("name"))
    return gates.name_differences(values, asked)


def quick_sample(spark, d):
    rows = load(spark, d, "events").select(F.col("event_id").alias("position"), "event_type")
    return evaluate.quick_sample(rows, 100, 8)


def group_rows_union(spark, d):
    e = V.events(spark, d)
    return evaluate.union_groups(evaluate.group_counts(e, 0.9, "game"), evaluate.group_counts(e, 0.9, "game", "video_id"))


def html_escaped(spark, d):
    return load(spark, d, "pages").select("page_id", F.sha2(scalars.html_escape("html").cast("binary"), 256).alias("escaped_sha256"))


def run_ids(spark, d):
    return load(spark, d, "events").select("event_id", scalars.run_id("ts", "event_type", F.col("user_id").cast("string")).alias("run_id"))


def early_stopping_selection(spark, d):
    rows = S._history(spark, d).withColumn("eligible", F.col("global_fpr") <= 0.02)
    return S._rounded(selection.early_stopping(rows, ["game"], "global_recall", 3, 0.002, 5, eligible="eligible"), "best_value")


def selection_report(spark, d):
    s = selection.Selection("composite", weights={"global_recall": 2.0, "worst_game_recall": 1.0})
    return S._rounded(selection.report_fields(S._history(spark, d), s, ["game"]), "score")


def selection_ranking_by_game(spark, d):
    return selection.ranked(S._history(spark, d), S.SELECT, ["game"]).select("game", "step", "eligible", "place")


_D = "c AS (SELECT *, CASE WHEN margin > ln(CAST(0.9 AS DOUBLE) / (1 - CAST(0.9 AS DOUBLE))) THEN 1 ELSE 0 END AS predicted FROM ev)"
_CNT = ", ".join(f"CAST(count(*) FILTER (predicted = {p} AND label = {y}) AS BIGINT) AS {n}" for n, p, y in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0)))
_ESCAPE = "html"
for _sign, _name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _ESCAPE = f"replace({_ESCAPE}, '{_sign}', '{_name}')"

SQL = {
    "confusion_with_subtypes": f"WITH {V.EVENTS}, {_D} SELECT CASE WHEN grouping(video_id) = 0 THEN 'game_label_video' WHEN grouping(event_type) = 0 THEN 'game_label_subtype' WHEN grouping(label) = 0 THEN 'game_label' WHEN grouping(game) = 0 THEN 'game' ELSE 'global' END AS level, game, label, video_id, event_type AS subtype, {_CNT} FROM c GROUP BY GROUPING SETS ((game, label, video_id), (game, label, event_type), (game, label), (game), ())",
    "pair_lookup": f"WITH {V.FRAMES}, p AS (SELECT *, row_number() OVER (PARTITION BY game, label, video_id ORDER BY frame_id) - 1 AS position FROM frames) SELECT a.game, a.label, a.video_id, a.frame_id, 2 AS delta, a.position, b.position AS partner FROM p a LEFT JOIN p b ON b.game = a.game AND b.label = a.label AND b.video_id = a.video_id AND b.frame_id = a.frame_id + 2",
    "group_catalog": f"WITH {V.FRAMES} SELECT game, label, video_id, row_number() OVER (ORDER BY game, label, video_id) - 1 AS group_id FROM (SELECT DISTINCT game, label, video_id FROM frames)",
    "gate_name_differences": f"WITH {V.EVENTS}, {_D}, m AS (SELECT game || '/' || event_type AS name, count(*) FILTER (label = 1) AS n FROM c GROUP BY 1), a AS (SELECT DISTINCT game || '/' || event_type || CASE WHEN p > 0.9 THEN '!' ELSE '' END AS name FROM ev) SELECT name, CASE WHEN m.name IS NULL THEN 'missing' ELSE 'unmeasured' END AS problem FROM a LEFT JOIN m USING (name) WHERE m.name IS NULL OR n = 0",
    "quick_sample": "SELECT event_id AS position, event_type, event_id % 8 AS rank FROM events WHERE event_id // 8 < 13",
    "group_rows_union": f"WITH {V.EVENTS}, {_D} SELECT game, {_CNT}, video_id FROM c GROUP BY GROUPING SETS ((game), (game, video_id))",
    "html_escaped": f"SELECT page_id, sha256({_ESCAPE}) AS escaped_sha256 FROM pages",
    "early_stopping_selection": S.SQL["early_stopping_fold"].replace("global_recall AS v,", "global_recall AS v, global_fpr <= CAST(0.02 AS DOUBLE) AS ok,").replace("best IS NULL OR v > best + CAST(0.002 AS DOUBLE)", "(ok AND (best IS NULL OR v > best + CAST(0.002 AS DOUBLE)))"),
    "selection_report": f"WITH {V.EVENTS}, {S._HISTORY}, k AS (SELECT game, step, (global_recall * 2 + worst_game_recall) / 3 AS score FROM hist) SELECT game, step, 'composite' AS mode, TRUE AS eligible, round(score, 9) AS score, row_number() OVER (PARTITION BY game ORDER BY score DESC, step) = 1 AS selected FROM k",
    "selection_ranking_by_game": f"WITH {V.EVENTS}, {S._HISTORY}, e AS (SELECT *, global_fpr <= CAST(0.02 AS DOUBLE) AND global_recall >= CAST(0.4 AS DOUBLE) AND worst_game_f1 >= CAST(0.3 AS DOUBLE) AS eligible FROM hist) SELECT game, step, eligible, CAST(row_number() OVER (PARTITION BY game ORDER BY eligible DESC, global_recall DESC, worst_game_recall DESC, negative_score_p999, step) AS INTEGER) AS place FROM e",
    "run_ids": "SELECT event_id, strftime(ts, '%Y%m%d/%H%M%S') || '_' || event_type || '_' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 4) AS run_id FROM events",
}
