"""Choosing a model from its evaluations: eligibility, order, best so far, early stopping, a top-K registry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Constrained mode: gate -> (metric, operator).
GATES = {
    "max_global_fpr": ("global_fpr", "<="),
    "max_worst_game_fpr": ("worst_game_fpr", "<="),
    "min_positive_recall": ("global_recall", ">="),
    "max_worst_subtype_fpr": ("worst_subtype_fpr", "<="),
}


@dataclass(frozen=True)
class Selection:
    """``mode``: ``constrained``, ``composite``, or the name of one metric."""

    mode: str = "constrained"
    gates: dict[str, float] = field(default_factory=dict)
    minimum_worst_game_f1: float | None = None
    weights: dict[str, float] = field(default_factory=dict)


def eligible(s: Selection) -> Column:
    """Every set gate passes; a missing metric fails its gate, a missing worst F1 counts as 0."""
    ok = F.lit(True)
    if s.mode == "constrained":
        for gate, bound in s.gates.items():
            metric, op = GATES[gate]
            holds = F.col(metric) <= bound if op == "<=" else F.col(metric) >= bound
            ok = ok & F.coalesce(holds, F.lit(False))
    if s.minimum_worst_game_f1 is not None:
        ok = ok & (F.coalesce(F.col("worst_game_f1"), F.lit(0.0)) >= s.minimum_worst_game_f1)
    return ok


def rank_key(s: Selection) -> list[Column]:
    """Components compared in turn, greater is better."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    if s.mode == "constrained":
        return [zero("global_recall"), zero("worst_game_recall"), -zero("negative_score_p999")]
    if s.mode == "composite":
        total = sum(s.weights.values())
        if total <= 0:
            raise ValueError("composite selection needs a positive weight")
        return [sum((zero(m) * w for m, w in s.weights.items()), F.lit(0.0)) / total]
    return [F.col(s.mode).cast("double")]


def ranked(evaluations: DataFrame, s: Selection, group: list[str] | None = None) -> DataFrame:
    """Evaluations with ``eligible``, the key's components, and ``place`` from 1, eligible ones first, older first in ties."""
    keys = rank_key(s)
    rows = evaluations.withColumns({"eligible": eligible(s), **{f"key{i}": k for i, k in enumerate(keys)}})
    order = [F.desc("eligible"), *[F.desc(f"key{i}") for i in range(len(keys))], "step"]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*(group or [])).orderBy(*order)))  # one row an evaluation


def top_k(evaluations: DataFrame, s: Selection, k: int) -> DataFrame:
    """What a registry of ``k`` holds in the end: the best, and of equals the newest evaluations, each step once.

    A full registry takes a newcomer that is as good as one it holds and then drops its last; sorting keeps older
    equals ahead, so a newcomer that ties with the last is the one that goes.
    """
    keys = rank_key(s)
    rows = evaluations.dropDuplicates(["step"]).withColumns({"eligible": eligible(s), **{f"key{i}": x for i, x in enumerate(keys)}})
    return rows.orderBy(F.desc("eligible"), *[F.desc(f"key{i}") for i in range(len(keys))], "step").limit(k)


def best_so_far(series: DataFrame, value: str, group: list[str] | None = None, greater: bool = True) -> DataFrame:
    """``series`` with ``best`` up to each step and whether the step improved on all before."""
    before = Window.partitionBy(*(group or [])).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    fold, better = (F.max, F.greatest) if greater else (F.min, F.least)
    last = fold(value).over(before)
    won = F.col(value) > last if greater else F.col(value) < last
    return series.withColumns({"best": better(F.col(value), last), "improved": F.coalesce(won, F.col(value).isNotNull())})


def early_stopping(series: DataFrame, group: list[str], value: str, patience: int, min_delta: float = 0.0, burn_in: int = 0, greater: bool = True, eligible: str | None = None) -> DataFrame:
    """Fold of each group's evaluations in order of step: ``best_value, best_step, bad_count, stop_step``.

    A missing value is skipped. A better value than the best by more than ``min_delta`` resets the count, also during
    burn-in, when worse ones do not count. The first step at which the count reaches ``patience`` is where it stops;
    nothing after it counts. With ``eligible``, a column, an evaluation that is not eligible is never the best and counts
    against patience. State is folded inside the JVM, over one run's evaluations.
    """
    sign = 1.0 if greater else -1.0
    state = "named_struct('best', cast(null as double), 'best_step', cast(null as long), 'bad', 0, 'stop', cast(null as long))"
    rows = F.array_sort(F.collect_list(F.struct(F.col("step").cast("long").alias("step"), F.col(value).cast("double").alias("v"), (F.coalesce(F.col(eligible), F.lit(False)) if eligible else F.lit(True)).alias("ok"))))

    def merge(acc: Column, x: Column) -> Column:
        better = x["ok"] & (acc["best"].isNull() | (sign * x["v"] > sign * acc["best"] + F.lit(float(min_delta))))
        bad = F.when(x["step"] < burn_in, acc["bad"]).otherwise(acc["bad"] + 1)
        won = F.struct(x["v"].alias("best"), x["step"].alias("best_step"), F.lit(0).alias("bad"), acc["stop"].alias("stop"))
        lost = F.struct(acc["best"].alias("best"), acc["best_step"].alias("best_step"), bad.alias("bad"), F.when((bad >= patience) & (x["step"] >= burn_in), x["step"]).alias("stop"))
        return F.when(acc["stop"].isNotNull() | x["v"].isNull(), acc).when(better, won).otherwise(lost)

    folded = series.groupBy(*group).agg(rows.alias("rows")).select(*group, F.aggregate("rows", F.expr(state), merge).alias("s"))
    return folded.select(*group, F.col("s.best").alias("best_value"), F.col("s.best_step").alias("best_step"), F.col("s.bad").alias("bad_count"), F.col("s.stop").alias("stop_step"))


def generalization_gap(validation: DataFrame, probe: DataFrame, metric: str) -> DataFrame:
    """``step, gap``: probe minus validation at the same checkpoint."""
    v = validation.select("step", F.col(metric).alias("v"))
    p = probe.select("step", F.col(metric).alias("p"))
    return p.join(v, "step").select("step", (F.col("p") - F.col("v")).alias("gap"))


def degradation(series: DataFrame, group: list[str], score: str, loss: str) -> DataFrame:
    """Step of the best score, the first later step with a lower one, and the step of the least loss; ties: the earlier."""
    top = series.groupBy(*group).agg(F.max(F.struct(F.col(score), (-F.col("step")).alias("s"))).alias("t"), F.min(F.struct(F.col(loss), F.col("step").alias("s"))).alias("l"))
    marks = top.select(*group, F.col(f"t.{score}").alias("best"), (-F.col("t.s")).alias("best_step"), F.col("l.s").alias("least_loss_step"))
    later = series.join(marks, group).where((F.col("step") > F.col("best_step")) & (F.col(score) < F.col("best")))
    return marks.join(later.groupBy(*group).agg(F.min("step").alias("degraded_step")), group, "left")


def report_fields(evaluations: DataFrame, s: Selection, group: list[str] | None = None) -> DataFrame:
    """``step, mode, eligible, score, selected``: what a report says of the selection; the best evaluation is selected."""
    rows = ranked(evaluations, s, group)
    return rows.select(*(group or []), "step", F.lit(s.mode).alias("mode"), "eligible", F.col("key0").alias("score"), (F.col("eligible") & (F.col("place") == 1)).alias("selected"))
