"""Names of the queries over the generated tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate, pairs
from tessera.plans import frame_queries, report_queries, score_queries, views

_MODULES = (frame_queries, score_queries, report_queries)
_NOT_QUERIES = {"load"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for module in _MODULES:
        for name, f in vars(module).items():
            if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == module.__name__ and name not in _NOT_QUERIES:
                found[name] = f
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal pairs of each game and delta beside the game's confusion counts and ratios."""
    counts = pairs.pair_counts(views.frames(spark, sf_dir)).groupBy("game", "delta").agg(F.sum("n_pairs").alias("n_pairs"))
    games = evaluate.with_metrics(evaluate.group_counts(views.scored(spark, sf_dir), views.THRESHOLD, "game"))
    return counts.join(games, "game")
