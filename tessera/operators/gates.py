"""Release gates and key-by-key differences of flat tables."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import compare

OPERATORS = ("<=", "<", ">=", ">")


def check(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """``name, op, bound, value, passed, detail`` for each gate; a metric that is absent fails.

    ``metrics``: ``name, value``; ``gates``: ``name, op, bound``.
    """
    joined = gates.join(metrics.select("name", "value"), "name", "left")
    passed = F.coalesce(compare("value", "op", "bound"), F.lit(False))
    return joined.select("name", "op", "bound", "value", passed.alias("passed"), F.when(F.col("value").isNull(), "metric absent").when(passed, "ok").otherwise("failed").alias("detail"))


def validate(specs: dict[str, object], known: list[str]) -> list[str]:
    """What is wrong with gate definitions, in words."""
    problems = []
    for name, spec in specs.items():
        if name not in known:
            near = difflib.get_close_matches(name, known, 1, 0.5)
            problems.append(f"{name}: no such metric" + (f"; did you mean {near[0]}?" if near else ""))
        elif not isinstance(spec, dict) or set(spec) != {"op", "value"}:
            problems.append(f"{name}: a gate is an operator and a value")
        elif spec["op"] not in OPERATORS:
            problems.append(f"{name}: unknown operator {spec['op']!r}")
        elif isinstance(spec["value"], bool) or not isinstance(spec["value"], (int, float)):
            problems.append(f"{name}: the value is not a number")
    return problems


def unpivot(row: DataFrame, names: list[str]) -> DataFrame:
    """A table of one wide row as ``name, value``."""
    return row.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "name", "value")


def difference(left: DataFrame, right: DataFrame, critical: list[str] | None = None) -> DataFrame:
    """Full outer of ``key, value`` tables: ``key, status, left_value, right_value, critical`` of what differs."""
    a = left.select("key", F.col("value").alias("left_value"), F.lit(True).alias("__l"))
    b = right.select("key", F.col("value").alias("right_value"), F.lit(True).alias("__r"))
    status = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "changed")
    rows = a.join(b, "key", "full_outer").withColumn("status", status).where(F.col("status").isNotNull())
    return rows.select("key", "status", "left_value", "right_value", F.col("key").isin(critical or [""]).alias("critical"))


def resume_kind(differences: DataFrame, extending: list[str]) -> DataFrame:
    """One word for a resumed run: ``exact`` without differences, ``extend`` if all are of ``extending``, else ``fork``."""
    n = F.count(F.lit(1))
    only = F.coalesce(F.bool_and(F.col("key").isin(extending or [""])), F.lit(True))
    return differences.agg(F.when(n == 0, "exact").when(only, "extend").otherwise("fork").alias("kind"))


def flatten(nested: dict, prefix: str = "") -> dict[str, object]:
    """Nested settings as dotted keys."""
    out: dict[str, object] = {}
    for key, value in nested.items():
        name = f"{prefix}{key}"
        if isinstance(value, dict) and value:
            out.update(flatten(value, f"{name}."))
        else:
            out[name] = value
    return out


def merge(base: dict, over: dict) -> dict:
    """``over`` on ``base``, maps merged key by key."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def override(settings: dict, assignments: list[str]) -> dict:
    """``a.b=value`` assignments to settings that exist; values are read as JSON where they can be."""
    import json

    out = merge({}, settings)
    for text in assignments:
        path, sep, raw = text.partition("=")
        *parents, last = path.split(".")
        at = out
        for p in parents:
            if not isinstance(at.get(p), dict):
                raise KeyError(f"no setting {path!r}")
            at[p] = dict(at[p])
            at = at[p]
        if not sep or last not in at:
            near = difflib.get_close_matches(path, list(flatten(settings)), 1, 0.6)
            raise KeyError(f"no setting {path!r}" + (f"; did you mean {near[0]}?" if near else ""))
        try:
            at[last] = json.loads(raw)
        except ValueError:
            at[last] = raw
    return out


def name_differences(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """``name, problem`` of gates that ask for what a report lacks (``missing``) or has no value of (``unmeasured``)."""
    joined = gates.select("name").distinct().join(metrics.select("name", F.col("value"), F.lit(True).alias("known")), "name", "left")
    problem = F.when(F.col("known").isNull(), "missing").when(F.col("value").isNull() | F.isnan("value"), "unmeasured")
    return joined.select("name", problem.alias("problem")).where("problem is not null").distinct()
