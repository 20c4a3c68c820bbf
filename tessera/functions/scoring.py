"""Models as functions over batches of rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_scorers: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def register_scorer(name: str, scorer: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    """``scorer`` takes a batch and returns ``logit0, logit1`` for its rows."""
    _scorers[name] = scorer


def resolve(reference: str) -> Callable:
    """``module:function``, or a registered name."""
    if reference in _scorers:
        return _scorers[reference]
    module, sep, name = reference.partition(":")
    if not sep:
        raise KeyError(f"no scorer {reference!r}")
    return getattr(importlib.import_module(module), name)


def score(rows: DataFrame, reference: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``logit0, logit1, margin, p``; a batch of another shape is an error."""
    scorer = resolve(reference)

    @F.pandas_udf("logit0 double, logit1 double")
    def run(*inputs: pd.Series) -> pd.DataFrame:
        batch = pd.concat(list(inputs), axis=1, keys=columns)
        out = scorer(batch)
        if list(out.columns) != ["logit0", "logit1"] or len(out) != len(batch):
            raise ValueError("a scorer returns logit0 and logit1 for every row")
        return out.astype("float64").reset_index(drop=True)

    from tessera.functions.scalars import probability

    scored = rows.withColumn("__l", run(*columns)).select("*", "__l.*").drop("__l").withColumn("margin", F.col("logit1") - F.col("logit0"))
    return scored.withColumn("p", probability("margin"))
