"""Connected components of links, as tables: union-find within a task, then alternating stars between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import lean
from tessera.llm.scratch import Scratch

_EDGES = "a long, b long"
#: Links that a task joins up at once.
AT_ONCE = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(nodes, least node of each one's component)`` of links held in memory, by label passing with path halving."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning star of each group of links; groups are bounded numbers of links, joined up as the task goes."""
    held_a, held_b, n = [], [], 0

    def star() -> tuple[np.ndarray, np.ndarray]:
        nodes, root = roots(np.concatenate(held_a), np.concatenate(held_b))
        other = nodes != root
        return nodes[other], root[other]

    for batch in batches:
        held_a.append(batch.column(0).to_numpy())
        held_b.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n > AT_ONCE:
            a, b = star()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held_a, held_b, n = [], [], 0
    if n:
        a, b = star()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _with_least(links: DataFrame, salts: int = 64) -> DataFrame:
    """Links with ``m``, the least ``b`` of each ``a``. A node's links are spread over ``salts`` parts, so a hub is no one task's."""
    salted = links.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(salts)))
    parts = salted.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"))
    return salted.join(parts.select("a", "s").join(least, "a"), ["a", "s"]).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    moved = down.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node, component`` (least node reachable) for every node of ``edges`` (columns ``a``, ``b``) with a link.

    Tasks first join up the links they hold, and fewer tasks what is left, as long as that makes them fewer by a quarter.
    Then one task joins them up if they are at most ``AT_ONCE``, and otherwise rounds of stars between tasks do; both
    give the same. Each round is written, so no lineage grows, and
    the links of a node with very many are dealt to many tasks. Rounds grow with the logarithm of the longest path.
    """
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = scratch.table(links.mapInArrow(lean(_contract), _EDGES), f"{name}-0")
    mark, step, most = None, 0, None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if found[0] > AT_ONCE and mark is None and (most is None or found[0] <= most):
            most = found[0] * 3 // 4
            fewer = scratch.table(now.coalesce(-(-found[0] // AT_ONCE)).mapInArrow(lean(_contract), _EDGES), f"{name}-{step + 1}")
            scratch.drop(f"{name}-{step}")
            now, step = fewer, step + 1
            continue
        if found == mark or not found[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        if found[0] <= AT_ONCE:
            done = scratch.table(now.coalesce(1).mapInArrow(lean(_contract), _EDGES), f"{name}-last")
            scratch.drop(f"{name}-{step}")
            return done.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = found
        large = scratch.table(_large_star(now), f"{name}-{step}-large")
        scratch.drop(f"{name}-{step}")
        step += 1
        now = scratch.table(_small_star(large), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}-large")
