"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector a key, the concatenated signs of its projections on random directions, and orders the vectors
of a label by it. Neighbours in that order - the runs with equal keys - are compared exactly, by cosine in double
precision; a run longer than ``TILE`` is compared in tiles of that size by separate tasks, so windows stay bounded and
no pair of a run is skipped. A pair is counted in the first pass that brings it together, which both rows can tell from
their keys, so passes add up. The key length follows the number of vectors and the number of passes follows from it: a
pair at the threshold is missed by all passes with probability ``MISS`` at most.

Equal vectors are one class from the start. Tasks give sums and spanning links for each vector, never pairs.

Defined results: vectors that are null, empty, zero, or hold nulls or non-finite components, and rows with a null label
or id, link with nothing; vectors of different lengths do not link; rows of equal id are not links of each other; a pair
at exactly the threshold is linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components, roots
from tessera.llm.runs import by_runs, column, pairs_of
from tessera.llm.scratch import Scratch

TILE = 256
MISS = 1e-7


def usable(vector: str) -> Column:
    """Whether a vector can be compared."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """``(bits, passes)`` for ``n`` vectors: about one stranger a run, and at most ``miss`` of the links lost."""
    bits = min(48, max(8, math.ceil(math.log2(max(2, n)))))
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-min(meet, 1 - 1e-12))))


def _unit(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _with_keys(rows: DataFrame, bits: int, passes: int, seed: int) -> DataFrame:
    """``rows`` with ``keys``, one a pass."""
    planes: dict[int, np.ndarray] = {}

    @F.arrow_udf("array<long>")
    def keys_of(vectors: pa.Array) -> pa.Array:
        weights = (np.int64(1) << np.arange(bits - 1, -1, -1)).astype(np.int64)
        out = []
        for at in range(0, len(vectors), 512):
            part = vectors.slice(at, 512)
            flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = part.value_lengths().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            keys = np.zeros((len(part), passes), np.int64)
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                if dims not in planes:
                    planes[dims] = np.random.default_rng([seed, dims]).normal(size=(dims, bits * passes))
                x = np.stack([flat[starts[i] : starts[i] + dims] for i in own])
                signs = (x / np.abs(x).max(axis=1, keepdims=True)) @ planes[dims] >= 0
                keys[own] = signs.reshape(len(own), passes, bits) @ weights
            out.append(keys)
        flat = np.concatenate(out) if out else np.zeros((0, passes), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * passes, pa.int32()), pa.array(flat.ravel(), pa.int64()))

    return rows.withColumn("keys", keys_of("vector"))


def _compare(threshold: float):
    """Per vector: how many vectors it is newly linked to, and a spanning link."""

    def work(table: pa.Table, group: np.ndarray) -> pa.Table:
        rep, n, side, which, dims = (table[c].to_numpy() for c in ("rep", "n", "side", "pass", "dims"))
        flat = column(table, "vector").flatten().to_numpy(zero_copy_only=False)
        keys = column(table, "keys").flatten().to_numpy().reshape(len(rep), -1)
        starts = np.concatenate([[0], np.cumsum(dims)])[:-1]
        found = np.zeros(len(rep), np.int64)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in np.unique(dims).tolist():
            own = np.flatnonzero(dims == d)
            x = _unit(flat[starts[own][:, None] + np.arange(d)], d)
            for i, j in pairs_of(group[own], side[own], 50_000):
                hit = (x[i] * x[j]).sum(axis=1) >= threshold
                i, j = own[i[hit]], own[j[hit]]
                met = ((keys[i] == keys[j]) & (np.arange(keys.shape[1]) < which[i][:, None])).any(axis=1)  # in an earlier pass
                i, j = i[~met & (rep[i] != rep[j])], j[~met & (rep[i] != rep[j])]
                np.add.at(found, i, n[j])
                np.add.at(found, j, n[i])
                out_a.append(rep[i])
                out_b.append(rep[j])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        hit = found > 0
        if len(a):
            nodes, root = roots(a, b)
            root = root[np.searchsorted(nodes, rep[hit])]
        else:
            root = rep[hit]
        return pa.table([pa.array(rep[hit]), pa.array(found[hit]), pa.array(root, pa.int64())], ["rep", "found", "root"])

    return work


def link(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 11) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    good = usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = scratch.table(rows.withColumn("good", F.coalesce(good, F.lit(False))), "rows")
    classes = rows.where("good").groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n"))
    classes = scratch.table(classes.withColumn("dims", F.size("vector")), "classes")
    bits, passes = plan(classes.count(), threshold)
    keyed = scratch.table(_with_keys(classes, bits, passes, seed), "keyed")

    places = keyed.select("label", "dims", "rep", F.posexplode("keys").alias("pass", "key"))
    runs = places.groupBy("label", "dims", "pass", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    tiles = F.greatest(F.lit(1), F.ceil(F.col("m") / F.lit(TILE))).cast("int")
    held = places.join(runs.withColumn("tiles", tiles), ["label", "dims", "pass", "key"])
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, tile).alias("x"), F.greatest(t, tile).alias("y")))
    spread = held.withColumn("tile", tile).withColumn("g", F.explode(grid))
    side = F.when(F.col("g.x") == F.col("g.y"), -1).when(F.col("tile") == F.col("g.x"), 0).otherwise(1)
    placed = spread.select("label", "dims", "pass", "key", "g.x", "g.y", "rep", side.cast("long").alias("side"))
    full = placed.join(keyed.select("label", "dims", "rep", "vector", "n", "keys"), ["label", "dims", "rep"])
    full = full.withColumns({"lab": F.xxhash64("label"), "run": F.xxhash64("dims", "pass", "key")})
    met = by_runs(full, ["lab", "run", "x", "y"], _compare(threshold), "rep long, found long, root long")
    met = scratch.table(met, "met")

    found = met.groupBy("rep").agg(F.sum("found").alias("found"))
    near = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch)
    named = classes.join(found, "rep", "left").join(near, F.col("rep") == F.col("node"), "left")
    named = named.select(
        F.col("label").alias("__label"),
        F.col("vector").alias("__vector"),
        (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    joined = rows.join(named, F.col("good") & (F.col("label") == F.col("__label")) & (F.col("vector") == F.col("__vector")), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def keep_one(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", **options: str) -> DataFrame:
    """``vectors`` without those whose component has a smaller id."""
    gone = link(vectors, threshold, id_col, **options).where(~F.col("kept")).select(id_col).distinct()
    return vectors.join(gone, id_col, "left_anti").select(*[f"`{c}`" for c in vectors.columns])


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least.m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least.m, vec_id)) AS kept
FROM embeddings LEFT JOIN cnt ON cnt.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
