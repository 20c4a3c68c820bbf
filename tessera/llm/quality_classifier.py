"""A factorisation machine that scores text quality.

Features of a text: its words hashed to ``buckets`` columns (log counts, unit length), statistics of its structure, and
its length as metadata. The score is ``sigmoid(w0 + <w, x> + sum over pairs <v_i, v_j> x_i x_j)``; the pair sum costs
time linear in the features by the identity ``1/2 sum_f ((V_f . x)^2 - V_f^2 . x^2)``. Whole texts are used.

Training sees at most about ``max_docs`` labelled documents, chosen by the hash of their id; features are computed by the
executors and only they come to the driver. Everything is seeded, so a fit can be repeated.

Defined results: null and empty texts have all features 0 and get a score like any other; a document labelled more than
once counts with its mean label; without any label every score is 0.5; repeated rows and other columns do not matter; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import lean
from tessera.llm.words import hashes, mix, slices, split

BUCKETS = 4096
STATS = 14


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def _rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(1, b)


def features(texts: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """One row a text: hashed words, then structure statistics scaled to about [0, 1]."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    bounds, words = split(texts)
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(n), n_words)
    h = hashes(pc.ascii_lower(words))
    x = np.bincount(doc * buckets + (h % np.uint64(buckets)).astype(np.int64), minlength=n * buckets).reshape(n, buckets).astype(np.float32)
    np.log1p(x, out=x)
    x /= np.maximum(1e-9, np.sqrt((x * x).sum(axis=1, keepdims=True)))

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=n)

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, of))
        k, d = keys[order], of[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[new], minlength=n)

    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
    size = lambda cut: pc.utf8_length(pc.replace_substring_regex(texts, cut, "")).to_numpy(zero_copy_only=False)
    without = {name: chars - size(cut) for name, cut in {"upper": "[A-Z]", "digit": "[0-9]", "symbol": r"[#*$%&|<>{}\[\]_=~^\\/@]", "mark": "[.,;:!?]", "lines": "\n"}.items()}
    word_chars = per_doc(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(float))
    triples, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) > 2:
        inside = (doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, bool)
        triples = (mix(h[:-2]) + mix(h[1:-1] * np.uint64(3)) + mix(h[2:] * np.uint64(5)))[inside]
        of = doc[:-2][inside]
    n_triples = np.bincount(of, minlength=n)
    same = np.zeros(n)
    if len(h) > 1:
        same = np.bincount(doc[1:], weights=(h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), minlength=n)
    stats = np.stack(
        [
            np.log1p(n_words) / 10,
            np.log1p(chars) / 12,
            _rate(word_chars, n_words) / 10,
            _rate(distinct(h, doc), n_words),
            _rate(n_triples - distinct(triples, of), n_triples),
            _rate(same, n_words),
            _rate(without["upper"], chars),
            _rate(without["digit"], chars),
            _rate(without["symbol"], chars) * 3,
            _rate(without["mark"], chars) * 3,
            _rate(without["lines"], n_words) * 3,
            (n_words < 10).astype(float),
            _rate(without["symbol"], n_words),
            _rate(without["mark"], n_words),
        ],
        axis=1,
    ).astype(np.float32)
    return np.concatenate([x, stats], axis=1)


def raw_score(model: Model, x: np.ndarray) -> np.ndarray:
    """The machine's value for each row, in time linear in the features."""
    sums = x @ model.factors
    squares = (x * x) @ (model.factors * model.factors)
    return model.bias + x @ model.weights + 0.5 * (sums * sums - squares).sum(axis=1)


def train(x: np.ndarray, y: np.ndarray, rank: int = 8, epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 1e-5, seed: int = 17) -> Model:
    """Adam on the logistic loss, seeded."""
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    p = [np.array([np.log(mean / (1 - mean))]), np.zeros(dims), rng.normal(0, 0.02, (dims, rank))]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            xb, yb = x[order[at : at + batch]].astype(float), y[order[at : at + batch]]
            sums = xb @ p[2]
            z = p[0] + xb @ p[1] + 0.5 * (sums**2 - (xb**2) @ (p[2] ** 2)).sum(axis=1)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(yb)
            grads = [np.array([e.sum()]), xb.T @ e + decay * p[1], xb.T @ (e[:, None] * sums) - ((xb**2).T @ e)[:, None] * p[2] + decay * p[2]]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(float(p[0][0]), p[1].astype(np.float32), p[2].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = 2500, buckets: int = BUCKETS, **options) -> Model:
    """A model from labelled documents; keep what must not be learned out of ``labels``."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = {r["doc_id"]: r["y"] for r in known.where(place < min(1.0, max_docs / max(1, n))).collect()}
    empty = Model(0.0, np.zeros(buckets + STATS, np.float32), np.zeros((buckets + STATS, 1), np.float32))
    if not chosen:
        return empty

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                for at in range(0, part.num_rows, 256):
                    piece = part.slice(at, 256)
                    rows = []
                    for row in features(piece.column(1), buckets):
                        cols = np.flatnonzero(row).astype(np.int32)
                        rows.append((cols.tobytes(), row[cols].tobytes()))
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "cols", "vals"])

    some = docs.select("doc_id", "text").where(F.col("doc_id").isin(list(chosen)))
    rows = sorted(some.mapInArrow(lean(sparse), f"doc_id {some.schema['doc_id'].dataType.simpleString()}, cols binary, vals binary").collect(), key=lambda r: (r["doc_id"], bytes(r["cols"])))
    if not rows:
        return empty
    x = np.zeros((len(rows), buckets + STATS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["cols"], np.int32)] = np.frombuffer(r["vals"], np.float32)
    return train(x, np.array([chosen[r["doc_id"]] for r in rows], float), **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", cut: float = 0.7) -> DataFrame:
    """``id_col, score, predicted`` for every row; only the text is looked at."""
    buckets = len(model.weights) - STATS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                for at in range(0, part.num_rows, 256):
                    piece = part.slice(at, 256)
                    z = raw_score(model, features(piece.column(1), buckets)).astype(float)
                    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], [id_col, "score", "predicted"])

    rows = docs.select(id_col, "text")
    return rows.mapInArrow(lean(run), f"{id_col} {rows.schema[id_col].dataType.simpleString()}, score double, predicted int")
