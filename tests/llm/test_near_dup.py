import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near_dup as nd
from tessera.llm.components import components, roots
from tessera.llm.scratch import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")


def set_of(text, size):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(rows, size, percent):
    sets = [set_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] == rows[j][0]
            if same or (both and 100 * both >= percent * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, size):
    rng = random.Random(seed)
    vocab = [f"W{i}" if i % 7 else f"é{i}" for i in range(600)]
    rows, at = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(size, 120))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((at, rng.choice([" ", "\n"]).join(w)))
            at += 1
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, rows[0][1]), (1006, rows[0][1]), (1006, rows[9][1]), (1007, "same " * 30_000), (1008, "same " * 500)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent", [(2, 80), (5, 80), (2, 100)])
def test_equals_brute_force(spark, size, percent):
    rows = corpus(size, size)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component int").repartition(3)
    got = sorted(tuple(r) for r in nd.link(docs, size, percent).collect())
    assert got == brute(rows, size, percent)


def test_many_near_copies_of_one_text_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(nd, "TILE", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(2, 6)):
            w[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in nd.link(docs, 2, 80).collect()) == brute(rows, 2, 80)


def test_keep_one_and_empty(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, None, "z"), (None, "a b c d e f g", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3]
    assert nd.link(docs.limit(0)).count() == 0


def slow_superminhash(elements, slots):
    """One element after another, without early stopping."""
    out = [2**64 - 1] * slots
    for e in elements:
        p = list(range(slots))
        for j in range(slots):
            x = int(nd.mix(np.array([(int(e) + nd._STEP * (j + 1)) % 2**64], np.uint64))[0])
            k = j + (((x >> 32) * (slots - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], j << 32 | x & 0xFFFFFFFF)
    return out


def test_early_stopping_changes_nothing():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 2, 7, 40, 300)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sig = nd.superminhash(np.concatenate(sets), bounds, 16)
    for got, s in zip(sig.tolist(), sets):
        assert got == slow_superminhash(s, 16)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 150).astype(np.uint64)
        sig = nd.superminhash(np.concatenate([pool[:100], pool[50:]]), np.array([0, 100, 200]), 128)
        errors.append((sig[0] == sig[1]).mean() - 50 / 150)
    assert abs(np.mean(errors)) < 0.03


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000)] + [(2000 + rng.randrange(100), 2000 + rng.randrange(100)) for _ in range(60)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "cc")).collect()}
    e = np.array([x for x in edges if x[0] != x[1]])
    nodes, root = roots(e[:, 0], e[:, 1])
    want = {n: r for n, r in zip(nodes.tolist(), root.tolist()) if n != r}
    assert {n: c for n, c in got.items() if n != c} == want
    assert components(df.limit(0), Scratch(spark, "cc")).count() == 0


def test_links_held_by_many_tasks_need_no_rounds(spark, monkeypatch):
    from tessera.llm import components as cc

    monkeypatch.setattr(cc, "AT_ONCE", 200)
    monkeypatch.setattr(cc, "_large_star", lambda edges: pytest.fail("a round of stars"))
    links = [(i, i + 1) for i in range(60)] * 8  # every task has the same ones
    df = spark.createDataFrame(spark.sparkContext.parallelize(links, 8), "a long, b long")
    assert {(r["node"], r["component"]) for r in components(df, Scratch(spark, "cc")).collect()} == {(i, 0) for i in range(1, 61)}
