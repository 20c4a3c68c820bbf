import math
import random

import numpy as np
import pytest

from tessera.llm import embedding_dedup as ed


def brute(rows, threshold):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ids = [r[0] for r in rows]
    links = {i: set() for i in ids}
    for i, (a, v, lab) in enumerate(rows):
        for b, w, other in rows[:i]:
            if a != b and lab is not None and lab == other and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v, float) / max(map(abs, v)), np.array(w, float) / max(map(abs, w))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return sorted(out)


@pytest.mark.parametrize("tile", [256, 8])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ed, "TILE", tile)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        center = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((len(rows), (center + rng.normal(size=16) * 0.08).tolist(), c % 3))
    rows += [(len(rows) + k, rows[5][1], rows[5][2]) for k in range(40)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1), (904, [float("nan")] * 16, 1), (905, [float("inf")] * 16, 1)]
    rows += [(906, rows[0][1], None), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (909, [1e300, 2e300], 0), (910, [-0.0, 1.0], 2), (911, [0.0, 1.0], 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string").repartition(3)
    got = sorted(tuple(r) for r in ed.link(df).collect())
    want = brute(rows, 0.98)
    assert got == want
    kept = ed.keep_one(df)
    assert kept.columns == df.columns and sorted(r["vec_id"] for r in kept.collect()) == [r[0] for r in want if r[3]]


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [r["n_links"] for r in ed.link(df).collect()] == [0, 0]
    assert ed.link(df.limit(0)).count() == 0


def test_plan_keeps_its_promise():
    for n in (2, 1000, 10**6, 10**10):
        bits, passes = ed.plan(n, 0.98)
        assert (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** passes <= 1.01 * ed.MISS
