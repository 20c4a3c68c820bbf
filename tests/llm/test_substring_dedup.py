import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import substring_dedup as sd

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, length):
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - length + 1):
            if doc is not None:
                k = tuple(w[i : i + length])
                least[k] = min(least.get(k, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if doc is not None and least[tuple(w[i : i + length])] < doc:
                gone.update(range(i, i + length))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def corpus(rng, length, n=60):
    vocab = [f"w{i}" for i in range(40)] + ["é", "#", "你好"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(length - 2, 3 * length))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 2 * length))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            w[at:at] = p[a : len(p) - rng.randint(0, len(p) // 3)]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    hot = " ".join(f"h{k}" for k in range(length + 5))
    rows += [(200 + i, hot + f" own{i}") for i in range(40)]
    rows += [(300, None), (301, ""), (302, "same " * 4000), (303, "same " * 700), (304, "short text"), (305, rows[3][1]), (305, rows[3][1]), (None, hot), (2, rows[5][1])]
    return rows


@pytest.mark.parametrize("length,seed", [(50, 1), (20, 2), (6, 3), (1, 4)])
def test_equals_brute_force(spark, length, seed):
    rows = corpus(random.Random(seed), length)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, places string").repartition(3)
    want = brute(rows, length)
    got = sd.digest(docs, length).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    cut = sd.remove(docs, length)
    assert cut.columns == docs.columns
    assert sorted((r["doc_id"] or -1, WORD.findall(r["text"] or "")) for r in cut.collect()) == sorted((w[0] or -1, w[4]) for w in want)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.digest(docs).count() == 0 and sd.remove(docs).count() == 0


@pytest.mark.parametrize("period", sd.COVERS)
def test_covers_meet_every_difference(period):
    cover = sd.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_cut_keeps_unaffected_layout():
    text = "a  b\nc d\te f "
    assert sd.cut_text(text, [np.array([1], np.uint32).tobytes()], 2) == "a d\te f "
    assert sd.cut_text(text, None, 2) == text
