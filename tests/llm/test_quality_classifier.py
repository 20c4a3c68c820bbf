import random
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import language_id
from tessera.llm import quality_classifier as qc


def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 7))
    m = qc.Model(0.3, rng.normal(size=7), rng.normal(size=(7, 3)))
    for row, got in zip(x, qc.raw_score(m, x)):
        want = m.bias + row @ m.weights
        for i in range(7):
            for j in range(i + 1, 7):
                want += (m.factors[i] @ m.factors[j]) * row[i] * row[j]
        assert abs(want - got) < 1e-9


def test_features_of_odd_texts():
    texts = pa.array([None, "", " \n ", "one", "a b c a b c a b c", "# $ " * 20_000, "ünï"])
    x = qc.features(texts)
    assert x.shape == (7, qc.BUCKETS + qc.STATS) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()
    alone = np.concatenate([qc.features(texts.slice(i, 1)) for i in range(7)])
    assert np.allclose(x, alone)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words) if good else " ".join(w + rng.choice(["$$$", "###"]) for w in words), "x"))
        labels.append((i, int(good)))
    rows += [(900, None, ""), (901, "", ""), (901, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(3, None), (5000, 1)], "doc_id long, quality int")
    model = qc.fit(docs, known.where(~language_id.held_out()))
    got = qc.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    pred = {r["doc_id"]: r["predicted"] for r in got}
    out = [(pred[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(a == b for a, b in out) >= 0.95 * len(out)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in qc.score(docs, qc.fit(docs, none)).collect()] == [0.5]
    assert qc.score(docs.limit(0), qc.fit(docs, none)).count() == 0
