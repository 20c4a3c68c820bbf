import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import sentence_pieces as spm
from tessera.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = spm.piece_model(PATH)


def same(texts):
    ids, bounds = MODEL.encode(texts)
    decoded = MODEL.decode(ids, bounds)
    for text, a, b, back in zip(texts, bounds, bounds[1:], decoded):
        want = LIB.encode(text) + [2]
        assert ids[a:b].tolist() == want, text[:80]
        assert back == LIB.decode(want), text[:80]


def test_odd_texts():
    same(["", " ", "   ", "a", " a", "a ", "  a  b\tc\n d ﬁ ", "▁a ▁", "<s></s><unk><0x0A>", "\x00x\x00", "é ​﻿", "🙂👩‍👩‍👧 漢字かな交じり文", "aaaaaaaaaaa", "ababababab", "                     x" * 5, "\n\n\n\t\t  \r\n"])
    same(["word " * 5000 + "end", "z" * 20_000, "abcabcabd" * 3000, "=-" * 4000, "".join(random.Random(1).choice("ab") for _ in range(8000))])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="abeinorst ▁\n", max_size=80)), max_size=8))
def test_any_text(texts):
    same([t.encode("utf-8", "ignore").decode() for t in texts])


def test_any_ids_decode():
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 12))]
        ids = [i for i in ids if i != 0]  # the unknown id has a surface of its own, which encoding never makes
        assert MODEL.decode(np.array(ids, np.int32), np.array([0, len(ids)])) == [LIB.decode(ids)]


def test_frames(spark):
    rows = [(1, None, "x"), (2, "some text", "y"), (2, "some text", "y"), (3, "日本 " * 900, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = spm.decode(spm.encode(docs, PATH), PATH).collect()
    assert sorted((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got) == sorted((i, tuple([*LIB.encode(t or ""), 2]), t or "") for i, t, _ in rows)
    assert spm.encode(docs.limit(0), PATH).count() == 0


def test_other_kinds_of_model_are_refused():
    with pytest.raises(Exception):
        spm.PieceModel("/nonexistent")
