import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing
from tessera.llm.queries import tokenizer_file
from tessera.llm.scratch import Scratch

TEXTS = [None, "", "short", "word " * 3000, "x" * 30_000, "a <|endoftext|> b", "  two  spaces\n\n\tand tabs ", "ünïcödé 你好 " * 40] + [f"text number {i} " * (i % 300) for i in range(400)]


def rows_of(spark, rows, capacity):
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), capacity, with_ids=True)


def check(rows, got, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = Counter()
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity.tokens or capacity.tokens
        starts = [0, *range(first, len(ids), capacity.tokens)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity.tokens
        assert capacity.documents is None or len(items) <= capacity.documents
        assert capacity.attention is None or sum(n * n for _, n in items) <= capacity.attention
    return bins


def test_whole_documents_round_trip(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again")]
    capacity = packing.every_capacity(1024)
    df = rows_of(spark, rows, capacity)
    got = df.collect()
    bins = check([r[:2] for r in rows], got, capacity)
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 1024) + 1
    joined = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(df).collect()}
    assert sum(joined.values()) == total and max(joined.values()) <= 1024


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, rule):
    rows = [(i, "several words here " * (1 + i % 9), "") for i in range(300)]
    capacity = packing.Capacity(64, documents=3, attention=2200, rule=rule)
    check([r[:2] for r in rows], rows_of(spark, rows, capacity).collect(), capacity)


def test_empty(spark):
    assert rows_of(spark, [], packing.Capacity()).collect() == []


def test_patterns_near_the_bound():
    rng = random.Random(3)
    for _ in range(20):
        counts = Counter(min(1024, int(rng.expovariate(1 / 400)) + 1) for _ in range(5000))
        plan = packing.patterns(dict(counts), packing.every_capacity(1024))
        used = Counter()
        for times, items in plan:
            assert sum(n * k for n, k in items) <= 1024
            for n, k in items:
                used[n] += times * k
        assert used == counts
        bound = max(-(-sum(n * k for n, k in counts.items()) // 1024), sum(k for n, k in counts.items() if n > 512))
        assert sum(t for t, _ in plan) <= bound * 1.005 + 1


def fewest(lengths, top):
    """Fewest sequences by trying every place for every piece."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in {n: k for k, n in enumerate(bins)}.values():
            if bins[b] + lengths[i] <= top:
                bins[b] += lengths[i]
                place(i + 1, bins)
                bins[b] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_part_chooses_and_few_sequences_do(rule):
    """The capacity of the query: all three parts are in force, and small sets are packed as exhaustive search packs them, or one more."""
    capacity = packing.every_capacity(24, rule)
    assert None not in (capacity.documents, capacity.attention) and all(capacity.weights)
    rng, more = random.Random(5), 0
    for _ in range(150):
        lengths = [rng.randint(1, 24) for _ in range(rng.randint(1, 9))]
        plan = packing.patterns(dict(Counter(lengths)), capacity)
        found = sum(times for times, _ in plan)
        assert found - fewest(lengths, 24) in (0, 1)
        more += found - fewest(lengths, 24)
    assert more <= 3


@pytest.mark.parametrize("weights", [(1.0, 0.1, 0.1), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)])
def test_every_capacity_holds_whatever_the_weights(weights):
    plan = packing.patterns({20: 1, 8: 2, 12: 1, 3: 4}, packing.Capacity(32, documents=3, attention=620, weights=weights))
    assert all(sum(n * k for n, k in items) <= 32 and sum(n * n * k for n, k in items) <= 620 and sum(k for _, k in items) <= 3 for _, items in plan)


def test_a_piece_over_the_attention_capacity_is_refused():
    with pytest.raises(ValueError):
        packing.patterns({10: 1}, packing.Capacity(64, attention=50))


ENCODER = packing.encoder(tokenizer_file("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=50), st.text(alphabet="aB, .\n", max_size=40), st.text(alphabet="ab' s,.\n\t\r\x0b\x1c\x85\xa0\u2003\u3000\x00é1", max_size=60)), max_size=6))
def test_chunks_give_the_ids_of_the_whole_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["x <|endoftext|>", "it's we'll  don't\n\n 'tis 12 34.5"]
    want = [e.ids for e in ENCODER.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in ENCODER.encode(texts)] == want


def test_chunks_that_come_back_after_a_full_cache_are_not_encoded_again():
    encoder = packing.Encoder(tokenizer_file("byte_bpe_50k.json"), cache_chunks=3)
    learnt, learn = [], encoder._learn
    encoder._learn = lambda fresh: learnt.extend(fresh) or learn(fresh)
    texts = ["one two three four", "five six", "one seven", "two five eight"]
    got = [encoder.encode([t])[0] for t in texts]
    whole = packing.Encoder(tokenizer_file("byte_bpe_50k.json"))
    assert got == [np.array(whole._ids([t])[0], "<u4").tobytes() for t in texts]
    assert sorted(learnt) == sorted(["one", " two", " three", " four", "five", " six", " seven", "two", " eight", " five"])


def test_a_cache_of_many_chunks_is_kept():
    enc = packing.Encoder(tokenizer_file("byte_bpe_50k.json"))
    enc.cache = dict.fromkeys(map(str, range(700_000)), b"")
    enc.encode(["a few words of text"])
    assert not enc.older and len(enc.cache) > 700_000
    enc.cache.update(dict.fromkeys(map(str, range(700_000, 900_000)), b""))
    enc.encode(["a few words more"])
    assert len(enc.older) > 900_000 and len(enc.cache) < 10
