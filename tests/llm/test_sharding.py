import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import sharding


def run(spark, rows, n=8, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("size", sharding.text_size())
    out = sharding.assign(df, n, group="text", id_col="doc_id", size="size", **kw)
    assert out.columns == ["doc_id", "text", "size", "shard", "slot"]
    return out.collect()


def check(rows, got, n=8):
    assert sorted((r[0], r[1] or "") for r in rows) == sorted((r["doc_id"], r["text"] or "") for r in got)
    slots, sizes, groups = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        groups[r["text"]].add(r["shard"])
        assert r["size"] == len((r["text"] or "").encode()) + 1 and 0 <= r["shard"] < n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, groups


def test_balanced_and_groups_whole(spark):
    rng = random.Random(1)
    texts = ["é" * rng.randint(1, 300) + str(i) for i in range(1500)]
    rows = [(i, texts[i % 1500], "x") for i in range(2500)]
    sizes, groups = check(rows, run(spark, rows))
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) <= 1.03 * mean and min(sizes.values()) >= 0.97 * mean
    assert all(len(s) == 1 for s in groups.values())


def test_hot_group_is_cut(spark):
    rows = [(i, "the same text for a third of all rows" if i % 3 else f"own text number {i}, of like length", "") for i in range(3000)] + [(5000, None, ""), (5001, None, ""), (5002, "", "")]
    sizes, _ = check(rows, run(spark, rows))
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) <= 1.02 * mean and min(sizes.values()) >= 0.98 * mean


def test_edges(spark):
    assert run(spark, []) == []
    rows = [(7, "x" * 100_000, ""), (8, None, "")]
    check(rows, run(spark, rows))
    rows = [(1, "again", "")] * 40  # repeated rows: all kept, and together
    sizes, _ = check(rows, run(spark, rows))
    assert len(sizes) == 1


def test_more_shards_than_a_round_resolves(spark):
    rows = [(i, str(i), "") for i in range(4000)]
    sizes, _ = check(rows, run(spark, rows, n=50), n=50)
    assert len(sizes) == 50 and max(sizes.values()) <= 1.1 * sum(sizes.values()) / 50


def test_crc_matches_zlib(spark):
    text = "ñandú 你好"
    assert spark.range(1).select(F.crc32(F.lit(text).cast("binary"))).first()[0] == zlib.crc32(text.encode())


def test_names_of_the_caller_do_not_clash(spark):
    names = ["h", "t", "row", "bin", "n", "start", "__h", "__t", "__bin", "__start"]
    rows = [(i, f"text {i}", i + 1, *range(len(names))) for i in range(50)] + [(None, None, 3, *range(len(names)))] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, size long, " + ", ".join(f"{n} int" for n in names))
    got = sharding.assign(df, 4, group="text", id_col="doc_id", size="size").collect()
    assert len(got) == 52 and all([r[n] for n in names] == list(range(len(names))) for r in got)
    for k in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == k)
        assert own == list(range(len(own)))
