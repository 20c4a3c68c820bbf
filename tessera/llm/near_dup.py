"""Near-duplicate documents by SuperMinHash signatures.

A document is the set of its word shingles. SuperMinHash gives each element a random permutation of the slots, step by
step, with ranks that grow by one a step; a slot keeps its least rank, so slots are filled evenly and variance falls,
and an element may stop as soon as no slot can still improve. Here all elements of a batch of documents take a step at
once. Slots are grouped into bands; documents with an equal band are candidates, which are confirmed on the full sets;
confirmed links are joined into components.

Equal sets are one class from the start, and a band's documents are first compared with the least of them, which makes
as many pairs as documents. Only documents of a band that are then still in different components are compared with each
other, in tiles of bounded size that are handled by separate tasks and give confirmed links alone, never pairs.

With 32 bands of 4 slots a pair at similarity 0.8 is missed as a candidate with probability 5e-8, and its estimate from
128 slots rules it out with about 1e-8.

Defined results: texts without words, and null texts, are empty sets, linked with nothing; a text of fewer words than a
shingle is one shingle; documents at exactly the threshold are linked; rows of equal id are one document, linked by any
of its texts; an empty table gives an empty result; other columns are ignored or carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.memory import lean
from tessera.llm.runs import by_runs, column, pairs_of
from tessera.llm.scratch import Scratch
from tessera.llm.words import hashes, mix, slices, split

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
TILE = 1024


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(elements, bounds)``: the sorted distinct shingle hashes of each text, ASCII letters in lower case."""
    bounds, words = split(pc.ascii_lower(pc.fill_null(texts, "")))
    h = hashes(words)
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(h)) - bounds[:-1][row]
    grams = h.copy()
    whole = n[row] < size  # too short: the words there are, as one
    for k in range(1, size):
        after = np.zeros(len(h), _U)
        after[: len(h) - k] = h[k:] if k < len(h) else []
        inside = pos + k < n[row]
        grams = np.where(inside, mix(grams * _U(3) + after + _U(k)), grams)
    keep = (pos + size <= n[row]) | (whole & (pos == 0))
    grams, row = mix(grams[keep] ^ _U(size)), row[keep]
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (row[1:] != row[:-1]))[: len(grams)]
    grams, row = grams[new], row[new]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int64)


def superminhash(elements: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """Signatures, ``step << 32 | rank`` by (set, slot); all ones where a set is empty."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    sig = np.full(n * slots, ~_U(0), _U)
    perm = first = None
    for j in range(slots):
        if not len(elements):
            break
        x = mix(elements + _U((_STEP * (j + 1)) & (2**64 - 1)))
        k = (j + (((x >> _U(32)) * _U(slots - j)) >> _U(32)).astype(np.int64)).astype(np.int64)
        if j == 0:
            slot = first = k
        else:
            at = np.arange(len(elements))
            if perm is None:  # the permutations so far: identity but for the first swap
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
                perm[at, 0] = first
                perm[at, first] = 0
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
            perm[at, j] = slot
        np.minimum.at(sig, row * slots + slot, (_U(j) << _U(32)) | (x & _U(0xFFFFFFFF)))
        worst = (sig.reshape(n, slots).max(axis=1) >> _U(32)).astype(np.int64)
        go = worst[row] > j  # a later step can still lower some slot of the set
        elements, row = elements[go], row[go]
        perm, first = (perm[go], first) if perm is not None else (None, first[go])
    return sig.reshape(n, slots)


def _parts(batch: pa.RecordBatch, text: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in slices(batch, text, 1_000_000):
        yield part, *shingles(part.column(text), size)


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, s1, s2, bands, sig, z``: size and hash of the set, its band keys, 16 bits a slot, the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part, elements, bounds in _parts(batch, 1, size):
                sig = superminhash(elements, bounds, bands * rows)
                short = (mix(sig + _U(_STEP)) >> _U(48)).astype("<u2")
                key = np.zeros((len(sig), bands), _U)
                for k in range(rows):
                    key = mix(key * _U(5) + sig[:, k::rows])
                key = mix(key + np.arange(1, bands + 1, dtype=_U) * _U(_STEP)).view(np.int64)
                n = np.diff(bounds)
                sums = [np.concatenate([[_U(0)], np.cumsum(mix(elements ^ _U(s)))])[bounds] for s in (1, 2)]
                s1, s2 = ((s[1:] - s[:-1]).view(np.int64) for s in sums)
                z = [None if t is None or not m else pack(t.encode("utf-8", "surrogatepass")) for t, m in zip(part.column(1).to_pylist(), n.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * bands, pa.int32()), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2), lists, pa.array([x.tobytes() for x in short], pa.binary()), pa.array(z, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "bands", "sig", "z"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary, z binary")


def _sets(packed: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return shingles(pa.array([unpack(z).decode("utf-8", "surrogatepass") for z in packed], pa.string()), size)


def _common(elements: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 2_000_000) -> np.ndarray:
    """Sizes of the intersections of sets ``a[i]`` and ``b[i]``: one set is marked, then looked up by all its partners."""
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    if len(np.unique(a)) > len(np.unique(b)):
        a, b = b, a
    code = np.unique(elements, return_inverse=True)[1]
    mark = np.zeros(len(elements) + 1, bool)
    n = np.diff(bounds)
    order = np.argsort(a, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        own = code[bounds[a[run[0]]] : bounds[a[run[0]] + 1]]
        mark[own] = True
        for part in np.split(run, np.flatnonzero(np.diff(np.cumsum(n[b[run]]) // most)) + 1):
            sizes = n[b[part]]
            first = np.cumsum(sizes) - sizes
            at = np.repeat(bounds[b[part]] - first, sizes) + np.arange(int(sizes.sum()))
            seen = np.concatenate([[0], np.cumsum(mark[code[at]])])
            out[part] = seen[first + sizes] - seen[first]
        mark[own] = False
    return out


def _likely(sig: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose signatures do not rule out the threshold: six standard deviations of an estimate at it are allowed."""
    slots = sig.shape[1]
    least = percent / 100 - 6.2 * (percent / 100 * (1 - percent / 100) / slots) ** 0.5
    out = np.ones(len(a), bool)
    for at in range(0, len(a), 20_000):
        part = slice(at, at + 20_000)
        out[part] = (sig[a[part]] == sig[b[part]]).mean(axis=1) >= least
    return out


def _linked(z: pa.Array, a: np.ndarray, b: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Which pairs of places in ``z`` meet the threshold on the full sets; only their texts are unpacked."""
    coded = z.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    a, b = code[a], code[b]
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    elements, bounds = _sets(coded.dictionary.take(pa.array(used)).to_pylist(), size)
    a, b = place[: len(a)], place[len(a) :]
    n = np.diff(bounds)
    common = _common(elements, bounds, a, b)
    return (n[a] > 0) & (n[b] > 0) & (100 * common >= percent * (n[a] + n[b] - common))


def _signatures(packed: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<u2").reshape(len(packed), -1)


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose full sets meet the threshold. ``texts``: ``doc_id, sig, z``."""
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("sig").alias(f"s{x}"), F.col("z").alias(f"z{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            i, j = np.arange(n), np.arange(n) + n
            keep = _likely(_signatures(pa.concat_arrays([batch.column(2), batch.column(3)])), i, j, percent)
            for at in range(0, int(keep.sum()), 256):
                rows = np.flatnonzero(keep)[at : at + 256]
                part = batch.take(pa.array(rows))
                m = len(rows)
                ok = pa.array(_linked(pa.concat_arrays([part.column(4), part.column(5)]), np.arange(m), np.arange(m) + m, size, percent))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])

    return joined.select("a", "b", "sa", "sb", "za", "zb").mapInArrow(lean(run), "a long, b long")


def _tile_links(size: int, percent: int):
    """Links between documents of a group that lie in different components; a pair of several groups is compared once."""

    def work(table: pa.Table, group: np.ndarray) -> pa.Table:
        ids, comp, side = (table[c].to_numpy() for c in ("doc_id", "component", "side"))
        z = column(table, "z")
        sig = _signatures(column(table, "sig"))
        text = z.dictionary_encode().indices.to_numpy().astype(np.int64)
        place = np.zeros(int(text.max()) + 1, np.int64)
        place[text] = np.arange(len(text))  # a row for each text
        found, held, n = [], [np.zeros(0, np.int64)], 0

        def settle() -> None:
            """Confirms the pairs that have come together, all partners of a text at once."""
            pair = np.unique(np.concatenate(held))
            held.clear()
            for at in range(0, len(pair), 400_000):
                x, y = place[pair[at : at + 400_000] // len(place)], place[pair[at : at + 400_000] % len(place)]
                hit = _linked(z, x, y, size, percent)
                found.append((ids[x[hit]], ids[y[hit]]))

        for i, j in pairs_of(group, side):
            open_ = comp[i] != comp[j]
            i, j = i[open_], j[open_]
            likely = _likely(sig, i, j, percent)
            i, j = text[i[likely]], text[j[likely]]
            held.append(np.minimum(i, j) * len(place) + np.maximum(i, j))
            n += len(i)
            if n > 2_000_000:
                settle()
                n = 0
        if held:
            settle()
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return work


def link(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    sketch = scratch.table(sketches(docs, size, bands, rows), "sketch")
    rowset = sketch.select("doc_id", "n_shingles", "s1", "s2")
    full = rowset.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.table(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")

    # a repeated row of a class's first document comes along; it adds nothing but itself
    first = classes.select(F.col("rep").alias("doc_id"), "s1", "s2", "n_shingles")
    banded = sketch.select("doc_id", "s1", "s2", "n_shingles", "bands").join(first, ["doc_id", "s1", "s2", "n_shingles"]).select("doc_id", "s1", "s2", F.explode("bands").alias("band"))
    banded = scratch.table(banded, "banded")
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.table(banded.join(shared, "band"), "members")
    scratch.drop("banded")
    # texts are fetched once, for documents that have a candidate
    wanted = members.select("doc_id", "s1", "s2").distinct()
    reps = scratch.table(sketch.select("doc_id", "s1", "s2", "sig", "z").join(wanted.hint("merge"), ["doc_id", "s1", "s2"]).select("doc_id", "sig", "z"), "texts")
    members = members.select("band", "doc_id", "least", "n")
    stars = members.where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = scratch.table(verify(stars, reps, size, percent), "links")
    near = components(links, scratch, "first")

    # Bands whose documents are in different components by now. Most are in the band's largest one, and are not
    # compared with each other: the others are, with each other and with all of the largest, in tiles.
    labelled = members.join(near, members["doc_id"] == near["node"], "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c"))
    biggest = F.max(F.struct("c", "component"))
    mixed = sizes.groupBy("band").agg(biggest.alias("big"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(TILE))).cast("int")
    mixed = mixed.select("band", F.col("big.component").alias("big"), tiles(F.col("big.c")).alias("tb"), tiles(F.col("n") - F.col("big.c")).alias("ts"))
    rest = labelled.join(mixed, "band")
    home = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    cell = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("long").alias("side"))
    tb, ts = home(F.col("tb")), home(F.col("ts"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_big = F.transform(every("ts"), lambda y: cell(tb, y, F.lit(0)))
    beside = F.transform(every("tb"), lambda x: cell(x, ts, F.lit(1)))
    among = F.transform(every("ts"), lambda t: cell(-1 - F.least(t, ts), F.greatest(t, ts), F.when(t == ts, -1).when(t > ts, 0).otherwise(1)))
    cells = F.when(F.col("component") == F.col("big"), of_big).otherwise(F.concat(beside, among))
    placed = rest.select("band", "doc_id", "component", F.explode(cells).alias("g")).select("band", "g.x", "g.y", "doc_id", "component", "g.side")
    more = by_runs(placed.join(reps, "doc_id"), ["band", "x", "y"], _tile_links(size, percent), "a long, b long")
    # rows of one id are one document: the classes of its texts are linked through it
    several = full.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi")).where("lo <> hi").select("doc_id")
    same = full.join(several, "doc_id").join(classes.select("s1", "s2", "n_shingles", "rep"), ["s1", "s2", "n_shingles"])
    same = same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    links = scratch.table(links.unionByName(more).unionByName(same).distinct(), "all-links")
    final = components(links, scratch, "last")

    of_class = classes.join(final, classes["rep"] == final["node"], "left").select(*[F.col(c).alias(f"__{c}") for c in ("s1", "s2", "n_shingles")], F.coalesce("component", "rep").alias("component"))
    same_set = (F.col("s1") == F.col("__s1")) & (F.col("s2") == F.col("__s2")) & (F.col("n_shingles") == F.col("__n_shingles"))
    joined = rowset.join(of_class, same_set & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, **options: int) -> DataFrame:
    """``docs`` without those whose component has a smaller id; rows without an id stay, and so do repeated rows of one id."""
    gone = link(docs, size, percent, **options).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
