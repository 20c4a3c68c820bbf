"""Best-fit packing of tokenised documents into sequences with several capacities at once.

Lengths are at most one sequence, so the whole problem is a histogram: how many pieces there are of each length. The
driver packs that histogram (never the pieces): it opens a sequence with the longest piece left and adds pieces while
any fits under every residual capacity - tokens, documents, attention cost - choosing by vector best fit: the piece, or
pair of pieces, that leaves the smallest weighted residual norm, or has the largest weighted dot product with the
residual. The same choice repeats while its pieces last, so a pattern is applied as often as they do at once, and there
are a few patterns for each length, however many documents there are. Each piece then finds its place from its rank
among the pieces of its length, by a join with the pattern table, whose size depends on the sequence length alone.

Defined results: a null or empty text is one piece that holds the end id; longer documents are cut into full pieces
after a shorter first one; ties in length are broken by the hash of the id; repeated rows are each packed; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import lean
from tessera.llm.numbering import bins_for, number
from tessera.llm.scratch import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold. ``attention`` bounds the sum of squared piece lengths; None: no bound."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    rule: str = "norm"  # or "dot"
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)


class Encoder:
    """Ids of whole texts, each distinct chunk encoded once.

    No token of a byte-level model spans the start of a run of white space, so a text may be cut before a space or line
    end that follows something else, and its ids are the chunks' ids one after another.
    """

    _ODD = re.compile("[\x00\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    _MARK = re.compile(r"[,.][ \n](?<=[\W_]..)", re.DOTALL)
    _CUT = re.compile(r"(?<=\S)(?=[ \n])")  # \S is narrower in Python than in the tokenizer, so a cut is always right

    def __init__(self, path: str, cache_chunks: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_level = "ByteLevel" in type(self.tokenizer.pre_tokenizer).__name__ and self.tokenizer.normalizer is None
        self.line_end = self._ids(["\n"])[0] if self.byte_level else []
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what the cache held when it was last full; what is used again comes back
        self.cache_chunks = cache_chunks

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, text: str) -> list[str]:
        if not self.byte_level or any(t in text for t in self.special):
            return [text]
        if text.replace("\n", " ").isprintable() or self._ODD.search(text) is None:  # printable texts have no odd space
            if self._MARK.search(text) is None and (text[:1] not in ",." or text[1:2] not in " \n"):  # a mark after a letter or digit and before a space is a token by itself
                text = text.replace(", ", "\0,\0 ").replace(". ", "\0.\0 ").replace(".\n", "\0.\0\n").replace(" ", "\0 ").replace("\n", "\0\n").replace("\0\0", "\0")
                cut = text.split("\0")
            else:
                cut = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            lone = cut.count(" ") + cut.count("\n")
            if not lone or (lone == 1 and cut[-1] in (" ", "\n")):
                return cut
            text = text.replace("\0", "")
        return self._CUT.split(text)

    def _learn(self, fresh: list[str]) -> None:
        # plain chunks are joined by line ends, each of which is a token by itself, and encoded in few calls
        joined = [c for c in fresh if c[:1] == " " and c[-1] != " "] if len(self.line_end) == 1 else []
        for at in range(0, len(joined), 2000):
            part = joined[at : at + 2000]
            whole = "\n".join(part)
            if whole.count("\n") != len(part) - 1 or self._ODD.search(whole) is not None:
                continue
            ids = np.array(self._ids([whole])[0], "<u4")
            ends = (np.append(np.flatnonzero(ids == self.line_end[0]), len(ids)) * 4).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                self.cache.update(zip(part, [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]))
        rest = [c for c in fresh if c not in self.cache]
        self.cache.update((c, np.array(i, "<u4").tobytes()) for c, i in zip(rest, self._ids(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [self.chunks(t) if t else [] for t in texts]
        used = set().union(*cut)
        if len(self.cache) > self.cache_chunks:
            self.older, self.cache = self.cache, {}
        fresh = list(used.difference(self.cache))
        if self.older:
            self.cache.update((c, self.older[c]) for c in fresh if c in self.older)
            fresh = [c for c in fresh if c not in self.older]
        if fresh:
            self._learn(fresh)
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in cut]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, with_ids: bool = False, chars: int = 2_000_000) -> DataFrame:
    """Every document as pieces of at most ``size`` ids, the end id included; the first piece takes the remainder.

    Columns ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``. Texts are tokenised whole, about
    ``chars`` characters at a time.
    """

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, n = at + 1, len(texts[at])
                while end < len(texts) and n + len(texts[end]) <= chars:
                    n += len(texts[end])
                    end += 1
                out: list[list] = [[], [], [], [], [], []]
                for doc, raw in zip(ids[at:end], encode(texts[at:end])):
                    raw += last
                    n = len(raw) // 4
                    starts = [0, *range(n % size or size, n, size)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                        own = raw[4 * a : 4 * b] if len(starts) > 1 else raw
                        row = (doc, k, a, b - a, zlib.crc32(own), np.frombuffer(own, "<u4").tolist() if with_ids else None)
                        for column, value in zip(out, row):
                            column.append(value)
                at = end
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 5 + with_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids array<long>" * with_ids)


def every_capacity(tokens: int, rule: str = "norm") -> Capacity:
    """A capacity whose three parts all choose and of which only the tokens can ever bind: no sequence holds more documents than tokens."""
    return Capacity(tokens, documents=tokens, attention=tokens * tokens, rule=rule)


def patterns(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs a histogram: ``(times, [(length, copies), ...])``, each pattern holding under every capacity."""
    top = capacity.tokens
    if any(n < 1 or n > top for n in counts):
        raise ValueError("a piece is longer than a sequence")
    left = np.zeros(top + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(top + 1, dtype=np.int64)
    limits = [top, capacity.documents, capacity.attention]
    if capacity.attention is not None and any(n * n > capacity.attention for n in counts):
        raise ValueError("one piece alone exceeds the attention capacity")
    weigh = [(w, cap) for w, cap in zip(capacity.weights, limits)]
    costs = [lengths.astype(float), np.ones(top + 1), lengths.astype(float) ** 2]

    def choose(used: dict[int, int], rest: list[float]) -> list[int]:
        free = left.copy()
        for length, n in used.items():
            free[length] -= n
        fits = free > 0
        for cost, r in zip(costs, rest):
            if r is not None:
                fits &= cost <= r
        fits[0] = False
        if not fits.any():
            return []
        tokens = int(rest[0])
        if not fits[tokens]:  # no single piece fills it: two that do leave no residual
            low = np.arange(1, tokens // 2 + 1)
            high = tokens - low
            pair = fits[low] & fits[high] & ((low != high) | (free[low] > 1))
            if rest[1] is not None and rest[1] < 2:
                pair[:] = False
            if rest[2] is not None:
                pair &= low**2 + high**2 <= rest[2]
            if pair.any():
                a = int(low[np.flatnonzero(pair)[0]])
                return [tokens - a, a]
        score = np.zeros(top + 1)
        for (w, cap), cost, r in zip(weigh, costs, rest):
            if cap is not None:
                score += w * (cost / cap * r / cap if capacity.rule == "dot" else -(((r - cost) / cap) ** 2))
        score[~fits] = -np.inf
        return [int(top - np.argmax(score[::-1]))]  # ties: the longer piece

    out = []
    for first in range(top, 0, -1):
        while left[first] > 0:
            used = {first: 1}
            rest = [top - first, None if limits[1] is None else limits[1] - 1, None if limits[2] is None else limits[2] - first**2]
            while rest[0] > 0 and (added := choose(used, rest)):
                for n in added:
                    used[n] = used.get(n, 0) + 1
                    rest = [rest[0] - n, None if rest[1] is None else rest[1] - 1, None if rest[2] is None else rest[2] - n * n]
            times = int(min(left[n] // k for n, k in used.items()))
            for n, k in used.items():
                left[n] -= times * k
            out.append((times, sorted(used.items(), reverse=True)))
    return out


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Pattern table: ``length, first rank, end rank, copies, first sequence, first offset``."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, items in plan:
        offset = 0
        for length, copies in items:
            first = rank.get(length, 0)
            rank[length] = first + times * copies
            rows.append((length, first, rank[length], copies, sequence, offset))
            offset += length * copies
        sequence += times
    return rows


def pack(cut: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``cut`` is read three times: give a written table."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = _places(patterns(counts, capacity))
    schema = "length long, __first long, __end long, __copies long, __sequence long, __offset long"
    places = F.broadcast(spark.createDataFrame(table or [(0, 0, 0, 1, 0, 0)], schema))  # a few rows a length
    spread = F.xxhash64("doc_id", "piece")
    ranked = number(cut, ["length"], spread, [spread, "doc_id", "piece"], "__rank", bins_for(sum(counts.values())))
    k = F.col("__rank") - F.col("__first")
    placed = ranked.join(places, (ranked["length"] == places["length"]) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end")))
    return placed.select(
        *[ranked[c] for c in cut.columns],
        (F.col("__sequence") + F.floor(k / F.col("__copies"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + F.pmod(k, F.col("__copies")) * ranked["length"]).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces that carry ``ids``: at most one sequence's ids in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    cut = Scratch(docs.sparkSession, "packing").table(pieces(docs, tokenizer, capacity.tokens, with_ids=with_ids), "pieces")
    return pack(cut, capacity)
