"""Removal of long word sequences that an earlier document already has.

A window is ``length`` consecutive words. Anchors are shorter windows, hashed only where the position modulo a period
lies in a difference cover: whatever the two offsets of a common window, some shift below the period moves both onto
cover positions, so every common window contains an anchor that is aligned in both documents. Few positions are hashed
(6 in 31), and only places around an anchor that occurs in two documents are extended to whole windows, which are then
compared by 128-bit fingerprints against the smallest document id that has them.

Everything is exchanged as packed arrays, by buckets of hashes. Equal windows of one batch of documents are settled in
the batch, which sends those of its smallest document only, so a passage that a third of all documents share reaches a
bucket once a batch. The number of buckets follows the bytes of text.

Defined results: null texts and texts of fewer words than a window lose nothing; rows of equal id do not remove each
other's words; a row with a null id neither loses words nor takes any; repeated rows are each judged; an empty table
gives an empty result; other columns are carried through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import lean
from tessera.llm.scratch import Scratch
from tessera.llm.words import hashes, mix, powers, slices, split

#: Period -> residues, perfect difference sets: every difference modulo the period is met.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BUCKET_BYTES = 16_000_000
_U = np.uint64


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least two fifths of a window."""
    period = max((v for v in COVERS if 5 * (length - v + 1) >= 2 * length), default=0)
    return (period, COVERS[period]) if period else (1, (0,))


def window_hashes(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of every run of ``width`` word hashes."""
    n = len(h)
    if n < width:
        return np.zeros(0, _U)
    room = 1 << n.bit_length()
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(h * powers(base, room)[:n])])
    back = powers(pow(base, -1, 1 << 64), room)[: n - width + 1]
    return mix((sums[width:] - sums[:-width]) * back)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _packed(bucket: np.ndarray, columns: list[np.ndarray], ids: np.ndarray, keys: np.ndarray, row: np.ndarray, kind: int) -> Iterator[tuple]:
    """Rows ``(bucket, kind, ids, keys, row index, columns...)``, one a bucket.

    Places go in order of document and position, as steps from one to the next, which compress to little.
    """
    order = np.lexsort((columns[-1], row, bucket))
    ends = np.flatnonzero(np.append(bucket[order][1:] != bucket[order][:-1], True)) + 1 if len(order) else []
    begin = 0
    for end in ends:
        at = order[begin:end]
        rows, local = np.unique(row[at], return_inverse=True)
        steps = [np.diff(x, prepend=x.dtype.type(0)) for x in (local.astype(np.uint32), columns[-1][at])]
        yield (int(bucket[at[0]]), kind, ids[rows].tobytes(), keys[rows].tobytes(), steps[0].tobytes(), *(c[at].tobytes() for c in columns[:-1]), steps[1].tobytes())
        begin = end


_PACKED = "bucket int, kind int, ids binary, keys binary, local binary, h1 binary, h2 binary, pos binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PACKED.split(", ")]
    types = [pa.int32(), pa.int32()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names)


def _unpack(table: pa.Table, kind: int) -> tuple[np.ndarray, ...]:
    """``ids, keys, h1, h2, pos`` of all rows of a kind, one element a place."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for r in table.select(["kind", "ids", "keys", "local", "h1", "h2", "pos"]).to_pylist():
        if r["kind"] != kind:
            continue
        local, pos = (np.cumsum(np.frombuffer(r[c], np.uint32), dtype=np.uint32) for c in ("local", "pos"))
        for out, values in zip(parts, (np.frombuffer(r["ids"], np.int64)[local], np.frombuffer(r["keys"], np.int64)[local], np.frombuffer(r["h1"], _U), np.frombuffer(r["h2"], _U), pos)):
            out.append(values)
    return tuple(np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, (np.int64, np.int64, _U, _U, np.uint32)))


def _by_row(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> pa.Table:
    """``doc_id, __key, places``: one row a document row, its places packed."""
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos = ids[order], keys[order], pos[order].astype(np.uint32)
    new = np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) if len(ids) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(ids))
    places = [pos[a:b].tobytes() for a, b in zip(first, ends)]
    return pa.table([pa.array(ids[first]), pa.array(keys[first]), pa.array(places, pa.binary())], ["doc_id", "__key", "places"])


def _words_of(part: pa.RecordBatch, text: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word hashes, bounds, row of each word, position of each word``."""
    bounds, words = split(part.column(text))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return hashes(words), bounds, row, np.arange(len(row)) - bounds[:-1][row]


def shared_anchors(keyed: DataFrame, length: int, buckets: int) -> DataFrame:
    """``doc_id, __key, places``: anchors that occur in at least two documents."""
    period, cover = cover_for(length)
    width = length - period + 1
    on_cover = np.isin(np.arange(period), cover)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
                h, bounds, row, pos = _words_of(part, 2)
                n = np.diff(bounds)
                at = np.flatnonzero(on_cover[pos % period] & (pos + width <= n[row]) & (n[row] >= length))
                if not len(at):
                    continue
                hashed, row, pos = window_hashes(h, width, BASES[0])[at], row[at], pos[at].astype(np.uint32)
                order = np.lexsort((ids[row], hashed))
                hashed, row, pos = hashed[order], row[order], pos[order]
                new = np.append(True, hashed[1:] != hashed[:-1])
                first = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                doc = ids[row]
                last = np.append(first[1:], len(doc)) - 1
                common = (doc[first] != doc[last])[group]  # two documents of this batch have it: settled here
                sent = ~common | new
                bucket = (hashed >> _U(40)).astype(np.int64) % buckets
                flag = common.astype(_U)  # nearly all zero, which packs to nothing
                yield _batch(list(_packed(bucket[sent], [hashed[sent], flag[sent], pos[sent]], ids, keys, row[sent], 0)))
                own = common & ~new
                if own.any():  # one row, to any bucket
                    none = np.zeros(int(own.sum()), _U)
                    yield _batch(list(_packed(np.full(len(none), int(bucket[0])), [none, none, pos[own]], ids, keys, row[own], 1)))

    def meet(table: pa.Table) -> pa.Table:
        ids, keys, hashed, flag, pos = _unpack(table, 0)
        own_ids, own_keys, _, _, own_pos = _unpack(table, 1)
        if len(hashed):
            order = np.argsort(hashed, kind="stable")
            s, d = hashed[order], ids[order]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            common = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | (np.maximum.reduceat(flag[order], first) > 0)
            hit = order[np.repeat(common, np.diff(np.append(first, len(s))))]
            ids, keys, pos = ids[hit], keys[hit], pos[hit]
        return _by_row(np.concatenate([ids, own_ids]), np.concatenate([keys, own_keys]), np.concatenate([pos, own_pos]))

    met = keyed.mapInArrow(lean(anchors), _PACKED).groupBy("bucket").applyInArrow(meet, "doc_id long, __key long, places binary")
    return met.groupBy("doc_id", "__key").agg(F.collect_list("places").alias("places"))


def repeated_windows(candidates: DataFrame, length: int, buckets: int) -> DataFrame:
    """``doc_id, __key, places``: starts of windows that also start in a document of smaller id.

    ``candidates``: ``doc_id, __key, text, places`` with the anchors to extend.
    """
    period, _ = cover_for(length)
    gram = min(8, length)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy()
                h, bounds, row, _ = _words_of(part, 2)
                edge = np.zeros(len(h) + 1, np.int64)
                for r, places in enumerate(part.column(3).to_pylist()):
                    at = np.frombuffer(b"".join(places), np.uint32).astype(np.int64)
                    n = bounds[r + 1] - bounds[r] - length + 1  # starts that this row has
                    low, high = np.maximum(0, at - period + 1), np.minimum(at + 1, n)
                    ok = high > low
                    np.add.at(edge, bounds[r] + low[ok], 1)
                    np.add.at(edge, bounds[r] + high[ok], -1)
                at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                if not len(at):
                    continue
                h1, h2 = window_hashes(h, length, BASES[0])[at], window_hashes(mix(h ^ _U(BASES[1])), length, BASES[1])[at]
                # windows next to each other mostly share their smallest gram, so they meet in one bucket
                least = sliding_min(window_hashes(h, gram, BASES[1]), length - gram + 1)[at]
                row, pos = row[at], (at - bounds[:-1][row[at]]).astype(np.uint32)
                order = np.lexsort((ids[row], h2, h1))
                h1, h2, least, row, pos = h1[order], h2[order], least[order], row[order], pos[order]
                new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
                smallest = ids[row][np.flatnonzero(new)][np.cumsum(new) - 1]
                sent = ids[row] == smallest  # the others' words go: a smaller document of this batch has them
                bucket = (least >> _U(24)).astype(np.int64) % buckets
                yield _batch(list(_packed(bucket[sent], [h1[sent], h2[sent], pos[sent]], ids, keys, row[sent], 0)))
                if not sent.all():
                    none = np.zeros(int((~sent).sum()), _U)
                    yield _batch(list(_packed(np.full(len(none), int(bucket[0])), [none, none, pos[~sent]], ids, keys, row[~sent], 1)))

    def meet(table: pa.Table) -> pa.Table:
        ids, keys, h1, h2, pos = _unpack(table, 0)
        own_ids, own_keys, _, _, own_pos = _unpack(table, 1)
        if len(h1):
            order = np.lexsort((h2, h1))
            a, b, d = h1[order], h2[order], ids[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            first = np.flatnonzero(new)
            hit = order[d > np.minimum.reduceat(d, first)[np.cumsum(new) - 1]]
            ids, keys, pos = ids[hit], keys[hit], pos[hit]
        return _by_row(np.concatenate([ids, own_ids]), np.concatenate([keys, own_keys]), np.concatenate([pos, own_pos]))

    met = candidates.mapInArrow(lean(extend), _PACKED).groupBy("bucket").applyInArrow(meet, "doc_id long, __key long, places binary")
    return met.groupBy("doc_id", "__key").agg(F.collect_list("places").alias("places"))


def _gone(n: int, places: list[bytes] | None, length: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of the places."""
    at = np.frombuffer(b"".join(places or []), np.uint32).astype(np.int64)
    edge = np.zeros(n + length + 1, np.int64)
    at = at[at + length <= n]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge)[:n] > 0


_WORD = re.compile("[^\x20\x09-\x0d]+")


def cut_text(text: str, places: list[bytes] | None, length: int) -> str:
    """The text without the removed words and the white space before each of them; unchanged if none is removed."""
    if not places:
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for (a, b), gone in zip(spans, _gone(len(spans), places, length).tolist()):
        if not gone:
            out.append(text[at:b])
        at = b
    return "".join(out) + text[at:]


def _digest(text: str | None, places: list[bytes] | None, length: int) -> tuple[int, int, str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not places:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    gone = _gone(len(words), places, length)
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest()


def find(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, __key, places``: starts of the removable windows of each row that has any; ``__key`` hashes its text."""
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = docs.select("doc_id", F.xxhash64("text").alias("__key"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, -(-size // BUCKET_BYTES))
    anchors = scratch.table(shared_anchors(rows, length, buckets), "anchors")
    windows = repeated_windows(rows.join(anchors, ["doc_id", "__key"]), length, buckets)
    found = scratch.table(windows, "windows")
    scratch.drop("anchors")
    return found


def remove(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with the repeated words cut from ``text``."""

    @F.pandas_udf("string")
    def cut(texts, places):
        return texts.combine(places, lambda t, p: None if t is None else cut_text(t, None if p is None else list(p), length))

    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__key"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in rest]).alias("__rest"))
    joined = keyed.join(find(docs, length), ["doc_id", "__key"], "left")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(cut("text", "places")).alias("text")
    own = {"doc_id": F.col("doc_id"), "text": text}
    return joined.select(*[own[c] if c in own else F.col(f"__rest.`{c}`") for c in docs.columns])


def digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(t, p, length) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__key"))
    joined = keyed.join(find(docs, length), ["doc_id", "__key"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS ws FROM documents
),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
),
bad AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id
),
gone AS (
  SELECT DISTINCT doc_id, i + d AS i FROM bad, (SELECT unnest(range(0, 50)) AS d)
),
words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
