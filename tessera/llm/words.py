"""Words of whole texts as flat arrays: split, code and hash without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, text: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` text bytes, so that memory follows the longest text and not the batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``(bounds, words)``: words of text ``i`` are ``words[bounds[i]:bounds[i + 1]]``; a null text has none.

    Words are runs without the six ASCII spaces.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, bounds = lists.values, lists.offsets.to_numpy().astype(np.int64)
    words, bounds = words.slice(bounds[0], bounds[-1] - bounds[0]), bounds - bounds[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        words = words.filter(pa.array(full))
    return bounds, words


_BASE = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for ``i < n``."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=16)
def _bytes_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD6E8FEB86659FD93 + 1) & _MASK))


def hashes(words: pa.Array, seed: int = 0, block: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial of random values of its bytes, from running sums over all bytes."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    wide = pa.types.is_large_string(words.type) or pa.types.is_large_binary(words.type)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    table, salt = _bytes_table(seed), np.uint64((seed * 0xA0761D6478BD642F) & _MASK)
    begin = 0
    while begin < n:  # in blocks, so that the powers stay short
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + block, side="right")) - 1)
        at = ends[begin : stop + 1] - ends[begin]
        size = int(at[-1])
        room = max(block, 1 << max(0, size - 1).bit_length())
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(table[data[ends[begin] : ends[stop]]] * powers(_BASE, room)[:size], out=sums[1:])
        back = powers(pow(_BASE, -1, 1 << 64), room)[np.minimum(at[:-1], room - 1)]
        out[begin:stop] = mix((sums[at[1:]] - sums[at[:-1]]) * back + (at[1:] - at[:-1]).astype(np.uint64) + salt)
        begin = stop
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
