"""SentencePiece byte-pair models in vectorised merge rounds.

A text is cut into words at its spaces, which no merge crosses; every word not met before joins one flat array of
symbols. A round finds, for all words at once, the smallest rank among a word's adjacent pairs (segmented minimum),
merges that pair's places from the left, and compacts the array; words without a pair left drop out. All places of a
word's best pair are merged in one round unless a pair that this creates ranks as well or better, in which case only the
leftmost is, so the result is that of one merge at a time in the order of rank, then place.

Ids decode by one gather from the bytes of all pieces. Models with identity normalisation, a dummy prefix and byte
fallback are handled; others are refused.

Defined results: a null text is an empty one, whose only id is the end id; any code point without a piece becomes its
UTF-8 bytes; texts of any length are encoded whole; repeated rows each get their result; an empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.memory import lean
from tessera.llm.words import slices

SPACE = "▁"
NONE = np.int32(np.iinfo(np.int32).max)


class PieceModel:
    """Tables of a model: pair ranks to encode with, piece bytes to decode with."""

    def __init__(self, path: str, cache_words: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" Åﬁ  x ") != f"{SPACE}{SPACE}Åﬁ{SPACE}{SPACE}x{SPACE}":
            raise ValueError("only models with identity normalisation and a dummy prefix are supported")
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.full(256, -1, np.int32)
        normal = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
            elif sp.is_unused(i):
                raise ValueError("unused pieces are not supported")
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                normal.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("only models with byte fallback are supported")
        self.end = sp.eos_id()
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words
        self._encoding(names, normal, [sp.get_score(i) for i in range(n)])
        self._decoding(names, normal)

    def _encoding(self, names: list[str], normal: list[int], scores: list[float]) -> None:
        """Symbols: normal pieces by id, then single characters without a piece that some piece contains, then others."""
        self.crosses = any(SPACE in names[i].lstrip(SPACE) for i in normal)
        symbol = {names[i]: i for i in normal}
        self.n_ids = len(names)
        self.chars = np.array([len(name) for name in names])
        for c in sorted({c for i in normal for c in names[i]}):
            symbol.setdefault(c, len(names) + len(symbol))
        self.width = max(symbol.values()) + 2
        self.char = np.full(0x110000, self.width - 1, np.int32)
        for name, s in symbol.items():
            if len(name) == 1:
                self.char[ord(name)] = s
        order = {score: k for k, score in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        pairs = {}
        for i in normal:
            name = names[i]
            for k in range(1, len(name)):
                a, b = symbol.get(name[:k]), symbol.get(name[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (order[scores[i]], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int32)

    def _decoding(self, names: list[str], normal: list[int]) -> None:
        data = [b""] * self.n_ids
        for i in normal:
            data[i] = names[i].replace(SPACE, " ").encode()
        for value, i in enumerate(self.byte_id.tolist()):
            data[i] = bytes([value])
        self.is_byte = np.zeros(self.n_ids, bool)
        self.is_byte[self.byte_id] = True
        self.sizes = np.array([len(d) for d in data], np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = np.frombuffer(b"".join(data), np.uint8)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the tables; the last place means no such pair."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys)) if len(self.keys) else np.zeros(len(key), np.int64)

    def merge(self, sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, and where each word begins, from first symbols. Words are not empty."""
        n = len(start)
        word = np.repeat(np.arange(n), np.diff(np.append(start, len(sym))))
        done_sym, done_word = [], []
        while len(sym):
            last = np.append(word[1:] != word[:-1], True)
            pair = np.full(len(sym), len(self.keys), np.int64)
            inner = np.flatnonzero(~last)
            pair[inner] = self._pairs(sym[inner], sym[inner + 1])
            rank = self.ranks[pair]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            over = np.repeat(best == NONE, size)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, pair = sym[~over], word[~over], rank[~over], pair[~over]
                if not len(sym):
                    break
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                size = np.diff(np.append(first, len(sym)))
                best = best[best != NONE]
            hit = np.flatnonzero(rank == np.repeat(best, size))
            # places next to each other overlap: of such a run every other one counts, from the left
            run = np.append(True, np.diff(hit) != 1)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            leftmost = np.append(True, word[hit[1:]] != word[hit[:-1]])
            if not leftmost.all():
                new = self.made[pair[hit]]
                own, r = word[hit], rank[hit]
                bad = np.zeros(len(hit), bool)
                before = hit > 0
                before[before] = word[hit[before] - 1] == own[before]
                bad[before] |= self.ranks[self._pairs(sym[hit[before] - 1], new[before])] <= r[before]
                after = hit + 2 < len(sym)
                after[after] = word[hit[after] + 2] == own[after]
                bad[after] |= self.ranks[self._pairs(new[after], sym[hit[after] + 2])] <= r[after]
                near = np.append(False, (hit[1:] - hit[:-1] == 2) & (own[1:] == own[:-1]))
                bad[near] |= self.ranks[self._pairs(new[:-1][near[1:]], new[near])] <= r[near]
                if bad.any():
                    hit = hit[leftmost | ~np.isin(own, own[bad])]
            sym = sym.copy()
            sym[hit] = self.made[pair[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int32), start
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(n))

    def _encode_words(self, words: list[str]) -> None:
        """Adds the ids of words to the cache; a word stands for itself behind one space."""
        marked = [SPACE + w.replace(" ", SPACE) for w in words]
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        start = np.concatenate([[0], np.cumsum([len(m) for m in marked])])[:-1]
        sym, first = self.merge(self.char[codes], start)
        ends = np.append(first[1:], len(sym)).tolist()
        plain = np.add.reduceat(sym >= self.n_ids, first) == 0
        for w, m, a, b, ok in zip(words, marked, first.tolist(), ends, plain.tolist()):
            if ok:
                self.cache[w] = sym[a:b].astype("<i4").tobytes()
                continue
            out, at = [], 0  # a character left without a piece becomes its bytes
            for s in sym[a:b].tolist():
                if s < self.n_ids:
                    out.append(s)
                    at += int(self.chars[s])
                else:
                    out.extend(self.byte_id[list(m[at].encode())].tolist())
                    at += 1
            self.cache[w] = np.array(out, "<i4").tobytes()

    def words(self, text: str) -> list[str]:
        """The words of a text, each without its first space."""
        parts = text.replace(SPACE, " ").split(" ")
        if self.crosses:
            return [" ".join(parts)]
        if "" not in parts:
            return parts
        out, run = [], 0
        for p in parts:
            if p:
                out.append(" " * run + p)
                run = 0
            else:
                run += 1
        if run:
            out.append(" " * (run - 1))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, the end id after each, and bounds."""
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        fresh = list(set().union(*cut).difference(self.cache)) if cut else []
        if fresh:
            self._encode_words(fresh)
        get, end = self.cache.__getitem__, np.array([self.end], "<i4").tobytes()
        raw = [b"".join(map(get, c)) + end for c in cut]
        bounds = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int64)
        return np.frombuffer(b"".join(raw), "<i4"), bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of flat ids: every piece's bytes by one gather, the first piece without its first space."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n_ids):
            raise ValueError("an id is not in the model")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        data = self.bytes[np.arange(total) - np.repeat(ends - sizes - self.firsts[ids], sizes)].tobytes()
        at = np.concatenate([[0], ends])[bounds].tolist()
        out = []
        for k, (a, b) in enumerate(zip(at, at[1:])):
            raw = data[a:b]
            own = ids[bounds[k] : bounds[k + 1]]
            spoken = own[self.sizes[own] > 0][:1]
            if len(spoken) and not self.is_byte[spoken[0]] and raw[:1] == b" ":
                raw = raw[1:]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(self._loose(own))
        return out

    def _loose(self, ids: np.ndarray) -> str:
        """Byte pieces that are not UTF-8: each byte of no valid character becomes U+FFFD."""
        out, pending = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(pending):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(pending[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            pending.clear()

        first = True
        for i in ids.tolist():
            a, n = int(self.firsts[i]), int(self.sizes[i])
            if self.is_byte[i]:
                pending += self.bytes[a : a + 1].tobytes()
            elif n:
                flush()
                piece = self.bytes[a : a + n].tobytes().decode()
                out.append(piece[1:] if first and piece[0] == " " else piece)
            first = first and not n
        flush()
        return "".join(out)


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One model a process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, ids``: each whole text's ids, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                ids, bounds = model.encode([t or "" for t in part.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"])

    rows = docs.select(id_col, "text")
    return rows.mapInArrow(lean(run), f"{id_col} {rows.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` with ``text`` instead of its other columns than ``id_col`` and ``ids``; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            lists = batch.column(1)
            step = max(1, 2_000_000 * max(1, len(lists)) // max(1, len(lists.values)))
            for at in range(0, len(lists), step):
                part = lists.slice(at, step)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                bounds = np.concatenate([[0], np.cumsum(np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
                texts = model.decode(ids, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), part, pa.array(texts, pa.string())], [id_col, "ids", "text"])

    rows = encoded.select(id_col, "ids")
    return rows.mapInArrow(lean(run), f"{id_col} {rows.schema[id_col].dataType.simpleString()}, ids array<int>, text string")
