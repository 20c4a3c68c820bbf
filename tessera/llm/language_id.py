"""Language by cross-parsing: how few phrases of a language's text does it take to spell this one?

A suffix automaton of some labelled text per language recognises every substring of it. A text is parsed greedily into
longest matches; by Ziv and Merhav, ``phrases * log2(reference length) / text length`` estimates the cross entropy, and
the language with the least wins. Texts are parsed whole. All blocks of ``BLOCK`` symbols of a batch advance through all
automata one symbol at a time, as arrays, each as if a phrase began with it; then, block after block, the open phrase of
the block before is carried on until it meets the state that the block's own parse was in, from where both are one. The
phrases are those of one parse from the first symbol to the last, whatever the block size.

The reference text is a bounded sample of rows: at most ``docs_per_lang`` labelled documents a language, whole, of every
language. Memory follows their length. States with one way on, most of them, are kept as one symbol and one state.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned;
letters never seen in training are phrases of their own; ties go to the language first in order of name; repeated rows
and other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.memory import lean
from tessera.llm.words import slices

BLOCK = 1024
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    texts: tuple[str, ...]

    @property
    def key(self) -> str:
        return hashlib.sha256(repr((self.langs, self.texts)).encode()).hexdigest()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2; and rows without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def normalise(text: str) -> str:
    """Lower case, each run of anything but letters one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def fit(docs: DataFrame, docs_per_lang: int = 80) -> Model:
    """A model from the non-null ``text`` and ``lang`` of ``docs``.

    The sample is what has the smallest hashes of the id: the share of rows to look at follows from counts, so only
    about twice the sample comes to the driver.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", F.least(F.lit(1.0), (2 * docs_per_lang + 20) / F.col("n")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = usable.join(F.broadcast(counts), "lang").where(place < F.col("share")).select("lang", "doc_id", place.alias("place"), "text").collect()
    by_lang: dict[str, list] = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r["place"], str(r["doc_id"]), r["text"]))
    langs, texts = [], []
    for lang in sorted(by_lang):
        own = sorted(by_lang[lang])[:docs_per_lang]
        text = "  ".join(dict.fromkeys(filter(None, (normalise(t) for _, _, t in own))))
        if text:
            langs.append(lang)
            texts.append(f" {text} ".replace("  ", " "))
    return Model(tuple(langs), tuple(texts))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the empty one.

    States are in order of their shortest substrings, so that those met most often lie together in memory.
    """
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    depth = np.array([length[k] + 1 if k >= 0 else 0 for k in link])
    order = np.argsort(depth, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    place = place.tolist()
    return [{s: place[to] for s, to in moves[state].items()} for state in order.tolist()]


def parse_room(n_langs: int) -> int:
    """Symbols that are parsed at once, so that what is kept of a parse has a bound."""
    return max(BLOCK, min(2_000_000, 8_000_000 // max(1, n_langs)))


class Parser:
    """All automata of a model in one table: next state by (state, symbol), -1 for none."""

    def __init__(self, model: Model):
        self.langs = model.langs
        letters = sorted(set("".join(model.texts)) - {" "})
        self.width = len(letters) + 2  # 0: between words, last: letters never seen
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[c for c in range(0x110000) if chr(c).isalpha()]] = self.width - 1
        for k, c in enumerate(letters):
            self.code[ord(c)] = k + 1
        # symbol and next state of states with one way on; a row of the table for the root and for states with more
        symbol, following, row_of, tables, roots, base, n_rows = [], [], [], [np.full((1, self.width), -1, np.int32)], [], 0, 1
        for text in model.texts:
            moves = suffix_automaton(self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tolist())
            wide = [state for state, out in enumerate(moves) if state == 0 or len(out) > 1]
            table = np.full((len(wide), self.width), -1, np.int32)
            for k, state in enumerate(wide):
                for s, to in moves[state].items():
                    table[k, s] = base + to
            place = np.zeros(len(moves), np.int32)
            place[wide] = n_rows + np.arange(len(wide))
            one = [next(iter(out.items())) if len(out) == 1 and state else (-1, -1 - base) for state, out in enumerate(moves)]
            symbol.append(np.array([s for s, _ in one], np.int32))
            following.append(np.array([to + base for _, to in one], np.int32))
            row_of.append(place)
            tables.append(table)
            roots.append(base)
            base, n_rows = base + len(moves), n_rows + len(wide)
            del moves, one
        symbol, following, row_of = (np.concatenate(x) for x in (symbol, following, row_of))
        self.table = np.concatenate(tables).ravel()
        self.roots = np.array(roots, np.int32)[:, None]
        first = self.table.reshape(-1, self.width)[row_of[self.roots[:, 0]]]
        self.restart = np.where(first < 0, self.roots, first)  # an unseen symbol is a phrase by itself: back to the root
        self.alone = (first < 0).astype(np.int32)
        # by state: its one symbol and the state after it, or no symbol and where its row of the table begins
        one = row_of == 0
        self.ways = np.where(one, symbol.astype(np.int64) << 40 | np.where(following < 0, 0, following), -1 << 40 | row_of * np.int64(self.width))
        self.ways[one & (symbol < 0)] = -2 << 40  # the end of a reference text: no way on
        self.bits = np.log2(np.array([[max(2, len(t))] for t in model.texts], float))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, where each text begins, and its number of letters."""
        lowered = [t.lower() for t in texts]
        codes = self.code[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
        letters = np.concatenate([[0], np.cumsum(codes != 0)])[bounds]
        before = np.concatenate([[0], codes[:-1]])
        before[bounds[:-1][bounds[:-1] < len(codes)]] = 0
        keep = (codes != 0) | (before != 0)
        return codes[keep], np.concatenate([[0], np.cumsum(keep)])[bounds], np.diff(letters)

    def _advance(self, lang: np.ndarray, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(next state, phrases closed)`` of parses of a language each."""
        ways = self.ways.take(state)
        symbol = ways >> 40
        to = (ways & ((1 << 40) - 1)).astype(np.int32)
        other = np.flatnonzero(symbol != c)  # of those the ones with several ways on look theirs up
        wide = other[symbol.take(other) == -1]
        to[other[symbol.take(other) != -1]] = -1
        to[wide] = self.table.take((ways.take(wide) & ((1 << 40) - 1)) + c.take(wide))
        closed = np.zeros(len(state), np.int32)
        miss = other[to.take(other) < 0]
        of, by = lang.take(miss), c.take(miss)
        closed[miss] = (state.take(miss) != self.roots[:, 0].take(of)) + self.alone[of, by]
        to[miss] = self.restart[of, by]
        return to, closed

    def phrases(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases by (language, text). Long texts go on in parts, each from the states that the one before ended in."""
        room = parse_room(len(self.langs))
        out, last = np.zeros((len(self.langs), len(bounds) - 1)), np.repeat(self.roots, len(bounds) - 1, axis=1)
        begin, left = bounds[:-1], np.diff(bounds)
        while (texts := np.flatnonzero(left > 0)).size:
            size = np.minimum(left[texts], room)
            closed, last[:, texts] = self._closed(codes, begin[texts], size, last[:, texts])
            out[:, texts] += closed
            begin, left = begin.copy(), left.copy()
            begin[texts] += size
            left[texts] -= size
        return out + (last != self.roots)

    def _closed(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(phrases closed, last state)`` by (language, part); ``last`` has the states before."""
        langs, last = len(self.langs), last.copy()
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        part = np.repeat(np.arange(len(sizes)), blocks)
        k = np.arange(len(part)) - first[part]
        begin = starts[part] + k * BLOCK
        size = np.minimum(BLOCK, sizes[part] - k * BLOCK)
        order = np.argsort(-size, kind="stable")
        start, length = begin[order], size[order]
        column = np.empty(len(part), np.int64)  # a block's place among the blocks by length
        column[order] = np.arange(len(part))
        state = np.repeat(self.roots, len(part), axis=1)
        count = np.zeros(state.shape, np.int32)
        states, counts = [], []  # by symbol of a block: of every language and block that has it
        for t in range(int(length[0])):
            running = int(np.searchsorted(-length, -t, side="left"))  # those longer than t come first
            now, closed = self._advance(np.repeat(np.arange(langs), running), state[:, :running].ravel(), np.tile(codes.take(start[:running] + t), langs))
            state[:, :running] = now.reshape(langs, running)
            count[:, :running] += closed.reshape(langs, running)
            states.append(now.reshape(langs, running))
            counts.append(count[:, :running].astype(np.uint16))
        own = np.empty_like(count)
        own[:, order] = count
        ends = np.empty_like(state)
        ends[:, order] = state
        # every block as entered from the end of the block before, and again where that end turns out to be another
        entry = np.concatenate([ends[:, :1], ends[:, :-1]], axis=1)
        entry[:, first] = last
        extra, exits = np.zeros(ends.shape, np.int64), ends.copy()
        of, lane = (x.ravel() for x in np.indices(ends.shape))
        while len(of):
            before = exits[of, lane]
            extra[of, lane], exits[of, lane] = self._carried(of, entry[of, lane], codes, begin[lane], size[lane], states, counts, column[lane], ends[of, lane])
            follows = np.append(part[1:] == part[:-1], False)
            again = (exits[of, lane] != before) & follows[lane]
            of, lane = of[again], lane[again] + 1
            entry[of, lane] = exits[of, lane - 1]
        return np.add.reduceat(own + extra, first, axis=1), exits[:, first + blocks - 1]

    def _carried(self, of, now, codes, begin, size, states, counts, column, ends) -> tuple[np.ndarray, np.ndarray]:
        """``(phrases closed beyond the block's own, last state)`` of parses that enter a block in state ``now``."""
        more, out = np.zeros(len(of), np.int64), ends.copy()
        lane = np.flatnonzero(now != self.roots[of, 0])
        of, now, t = of[lane], now[lane], 0
        while len(lane):
            now, closed = self._advance(of, now, codes.take(begin[lane] + t))
            more[lane] += closed
            at = column[lane]
            met, over = now == states[t][of, at], t + 1 == size[lane]
            done = met | over
            more[lane[done]] -= counts[t][of[done], at[done]]
            out[lane[over]] = now[over]
            of, lane, now, t = of[~done], lane[~done], now[~done], t + 1
        return more, out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        codes, bounds, letters = self.symbols(texts)
        cost = self.phrases(codes, bounds) * self.bits / np.maximum(1, np.diff(bounds))
        best = cost.argmin(axis=0)
        least = cost.min(axis=0)
        if len(self.langs) > 1:
            second = np.partition(cost, 1, axis=0)[1]
            score = np.where(second > 0, 1 - least / np.maximum(second, 1e-300), 0.0)
        else:
            score = np.ones(len(texts))
        known = letters > 0
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, known)], np.where(known, score, 0.0)


_parsers: dict[str, Parser] = {}


def _parser(model: Model, key: str) -> Parser:
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(model)
    return _parsers[key]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id_col, lang_pred, score`` for every row; only the text is looked at."""
    key = model.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, parse_room(len(model.langs))):
                texts = [t or "" for t in part.column(1).to_pylist()]
                if model.langs:
                    langs, scores = _parser(model, key).predict(texts)
                else:
                    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    rows = docs.select(id_col, "text")
    return rows.mapInArrow(lean(run), f"{id_col} {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
