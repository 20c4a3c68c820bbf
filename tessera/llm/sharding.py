"""Byte-balanced shards by histogram sort, in DataFrame operations only.

Rows are ordered by ``(hash of the group, hash of the id)``. Each round counts the exact bytes below candidate
boundaries of that order over all partitions (one small aggregate), keeps for every splitter the cell that holds its
target and lays finer probes into it, until the splitter is close enough to ``k / n`` of all bytes. Then every row
knows its shard from the splitters alone and is exchanged once, to be numbered.

A boundary between groups (equal texts) is taken when one lies within ``group_tolerance`` of the target, so groups stay
whole; a group too large for that is cut by the hash of the id, so one group with a third of all rows still spreads
evenly. The driver holds at most ``(n_shards - 1) * 2 ** BITS`` counts a round, whatever the input.

Defined results: null texts have size 1 and form one group; ties are rows with equal group and id, which stay together;
repeated rows are all kept and numbered; an empty table gives an empty result; other columns are carried through,
except that ``shard`` and ``slot`` replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.numbering import bins_for, number

BITS = 12


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text, and one for its end."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(1)).cast("long")


def _place(value: int, shift: int) -> int:
    """The lowest key of cell ``value`` at ``shift``."""
    return value << shift


def _refine(keys: DataFrame, key: str, targets: dict[int, int], below: int, total: int, tolerance: float) -> dict[int, tuple[int, int, int, int, int]]:
    """Per splitter: (cell's first key, bytes below it, first key after the cell, bytes below that, distinct-key flag).

    ``below`` bytes lie before all of ``keys``, which hold ``total`` bytes.
    """
    low_key, high_key = -(1 << 63), (1 << 63)
    cells = dict.fromkeys(targets, (low_key, below, high_key, below + total, 0))
    shift = 64
    while shift > 0:
        open_ = {k: c for k, c in cells.items() if not c[4] and min(abs(targets[k] - c[1]), abs(targets[k] - c[3])) > tolerance}
        if not open_:
            break
        inside = keys
        if shift < 64:
            inside = keys.where(F.shiftright(F.col(key), shift).isin([c[0] >> shift for c in open_.values()]))
        step = max(0, shift - BITS)
        cell = F.shiftright(F.col(key), step) if step else F.col(key)
        found = inside.groupBy(cell.alias("cell")).agg(F.sum("size").alias("b"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        by_parent: dict[int, list] = {}
        for r in found if shift < 64 else ():
            by_parent.setdefault(r["cell"] >> (shift - step), []).append(r)
        for k, (first, under, _, _, _) in open_.items():
            at = under
            rows = sorted(by_parent[first >> shift] if shift < 64 else found, key=lambda r: r["cell"])
            for r in rows:
                if at + r["b"] >= targets[k]:
                    one = r["lo"] == r["hi"]
                    start = r["lo"] if one else _place(r["cell"], step)
                    cells[k] = (start, at, start + 1 if one else _place(r["cell"] + 1, step), at + r["b"], int(one))
                    break
                at += r["b"]
        shift = step
    return cells


def splitters(keys: DataFrame, n_shards: int, tolerance: float = 0.001, group_tolerance: float = 0.01) -> list[tuple[int, int]]:
    """``n_shards - 1`` boundaries ``(h, t)``; a row lies at or after one if ``(row.h, row.t) >= (h, t)``.

    ``keys``: columns ``h``, ``t``, ``size``, cheap to read again for each round.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total or n_shards < 2:
        return []
    mean = total / n_shards
    targets = {k: total * k // n_shards for k in range(1, n_shards)}
    cells = _refine(keys, "h", targets, 0, total, tolerance * mean)
    out: dict[int, tuple[int, int]] = {}
    least = -(1 << 63)
    cut: dict[tuple[int, int, int], list[int]] = {}
    for k, (first, under, after, over, one) in cells.items():
        near_low, near_high = targets[k] - under, over - targets[k]
        if min(near_low, near_high) <= (group_tolerance if one else tolerance) * mean or not one:
            out[k] = (first, least) if near_low <= near_high else (after, least)
        else:
            cut.setdefault((first, under, over), []).append(k)
    for (h, under, over), ks in cut.items():
        found = _refine(keys.where(F.col("h") == h), "t", {k: targets[k] for k in ks}, under, over - under, tolerance * mean)
        for k, (first, low, after, high, _) in found.items():
            t = first if targets[k] - low <= high - targets[k] else after
            out[k] = (h, t) if t < (1 << 63) else (h + 1, least)
    return [out[k] for k in sorted(out)]


def _shard_of(bounds: list[tuple[int, int]], lo: int, hi: int) -> Column:
    """How many of the bounds a row is at or after: a balanced tree of comparisons over ``h`` and ``t``."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    h, t = bounds[mid]
    if h >= 1 << 63:
        return _shard_of(bounds, lo, mid)
    least = t == -(1 << 63)
    after = F.col("h") >= h if least else (F.col("h") > h) | ((F.col("h") == h) & (F.col("t") >= t))
    return F.when(after, _shard_of(bounds, mid + 1, hi)).otherwise(_shard_of(bounds, lo, mid))


def assign(rows: DataFrame, n_shards: int, group: str, id_col: str, size: str, bin_rows: int = 20_000, **tolerances: float) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    Numbering: rows fall into bins of their shard by the hash of the id; a bin's first slot is the count of the bins
    before it. No task ever holds more than about ``bin_rows`` rows of a shard, and the rows are exchanged once, by
    ``(shard, bin)``. Null ids are placed like others; rows that agree in group and id take their slots in any order; the
    caller's columns may have any names, and only ``shard`` and ``slot`` are replaced. ``rows`` are read a few times, so give a written table with narrow columns for the keys.
    """
    h, t = F.xxhash64(F.col(group)), F.xxhash64(F.col(id_col))
    keys = rows.select(h.alias("h"), t.alias("t"), F.col(size).alias("size"))
    bounds = splitters(keys, n_shards, **tolerances)
    held = rows.select(F.struct("*").alias("row"), h.alias("h"), t.alias("t"))  # so that no name of the caller's can clash
    placed = held.withColumn("shard", _shard_of(bounds, 0, len(bounds)).cast("int"))
    out = number(placed, ["shard"], F.col("t"), ["h", "t"], "slot", bins_for(rows.count(), n_shards, bin_rows))
    return out.select(*[F.col(f"row.`{c}`") for c in rows.columns if c not in ("shard", "slot")], "shard", "slot")


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder a shard, from rows that :func:`assign` has numbered."""
    rows.write.partitionBy("shard").parquet(path)
