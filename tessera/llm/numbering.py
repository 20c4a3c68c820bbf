"""Gapless numbers within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.names import unused


def number(rows: DataFrame, groups: list[str], spread: Column, order: list, name: str, n_bins: int) -> DataFrame:
    """``rows`` with ``name``: a number from 0 in each group.

    Rows fall into ``n_bins`` bins of their group by the hash ``spread``; a bin starts at the count of the bins before
    it. Counts are summed map-side, and the rows are exchanged once, by group and bin. Choose ``n_bins`` in proportion
    to the rows, so that a bin stays small even if one group holds most of them.
    """
    part, n, start = unused([*rows.columns, name], "bin", "n", "start")
    binned = rows.withColumn(part, F.pmod(spread, F.lit(n_bins)))
    counts = binned.groupBy(*groups, part).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    in_bin = Window.partitionBy(*groups, part).orderBy(*order)
    out = binned.join(starts, [*groups, part]).withColumn(name, (F.col(start) + F.row_number().over(in_bin) - 1).cast("long"))
    return out.drop(part, start)


def bins_for(n_rows: int, n_groups: int = 1, bin_rows: int = 20_000) -> int:
    return max(16, -(-n_rows // (n_groups * bin_rows)))
