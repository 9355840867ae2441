"""Merging overlapping intervals per entity into covered periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import col


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, cell_width: int = 1 << 22) -> DataFrame:
    """Covered periods and the gaps between them, for the half-open intervals of each entity.

    Starts and ends are ranked independently per entity. Behind rank k lies a gap exactly where the start of rank k+1 exceeds the end of
    rank k: there as many starts as ends lie up to the end, and as many before the next start. These boundaries, in their order, pair up: a start
    and the end behind it are a period, an end and the start behind it a gap.

    Equal values are counted before they are shuffled. Ranks are running counts inside position cells, plus the counts of the cells
    before; boundaries pair inside their cell, and only each cell's first and last one are looked at across cells. So an entity with a third of all rows is
    spread over all tasks like any other, and rows are shuffled twice: to be counted, and to their cells.

    Returns ``keys..., kind, from_pos, to_pos``; kind is ``period`` or ``gap``.

    Defined cases: a row with a NULL key or bound, or with start >= end, makes no interval and
    is left out; touching intervals (end = start) are one period; repeated rows count once; an
    empty table gives no rows; other columns, whatever their names, are ignored. Names of key
    columns are kept. ``cell_width`` is the span of positions ranked in one task: it bounds a
    task to that many distinct values and a key's cells to span / cell_width.
    """
    names = [f"k{i}" for i in range(len(keys))]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    clean = df.select(
        *[col(c).alias(k) for c, k in zip(keys, names)], col(start).cast("long").alias("s"), col(end).cast("long").alias("e")
    ).where(F.col("s") < F.col("e"))
    for k in names:
        clean = clean.where(F.col(k).isNotNull())
    ends = [F.struct(F.col(v).alias("v"), a.alias("opens"), b.alias("closes")) for v, a, b in (("s", one, none), ("e", none, one))]
    events = clean.select(*names, F.inline(F.array(*ends))).groupBy(*names, "v").agg(F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))
    # Never NULL, but said here, or the join below would say it of one side only, and the sides would not share their shuffles.
    events = events.withColumn("cell", F.floor(F.col("v") / F.lit(cell_width))).where("cell IS NOT NULL")

    # One shuffle of the counted values to their cells serves all that follows.
    inside = Window.partitionBy(*names, "cell").orderBy("v")
    before = Window.partitionBy(*names).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ranked = events.withColumns({"opened": F.sum("opens").over(inside), "closed": F.sum("closes").over(inside), "last": F.lead("v").over(inside).isNull()})
    cells = ranked.where("last").select(*names, "cell", F.coalesce(F.sum(F.col("opened") - F.col("closed")).over(before), none).alias("open_before"))
    ranked = ranked.join(cells, [*names, "cell"])
    open_ = F.col("open_before") + F.col("opened") - F.col("closed")  # the rank of the last start less that of the last end
    is_end, is_start = (F.col("closes") > 0) & (open_ == 0), (F.col("opens") > 0) & (open_ - F.col("opens") + F.col("closes") == 0)
    bounds = ranked.where(is_end | is_start).select(*names, "cell", "v", is_start.alias("is_start"))

    bounds = bounds.withColumns({"prev": F.lag("v").over(inside), "next": F.lead("v").over(inside)})
    outer = bounds.where("prev IS NULL OR next IS NULL").withColumn("across", F.lag("v").over(Window.partitionBy(*names).orderBy("v")))
    outer = outer.where("prev IS NULL AND across IS NOT NULL").select(*names, "is_start", F.col("across").alias("prev"), "v")
    both = bounds.where("prev IS NOT NULL").select(*names, "is_start", "prev", "v").unionByName(outer)
    kind = F.when(F.col("is_start"), "gap").otherwise("period").alias("kind")
    return both.select(*[F.col(k).alias(c) for c, k in zip(keys, names)], kind, F.col("prev").alias("from_pos"), F.col("v").alias("to_pos"))
