"""Operators on signal tracks and interval files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import staged
from .intervals import periods_and_gaps


def bin_track(track: DataFrame, sizes: DataFrame, step: int, keys: Sequence[str] = ("chrom",), default: float = 0.0) -> DataFrame:
    """Mean of a track (chrom, start, end, value; no overlaps) in steps from each chromosome's start, ``default`` where it has no value.

    Weighted by overlap length: bases are never expanded. The last step of a chromosome may be shorter.
    """
    s, e = F.col("start"), F.col("end")
    rows = track.join(sizes, "chrom").withColumn("end", F.least(e, F.col("size"))).where("end > start AND start >= 0")
    bins = F.explode(F.sequence(F.floor(s / step), F.floor((e - 1) / step))).alias("i")
    rows = rows.select(*keys, s, e, "value", bins)
    over = F.least(e, (F.col("i") + 1) * step) - F.greatest(s, F.col("i") * step)
    sums = rows.groupBy(*keys, "i").agg(F.sum(over * F.col("value")).alias("__s"), F.sum(over).alias("__n"))
    spine = sizes.select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / step) - 1)).alias("i"))
    width = F.least(F.lit(step).cast("long"), F.col("size") - F.col("i") * step)
    full = spine.join(sums, ["chrom", "i"], "left")
    mean = (F.coalesce("__s", F.lit(0.0)) + default * (width - F.coalesce("__n", F.lit(0)))) / width
    return full.select("chrom", "i", (F.col("i") * step).alias("x"), mean.alias("value"))


def track_range(track: DataFrame, sizes: DataFrame, chrom: str, start: int, end: int, default: float = 0.0) -> DataFrame:
    """``start, end, value`` runs that cover [start, end) of a chromosome: the track's intervals (no overlaps) cut to the range, ``default`` between them.

    A chromosome that ``sizes`` does not have is one run without a value.
    """
    inside = track.where((F.col("chrom") == chrom) & (F.col("end") > start) & (F.col("start") < end)).where("start < `end`")
    cut = inside.select(F.greatest("start", F.lit(start).cast("long")).alias("start"), F.least("end", F.lit(end).cast("long")).alias("end"), "value")
    spark = track.sparkSession
    whole = spark.createDataFrame([(start, end)], "start long, end long")
    known = sizes.where(F.col("chrom") == chrom).limit(1).select(F.lit(True).alias("known"))
    # Gaps of the periods that the intervals cover, the range's own borders included.
    borders = cut.select(F.lit("r").alias("k"), "start", "end")
    for at in (start, end):
        borders = borders.unionByName(spark.createDataFrame([("r", at - 1, at)] if at == start else [("r", at, at + 1)], "k string, start long, end long"))
    gaps = periods_and_gaps(borders, ["k"], "start", "end").where("kind = 'gap'").select(F.col("from_pos").alias("start"), F.col("to_pos").alias("end"), F.lit(float(default)).alias("value"))
    runs = cut.unionByName(gaps).join(known, F.lit(True)).select("start", "end", "value")
    return runs.unionByName(whole.join(known, F.lit(True), "left_anti").select("start", "end", F.lit(None).cast("double").alias("value")))


def track_limits(binned: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    return binned.groupBy(*keys).agg(F.lit(0.0).alias("low"), F.max("value").alias("high"))


def drop_overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], cell_width: int = 1 << 22, rounds: int = 64) -> DataFrame:
    """Sorted by start (and ``order``), a row is kept if it begins at or behind the end of the last row kept of its key.

    Of the rows of one start only the first can be kept, and behind a kept row comes the first start at or behind its end: every start has one successor. The first
    start of a covered period is always kept. From these on, kept starts are marked along the successors, with jumps that double in every round, so that a period that
    overlaps in one chain of n rows takes log2(n) rounds of equality joins. Successors are running values inside position cells, and over the cells' first starts.
    Rows whose bounds make no interval, or with a NULL key, are dropped.
    """
    k = list(keys)
    rows = df.where(F.col(start) < F.col(end))
    for c in k:
        rows = rows.where(F.col(c).isNotNull())
    whole = F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], *[F.col(c).alias(f"c{n}") for n, c in enumerate(df.columns)])
    first = staged(rows.groupBy(*k, F.col(start).cast("long").alias("__s")).agg(F.min(whole).alias("__row")))
    stop = F.col("__row")[f"c{df.columns.index(end)}"].cast("long")

    places = F.array(F.struct(F.col("__s").alias("v"), F.col("__s").alias("at")), F.struct(stop.alias("v"), F.lit(None).cast("long").alias("at")))
    events = first.select(*k, F.inline(places)).groupBy(*k, "v").agg(F.max("at").alias("at")).withColumn("__cell", F.floor(F.col("v") / cell_width)).where("__cell IS NOT NULL")
    inside = Window.partitionBy(*k, "__cell").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy(*k).orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = events.groupBy(*k, "__cell").agg(F.min("at").alias("__first")).select(*k, "__cell", F.last("__first", True).over(beyond).alias("__next"))
    following = events.withColumn("__in", F.last("at", True).over(inside)).join(cells, [*k, "__cell"])
    following = following.select(*k, F.col("v").alias("__e"), F.coalesce("__in", "__next").alias("__to")).where("__to IS NOT NULL")
    jump = staged(first.select(*k, "__s", stop.alias("__e")).join(following, [*k, "__e"]).select(*k, "__s", "__to"))

    marked = periods_and_gaps(rows, k, start, end).where("kind = 'period'").select(*k, F.col("from_pos").alias("__s"))
    marked = staged(marked)
    for _ in range(rounds):
        new = staged(marked.join(jump, [*k, "__s"]).select(*k, F.col("__to").alias("__s")).distinct().join(marked, [*k, "__s"], "left_anti"))
        if new.isEmpty():
            break
        marked = staged(marked.unionByName(new))
        jump = staged(jump.join(jump.select(*k, F.col("__s").alias("__to"), F.col("__to").alias("__further")), [*k, "__to"]).select(*k, "__s", F.col("__further").alias("__to")))
    else:
        raise RuntimeError(f"rows were still being marked after {rounds} rounds")
    kept = first.join(marked, [*k, "__s"]).select("__row")
    return kept.select(*[F.col("__row")[f"c{n}"].alias(c) for n, c in enumerate(df.columns)])


def genes_in_region(gtf: DataFrame, chrom: str, start: int, end: int, highlight: Sequence[str] = ()) -> DataFrame:
    """Genes that overlap a region (closed bounds), or transcripts if there are none: label, clipped bounds, highlighting."""
    hit = gtf.where((F.col("seqname") == chrom) & (F.col("start") <= end) & (F.col("end") >= start))
    genes, transcripts = (hit.where(F.col("feature") == f) for f in ("gene", "transcript"))
    none = genes.agg(F.count("*")).scalar() == 0
    names = [F.nullif(F.element_at(F.try_element_at(F.col("attrs"), F.lit(a)), 1), F.lit("")) for a in ("gene_name", "transcript_id", "gene_id")]
    label = F.coalesce(*names)
    return genes.unionByName(transcripts.where(none)).select(
        label.alias("label"), F.greatest("start", F.lit(start)).alias("start"), F.least("end", F.lit(end)).alias("end"), "strand",
        F.coalesce(label.isin(*highlight) if highlight else F.lit(False), F.lit(False)).alias("highlight"),
    )


def renamed_chromosomes(df: DataFrame, prefix: str = "chr", column: str = "chrom") -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix), F.col(column)))


def clipped(track: DataFrame, sizes: DataFrame) -> DataFrame:
    """Intervals cut at their chromosome's end; those beyond it, or on unknown chromosomes, are left out."""
    return track.join(sizes, "chrom").where("start < size").withColumn("end", F.least("end", "size")).select(*track.columns)
