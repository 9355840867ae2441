"""Contact maps as relations: sparse pixels genome-wide, and the dense triangle of a region.

Bins: ``chrom, i, bin_id, start, end`` (``i`` counts within the chromosome, ``bin_id`` through all of them).
Pixels: ``bin1_id, bin2_id, count`` with bin1_id <= bin2_id; an absent pixel is 0.
Dense maps: ``region, i, j, v`` with i <= j and every cell present; NULL is masked, 0 is an observed zero; ``n`` bins per region
come from the map itself.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import running_totals, staged, unstage

# ---------------------------------------------------------------- bins and pixels


def make_bins(sizes: DataFrame, resolution: int) -> DataFrame:
    """All bins of an assembly, the last of a chromosome cut at its end. The offsets' window runs over chromosomes, not bins."""
    n = F.ceil(F.col("size") / resolution)
    before = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("chrom", "size", n.alias("n"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("offset"))
    bins = first.select("chrom", "size", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    start = F.col("i") * resolution
    return bins.select("chrom", "i", (F.col("offset") + F.col("i")).alias("bin_id"), start.alias("start"), F.least(start + resolution, F.col("size")).alias("end"))


def _offsets(bins: DataFrame) -> DataFrame:
    return bins.groupBy("chrom").agg(F.min("bin_id").alias("offset"))


def count_pixels(pairs: DataFrame, bins: DataFrame, resolution: int, keys: Sequence[str] = (), also: Mapping[str, Column] | None = None) -> DataFrame:
    """Pairs (1-based positions on known chromosomes) counted into pixels, per ``keys`` if given; ``also`` counts those that meet a condition beside them."""
    also = dict(also or {})
    pairs = pairs.withColumns(also) if also else pairs
    offsets = _offsets(bins)
    for k in (1, 2):
        pairs = pairs.join(offsets.select(F.col("chrom").alias(f"chrom{k}"), F.col("offset").alias(f"__o{k}")), f"chrom{k}")
    a, b = (F.col(f"__o{k}") + F.floor((F.col(f"pos{k}") - 1) / resolution) for k in (1, 2))
    pixels = pairs.select(*keys, *also, F.least(a, b).alias("bin1_id"), F.greatest(a, b).alias("bin2_id")).where("bin1_id IS NOT NULL AND bin2_id IS NOT NULL")
    return pixels.groupBy(*keys, "bin1_id", "bin2_id").agg(F.count("*").alias("count"), *[F.count_if(F.col(c)).alias(c) for c in also])


def merge_pixels(*maps: DataFrame) -> DataFrame:
    """The sum of several maps of the same bins."""
    both = maps[0]
    for m in maps[1:]:
        both = both.unionByName(m)
    return both.groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias("count"))


def _layout(bins: DataFrame) -> list[tuple[int, str]]:
    """First bin and name of every chromosome, in order; a row a chromosome, on the driver."""
    return sorted((r["offset"], r["chrom"]) for r in _offsets(bins).collect())


def _among(bin_id: Column, firsts: Sequence[int], values: Sequence) -> Column:
    """The value of the chromosome that a bin lies in, from the chromosomes' first bins: a comparison, where a join would shuffle the pixels by their bins."""
    if not firsts:
        return F.lit(None)
    at = F.size(F.filter(F.array(*map(F.lit, firsts)), lambda f: f <= bin_id))
    if len(firsts) <= 64:  # compiled
        at = sum((F.when(bin_id >= f, 1).otherwise(0) for f in firsts[1:]), F.lit(1))
    return F.element_at(F.array(*map(F.lit, values)), at)


def zoom_pixels(pixels: DataFrame, bins: DataFrame, coarse: DataFrame, factor: int) -> DataFrame:
    """Pixels of ``factor`` times coarser bins; bins are joined within their chromosome and never across."""
    fine, up = _layout(bins), dict((c, f) for f, c in _layout(coarse))
    firsts, parents = [f for f, _ in fine], [up[c] for _, c in fine]

    def parent(bin_id: Column) -> Column:
        return (_among(bin_id, firsts, parents) + F.floor((bin_id - _among(bin_id, firsts, firsts)) / factor)).cast("long")

    p1, p2 = parent(F.col("bin1_id")), parent(F.col("bin2_id"))
    return pixels.select(F.least(p1, p2).alias("bin1_id"), F.greatest(p1, p2).alias("bin2_id"), "count").groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias("count"))


def differing_bins(a: DataFrame, b: DataFrame) -> DataFrame:
    """``side, bin_id, chrom, start, end``: the bins that only one of two tables has."""
    cols = ["bin_id", "chrom", "start", "end"]
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).select(F.lit("first").alias("side"), *cols).unionByName(b.exceptAll(a).select(F.lit("second").alias("side"), *cols))


def check_same_bins(a: DataFrame, b: DataFrame) -> None:
    """Raises if two bin tables differ in chromosomes, bounds or order."""
    if not differing_bins(a, b).isEmpty():
        raise ValueError("the maps have different bins")


def remove_inward(full: DataFrame, inward: DataFrame, bins: DataFrame, resolution: int, k: int = 2, documented: bool = False) -> DataFrame:
    """Near the diagonal (cis, up to ``k`` bins apart) inward counts are taken off and the rest is scaled by 4/3, floored.

    Other pixels stay, unless ``documented``, which scales them as well. ``bins`` are of one width, ``resolution``.
    """
    return without_inward(full.join(inward.withColumnRenamed("count", "inward"), ["bin1_id", "bin2_id"], "left"), bins, k, documented)


def without_inward(pixels: DataFrame, bins: DataFrame, k: int = 2, documented: bool = False) -> DataFrame:
    """As :func:`remove_inward`, of pixels that have both counts, ``count`` and ``inward``: one shuffle, that of the counting."""
    if k < 0:
        raise ValueError("k must not be negative")
    firsts = [f for f, _ in _layout(bins)]
    same = _among(F.col("bin1_id"), firsts, firsts) == _among(F.col("bin2_id"), firsts, firsts)
    near = same & (F.col("bin2_id") - F.col("bin1_id") <= k)
    fixed = F.floor(4 * (F.col("count") - F.coalesce("inward", F.lit(0))) / 3)
    rest = F.floor(4 * F.col("count") / 3) if documented else F.col("count")
    return pixels.select("bin1_id", "bin2_id", F.when(near, fixed).otherwise(rest).cast("long").alias("count"))


def first_diagonal(pixels: DataFrame, bins: DataFrame, weight: str | None = None) -> DataFrame:
    """``chrom, i, v``: the (weighted) count of bins i and i+1; 0 for an absent pixel, NULL where a weight is missing."""
    cols = ["chrom", "i", "bin_id", *([weight] if weight else [])]
    a = bins.select(*cols)
    b = bins.select(F.col("chrom").alias("__c"), (F.col("i") - 1).alias("__i"), F.col("bin_id").alias("bin2_id"), *([F.col(weight).alias("__w2")] if weight else []))
    rows = a.join(b, (F.col("chrom") == F.col("__c")) & (F.col("i") == F.col("__i"))).withColumnRenamed("bin_id", "bin1_id")
    rows = rows.join(pixels, ["bin1_id", "bin2_id"], "left")
    v = F.coalesce("count", F.lit(0)).cast("double")
    return rows.select("chrom", "i", (v * F.col(weight) * F.col("__w2") if weight else v).alias("v"))


def medians(df: DataFrame, keys: Sequence[str], v: str, name: str) -> DataFrame:
    """``keys, name``: exact medians of ``v``, NULLs left out (a key with nothing else has no row).

    Values are counted, and their ranks are running totals over logarithmic cells of the values, so that no task holds all the values of a key.
    """
    k = list(keys)
    x = F.col(v).cast("double")
    counted = staged(df.where(F.col(v).isNotNull()).groupBy(*k, x.alias("__v")).agg(F.count("*").alias("__n")))
    size = F.abs("__v")
    cell = F.when(size == float("inf"), F.lit(400_000)).when(size > 0, F.floor(F.ln(size) * 256) + 200_000).otherwise(F.lit(0))
    ranked = running_totals(counted, k, "__v", {"__upto": "__n"}, (F.signum("__v") * cell).cast("long"))
    if k:
        ranked = ranked.join(counted.groupBy(*k).agg(F.sum("__n").alias("__all")), k)
    else:
        ranked = ranked.withColumn("__all", counted.agg(F.sum("__n")).scalar())
    holds = lambda rank: (F.col("__upto") > rank) & (F.col("__upto") - F.col("__n") <= rank)
    low, high = (holds(F.floor((F.col("__all") - 1 + up) / 2)) for up in (0, 1))
    return ranked.where(low | high).groupBy(*k).agg((F.max(F.when(low, F.col("__v"))) * 0.5 + F.max(F.when(high, F.col("__v"))) * 0.5).alias(name))


# ---------------------------------------------------------------- dense maps of regions


def cis_map(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """The dense cis map of every chromosome."""
    rows = bins.select(F.col("chrom").alias("region"), "i", F.col("bin_id").alias("bin1_id"))
    cols = bins.select(F.col("chrom").alias("region"), F.col("i").alias("j"), F.col("bin_id").alias("bin2_id"))
    n = bins.groupBy(F.col("chrom").alias("region")).agg(F.max("i").alias("last"))
    spine = rows.join(n, "region").select("region", "i", "bin1_id", F.explode(F.sequence(F.col("i"), F.col("last"))).alias("j")).join(cols, ["region", "j"])
    return spine.join(pixels, ["bin1_id", "bin2_id"], "left").select("region", "i", "j", F.coalesce("count", F.lit(0)).cast("double").alias("v"))


def mirrored(m: DataFrame) -> DataFrame:
    """Both triangles, the diagonal once."""
    cells = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return m.select("region", "v", F.inline(F.when(F.col("i") == F.col("j"), F.slice(cells, 1, 1)).otherwise(cells))).select("region", "i", "j", "v")


def balanced(m: DataFrame, weights: DataFrame, weight: str = "weight") -> DataFrame:
    """v * w_i * w_j for weights (region, i, weight); NULL where one is missing."""
    for e in ("i", "j"):
        m = m.join(weights.select("region", F.col("i").alias(e), F.col(weight).alias(f"__w{e}")), ["region", e], "left")
    return m.select("region", "i", "j", (F.col("v") * F.col("__wi") * F.col("__wj")).alias("v"))


def marginal(m: DataFrame, k: int = 1, flanks: bool = False, documented: bool = False) -> DataFrame:
    """``region, i, s``: row sums without the cells nearer than ``k`` to the diagonal; masked cells count as 0, all-masked rows give 0.

    ``flanks`` adds to non-zero sums what the mean decay would contribute beyond the region on either side. As it stands
    the right side leaves out the nearest distance; ``documented`` includes it.
    """
    s = F.coalesce(F.sum(F.when(F.abs(F.col("i") - F.col("j")) >= k, F.col("v"))), F.lit(0.0))
    rows = mirrored(m).groupBy("region", "i").agg(s.alias("s"))
    if not flanks:
        return rows
    near = m if k < 1 else m.withColumn("v", F.when(F.col("j") - F.col("i") < k, 0.0).otherwise(F.col("v")))
    decay = fill_gaps(distance_average(near), ["region"], "d", "v")
    tail = Window.partitionBy("region").orderBy(F.desc("d"))
    tails = decay.select("region", F.col("d"), F.sum("v").over(tail).alias("t"))  # of this distance and all beyond
    size = m.groupBy("region").agg((F.max("j") + 1).alias("n"))
    rows = rows.join(size, "region").withColumn("__d", F.col("n") - F.col("i") + (0 if documented else 1))
    rows = rows.join(tails.select("region", (F.col("d") - 1).alias("i"), F.col("t").alias("__left")), ["region", "i"], "left")
    rows = rows.join(tails.select("region", F.col("d").alias("__d"), F.col("t").alias("__right")), ["region", "__d"], "left")
    added = F.col("s") + F.coalesce("__left", F.lit(0.0)) + F.coalesce("__right", F.lit(0.0))
    return rows.select("region", "i", F.when(F.col("s") != 0, added).otherwise(F.col("s")).alias("s"))


def distance_average(m: DataFrame, show_self: bool = False) -> DataFrame:
    """``region, d, v``: mean of each diagonal without its masked cells; NULL if all are masked."""
    d = F.col("j") - F.col("i")
    return m.where(d >= (0 if show_self else 1)).groupBy("region", d.alias("d")).agg(F.avg("v").alias("v"))


def strict_average(m: DataFrame) -> DataFrame:
    """``region, d, v``: mean of each diagonal, the main one included; NULL if any cell is masked."""
    return m.groupBy("region", (F.col("j") - F.col("i")).alias("d")).agg(F.when(F.count("v") == F.count("*"), F.avg("v")).alias("v"))


def sparse_average(pixels: DataFrame, bins: DataFrame, high: int) -> DataFrame:
    """``chrom, d, v`` without a dense map: cis counts per distance over the number of bin pairs at it, 0 to ``high`` - 1."""
    layout = _layout(bins)
    firsts, b1, b2 = [f for f, _ in layout], F.col("bin1_id"), F.col("bin2_id")
    cis = pixels.where(_among(b1, firsts, firsts) == _among(b2, firsts, firsts))
    sums = cis.groupBy(_among(b1, firsts, [c for _, c in layout]).alias("chrom"), (b2 - b1).alias("d")).agg(F.sum("count").alias("s"))
    n = bins.groupBy("chrom").agg(F.count("*").alias("n"))
    spine = n.select("chrom", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(high)) - 1)).alias("d"))
    return spine.join(sums, ["chrom", "d"], "left").select("chrom", "d", (F.coalesce("s", F.lit(0)) / (F.col("n") - F.col("d"))).alias("v"))


def mad_mask(m: DataFrame, mad_max: float = 5) -> DataFrame:
    """Bins (region, i) whose log row sum lies more than ``mad_max`` median deviations under the median.

    An empty row's log is minus infinity: it is masked, unless half or more of the rows are empty, when nothing is.
    """
    rows = staged(marginal(m).withColumn("l", F.when(F.col("s") > 0, F.ln("s")).otherwise(F.lit(float("-inf")))))
    filled = F.count(F.when(F.col("s") > 0, 1)) * 2 > F.count("*")
    mid = medians(rows, ["region"], "l", "mid").join(rows.groupBy("region").agg(filled.alias("filled")).where("filled"), "region")
    rows = rows.join(mid, "region").withColumn("dev", F.when(F.col("s") > 0, F.abs(F.col("l") - F.col("mid"))).otherwise(F.lit(float("inf"))))
    return rows.join(medians(rows, ["region"], "dev", "mad"), "region").where(F.col("l") < F.col("mid") - mad_max * F.col("mad")).select("region", "i")


def capture_rates(probes: DataFrame, regions: DataFrame, bin_size: int, documented: bool = False) -> DataFrame:
    """``region, i, rate``: probe bases over bin size for the bins of regions (region, chrom, start, end); overlaps add up.

    A probe counts if its start or its end lies in the region, so one that spans the whole region does not; ``documented``
    counts it. Overlap lengths per bin, never bases, are added up.
    """
    r = regions.select("region", F.col("chrom").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    s, e = F.col("start"), F.col("end")
    touches = ((s >= F.col("__s")) & (s < F.col("__e"))) | ((e >= F.col("__s")) & (e < F.col("__e")))
    if documented:
        touches = (s < F.col("__e")) & (e > F.col("__s"))
    hit = probes.join(r, (F.col("chrom") == F.col("__c")) & touches & (s < e))
    low, high = F.greatest(s, F.col("__s")) - F.col("__s"), F.least(e, F.col("__e")) - F.col("__s")
    hit = hit.select("region", low.alias("low"), high.alias("high")).where("high > low")
    hit = hit.select("region", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / bin_size), F.floor((F.col("high") - 1) / bin_size))).alias("i"))
    over = F.least("high", (F.col("i") + 1) * bin_size) - F.greatest("low", F.col("i") * bin_size)
    rates = hit.groupBy("region", "i").agg((F.sum(over) / bin_size).alias("rate"))
    n = F.floor((F.col("end") - F.col("start")) / bin_size)
    spine = regions.where(n > 0).select("region", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return spine.join(rates, ["region", "i"], "left").select("region", "i", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def filter_map(m: DataFrame, rates: DataFrame | None = None, mad_max: float = 5, min_nnz: int = 10, min_pair_rate: float = 0.2) -> DataFrame:
    """The map with rows of low coverage and cells of low capture masked, in one pass: depth, capture rates, number of cells.

    Cells are masked where a bin's rates add up to less than ``min_pair_rate`` with the other's; bins where fewer than ``min_nnz``
    cells of the row are above zero, with the depth-masked columns not yet masked in the other rows.
    """
    full = mirrored(m)
    if mad_max > 0:
        full = full.join(mad_mask(m, mad_max).withColumn("__low", F.lit(True)), ["region", "i"], "left")
        full = full.withColumn("v", F.when(F.col("__low").isNull(), F.col("v"))).drop("__low")
    if min_pair_rate > 0 and rates is not None:
        for e in ("i", "j"):
            full = full.join(rates.select("region", F.col("i").alias(e), F.col("rate").alias(f"__r{e}")), ["region", e], "left")
        pair = F.coalesce("__ri", F.lit(0.0)) + F.coalesce("__rj", F.lit(0.0))
        full = full.withColumn("v", F.when(pair >= min_pair_rate, F.col("v"))).drop("__ri", "__rj")
    if min_nnz > 0:
        few = full.groupBy("region", "i").agg(F.count(F.when(F.col("v") > 0, 1)).alias("n")).where(F.col("n") < min_nnz)
        for e in ("i", "j"):
            bad = few.select("region", F.col("i").alias(e), F.lit(True).alias("__few"))
            full = full.join(bad, ["region", e], "left").withColumn("v", F.when(F.col("__few").isNull(), F.col("v"))).drop("__few")
    # A masked row masks its column only through the count of cells; the triangle keeps what is masked on either side.
    return full.groupBy("region", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(
        F.when(F.count("v") == F.count("*"), F.max("v")).alias("v")
    )


def invalid_rows(m: DataFrame) -> DataFrame:
    """Bins that balancing cannot take: a row sum of zero without being masked altogether."""
    rows = mirrored(m).groupBy("region", "i").agg(
        F.coalesce(F.sum(F.when(F.col("i") != F.col("j"), F.col("v"))), F.lit(0.0)).alias("s"), F.count("v").alias("n")
    )
    return rows.where("NOT (s > 0) AND n > 0").select("region", "i")


# ---------------------------------------------------------------- vectors


def fill_gaps(df: DataFrame, keys: Sequence[str], pos: str, v: str, anchor: str | None = None) -> DataFrame:
    """NULLs of ``v`` interpolated linearly between their neighbours by position, constant beyond the ends; other values stay.

    ``anchor`` is a column to interpolate instead of ``v`` itself. A key without any value stays NULL.
    """
    known = F.when(F.col(v).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(anchor or v).alias("v")))
    # Both are running values: a frame up to the key's end would be gone through anew for every row.
    left, right = (F.last(known, True).over(Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc(pos), F.desc(pos)))
    df = df.withColumns({"__l": left, "__r": right})
    slope = (F.col("__r.v") - F.col("__l.v")) / (F.col("__r.p") - F.col("__l.p"))
    line = F.when(F.col("__l").isNull(), F.col("__r.v")).when(F.col("__r").isNull(), F.col("__l.v")).otherwise(F.col("__l.v") + slope * (F.col(pos) - F.col("__l.p")))
    return df.withColumn(v, F.coalesce(F.col(v), F.when(F.col(v).isNull(), line))).drop("__l", "__r")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised kernel weights from -radius to radius."""
    import math

    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def gaussian(df: DataFrame, keys: Sequence[str], pos: str, v: str, sigma: float, policy: str = "mask", truncate: float = 4.0) -> DataFrame:
    """``keys, pos, v``: v smoothed over positions 0 to n-1 of each key, mirrored at both ends.

    policy ``mask`` leaves NULLs out and keeps them NULL; ``spread`` makes NULL whatever a NULL reaches;
    ``interp`` widens the kernel to 100 positions and fills the NULLs by interpolation.
    """
    if policy not in ("mask", "spread", "interp"):
        raise ValueError(f"unknown policy: {policy}")
    if policy == "interp":
        truncate = max(4.0, 100 / sigma)
    w = gaussian_weights(sigma, truncate)
    radius = len(w) // 2
    n = df.groupBy(*keys).agg((F.max(pos) + 1).alias("__n"))
    taps = F.explode(F.array(*[F.struct(F.lit(k - radius).alias("off"), F.lit(x).alias("w")) for k, x in enumerate(w)])).alias("tap")
    taken = F.pmod(F.col("__to") + F.col("tap.off"), 2 * F.col("__n"))
    source = F.when(taken < F.col("__n"), taken).otherwise(2 * F.col("__n") - 1 - taken)
    rows = df.join(n, [*keys]).select(*keys, F.col(pos).alias("__to"), F.col(v).alias("__own"), "__n", taps).select(
        *keys, "__to", "__own", source.alias("__p"), F.col("tap.w").alias("__w")
    )
    rows = rows.join(df.select(*keys, F.col(pos).alias("__p"), F.col(v).alias("__v")), [*keys, "__p"])
    total = F.sum(F.col("__w") * F.col("__v"))
    if policy == "spread":
        value = F.when(F.count("__v") == F.count("*"), total)
    else:
        value = F.when(F.max("__own").isNotNull(), total / F.sum(F.when(F.col("__v").isNotNull(), F.col("__w"))))
    out = rows.groupBy(*keys, F.col("__to").alias(pos)).agg(value.alias(v))
    return fill_gaps(out, keys, pos, v) if policy == "interp" else out


def sliding_mean(df: DataFrame, keys: Sequence[str], pos: str, v: str, window: int) -> DataFrame:
    """Mean of 2i+1 values from the left edge up to position ``window``, then of those within ``window``, cut at the right edge.

    Differences of running sums, because the frame grows with the position. ``v`` has no NULLs and positions run from 0.
    A key of fewer than 2 * window + 1 values gives NULL where the left frame passes the end.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    sums = df.select(*keys, pos, F.sum(v).over(w).alias("__c"), F.count("*").over(Window.partitionBy(*keys)).alias("__n"))
    low = F.when(F.col(pos) <= window, F.lit(0)).otherwise(F.col(pos) - window)
    high = F.when(F.col(pos) <= window, 2 * F.col(pos)).otherwise(F.least(F.col(pos) + window, F.col("__n") - 1))
    rows = sums.select(*keys, pos, low.alias("__low"), high.alias("__high"))
    at = sums.select(*keys, F.col(pos).alias("__p"), "__c")
    rows = rows.join(at.withColumnsRenamed({"__p": "__high", "__c": "__to"}), [*keys, "__high"], "left")
    rows = rows.join(at.select(*keys, (F.col("__p") + 1).alias("__low"), F.col("__c").alias("__from")), [*keys, "__low"], "left")
    return rows.select(*keys, pos, ((F.col("__to") - F.coalesce("__from", F.lit(0))) / (F.col("__high") - F.col("__low") + 1)).alias("mean"))


def neighbor_factors(diagonal: DataFrame, keys: Sequence[str], average: str = "arithmetic", eps: float = 0.0, main: DataFrame | None = None) -> DataFrame:
    """``keys, i, nf``: per bin the average of its contacts with the bins before and behind it, from the first diagonal (keys, i, v).

    Averages leave out NULLs; without any value the factor is NULL. ``eps`` clamps the diagonal to [mean * eps, mean / eps].
    ``geometric`` takes the root only if no value is missing. ``main`` (keys, i, v) adds the main diagonal, arithmetic only.
    """
    if average not in ("arithmetic", "harmonic", "geometric", "mse"):
        raise ValueError(f"unknown average: {average}")
    if main is not None and average != "arithmetic":
        raise ValueError("the main diagonal needs the arithmetic average")
    if eps > 0:
        mean = diagonal.groupBy(*keys).agg(F.avg("v").alias("__m"))
        diagonal = diagonal.join(mean, [*keys])
        v, m = F.col("v"), F.col("__m")
        diagonal = diagonal.withColumn("v", F.when(v < m * eps, m * eps).when(v > m / eps, m / eps).otherwise(v))
    # Each value belongs to two bins; no window is needed.
    sides = F.explode(F.array(F.col("i"), F.col("i") + 1)).alias("i")
    values = diagonal.select(*keys, sides, "v")
    if main is not None:
        values = values.unionByName(main.select(*keys, "i", "v"))
    v = F.col("v")
    nf = {
        "arithmetic": F.avg(v), "harmonic": 1 / F.nullif(F.avg(F.when(v != 0, 1 / v)), F.lit(0.0)),
        "mse": F.sum(v * v) / F.nullif(F.sum(v), F.lit(0.0)),
        "geometric": F.when(F.count(v) == F.count("*"), F.pow(F.product(v), 1 / F.count("*"))).otherwise(F.product(v)),
    }[average]
    if average == "harmonic":  # 1 / 0 is infinite, and so its mean: the factor is 0
        nf = F.when(F.count(F.when(v == 0, 1)) > 0, F.lit(0.0)).otherwise(nf)
    return values.groupBy(*keys, "i").agg(nf.alias("nf"))


def neighbor_weights(factors: DataFrame, bins: DataFrame, fine: int, coarse: int, eps: float = 10.0) -> DataFrame:
    """``bins`` of the coarse resolution with ``weight_neighbor`` = weight / sqrt(factor).

    A coarse bin's factor is the mean of its fine bins' factors (chrom, i, nf), or the chromosome's mean without any; all are
    clipped to the median over the genome divided and multiplied by ``eps``. A factor of 0, left only where the median
    is 0 (half of all bins or more without neighbours), makes the weight infinite.
    """
    if coarse % fine:
        raise ValueError("resolutions must be multiples of the neighbour resolution")
    k = coarse // fine
    up = factors.groupBy("chrom", F.floor(F.col("i") / k).alias("i")).agg(F.avg("nf").alias("nf"))
    whole = factors.groupBy("chrom").agg(F.avg("nf").alias("__all"))
    up = up.join(whole, "chrom").select("chrom", "i", F.coalesce("nf", "__all").alias("nf"))
    up = staged(up)
    mid = medians(up, [], "nf", "mid").scalar()
    up = up.select("chrom", "i", F.when(F.col("nf").isNotNull(), F.greatest(F.least("nf", mid * eps), mid / eps)).alias("nf"))
    weight = F.when(F.col("nf") == 0, F.col("weight") * F.lit(float("inf"))).otherwise(F.col("weight") / F.sqrt("nf"))
    return bins.join(up, ["chrom", "i"], "left").withColumn("weight_neighbor", weight).drop("nf")


def normalize_average(m: DataFrame, max_prob: float = 10.0, neighbor_prob: float = 1.0) -> DataFrame:
    """The map scaled so that its first diagonal has the mean ``neighbor_prob``, capped at ``max_prob``; NULL without a first diagonal."""
    mean = m.where("j = i + 1").groupBy("region").agg(F.avg("v").alias("__mean"))
    scaled = F.col("v") * neighbor_prob / F.nullif("__mean", F.lit(0.0))
    return m.join(mean, "region", "left").select("region", "i", "j", F.when(scaled > max_prob, max_prob).otherwise(scaled).alias("v"))


def normalize_neighbor(
    m: DataFrame, bw: float = 1, max_prob: float = 10.0, neighbor_prob: float = 1.0, eps: float = 0.1, average: str = "arithmetic",
    use_main_diag: bool = False, max_iter: int = 1,
) -> DataFrame:
    """Each cell divided by the geometric mean of its bins' (smoothed) neighbour factors, then scaled and capped."""
    for _ in range(max_iter):
        diagonal = m.where("j = i + 1").select("region", "i", "v")
        main = m.where("i = j").select("region", "i", "v") if use_main_diag else None
        nf = neighbor_factors(diagonal, ["region"], average, eps, main)
        if bw > 0:
            nf = gaussian(nf, ["region"], "i", "nf", bw, "spread")
        for e in ("i", "j"):
            m = m.join(nf.select("region", F.col("i").alias(e), F.col("nf").alias(f"__f{e}")), ["region", e], "left")
        m = m.select("region", "i", "j", (F.col("v") / F.nullif(F.sqrt(F.col("__fi") * F.col("__fj")), F.lit(0.0))).alias("v"))
    return normalize_average(m, max_prob, neighbor_prob)


def interpolate_diagonals(m: DataFrame, sigma: float | Callable[[Column], Column] = 0.0) -> DataFrame:
    """Every diagonal's masked cells filled along it, constant beyond its ends; a wholly masked diagonal gets the interpolated mean decay.

    A diagonal is a row, its cells an array in order: one shuffle of the map. ``sigma`` above 0, or a function of the separation, interpolates between smoothed
    values (Gaussian, of the known cells among themselves, mirrored at the ends); they are computed only beside the gaps, where they are used.
    """
    d = (F.col("j") - F.col("i")).alias("d")
    lines = m.groupBy("region", d).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("__c"), F.avg("v").alias("__decay"))
    decay = fill_gaps(lines.select("region", "d", "__decay"), ["region"], "d", "__decay")
    lines = lines.select("region", "d", F.transform("__c", lambda c: c["v"]).alias("x"))  # an array of its own, not one made anew at every use
    n, width = F.size("x"), sigma(F.col("d")).cast("double") if callable(sigma) else F.lit(float(sigma))
    radius = F.floor(4 * width + 0.5).cast("int")

    def gap(k: Column) -> Column:
        return (k >= 0) & (k < n) & F.get("x", k).isNull()

    def smoothed(i: Column) -> Column:
        def tap(acc: Column, k: Column) -> Column:
            p = F.pmod(i + k, 2 * n)
            v = F.get("x", F.when(p < n, p).otherwise(2 * n - 1 - p))
            w = F.when(v.isNotNull(), F.when(k == 0, F.lit(1.0)).otherwise(F.exp(-0.5 * F.pow(k / width, 2)))).otherwise(F.lit(0.0))
            return F.struct((acc["s"] + w * F.coalesce(v, F.lit(0.0))).alias("s"), (acc["w"] + w).alias("w"))

        return F.aggregate(F.sequence(-radius, radius), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), tap, lambda acc: acc["s"] / acc["w"])

    if callable(sigma) or sigma > 0:
        def anchor(i):
            return smoothed(i)
    else:
        def anchor(i):
            return F.get("x", i)
    beside = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ~gap(k) & (gap(k - 1) | gap(k + 1)))
    lines = lines.withColumn("a", F.transform(beside, lambda k: F.struct(k.alias("p"), anchor(k).alias("v"))))

    def between(k: Column) -> Column:
        left, right = F.try_element_at(F.filter("a", lambda q: q["p"] < k), F.lit(-1)), F.get(F.filter("a", lambda q: q["p"] > k), F.lit(0))

        def line(t: Column) -> Column:
            low, high = t["l"], t["r"]
            slope = (high["v"] - low["v"]) / (high["p"] - low["p"])
            return F.when(low.isNull(), high["v"]).when(high.isNull(), low["v"]).otherwise(low["v"] + slope * (k - low["p"]))

        return F.get(F.transform(F.array(F.struct(left.alias("l"), right.alias("r"))), line), F.lit(0))

    filled = F.transform("x", lambda v, k: F.when(v.isNotNull(), v).otherwise(between(k)))
    cells = lines.select("region", "d", filled.alias("x")).join(decay, ["region", "d"]).select("region", "d", "__decay", F.posexplode_outer("x").alias("i", "v"))  # the inner one would repeat the array in a filter
    i = F.col("i").cast("long")
    return cells.select("region", i.alias("i"), (i + F.col("d")).alias("j"), F.coalesce("v", "__decay").alias("v"))


# ---------------------------------------------------------------- balancing and comparing


def _weighted_sums(pixels: DataFrame, biases: DataFrame, ignore_diags: int) -> DataFrame:
    """``bin_id, s``: row sums of the sparse map divided by its bins' biases, the diagonal once; pixels of bins without bias are left out."""
    p = pixels.where(F.col("bin2_id") - F.col("bin1_id") >= ignore_diags)
    for e in (1, 2):
        p = p.join(biases.select(F.col("bin_id").alias(f"bin{e}_id"), F.col("bias").alias(f"__b{e}")), f"bin{e}_id")
    v = F.col("count") / (F.col("__b1") * F.col("__b2"))
    return p.select(F.explode(_ends()).alias("bin_id"), v.alias("v")).groupBy("bin_id").agg(F.sum("v").alias("s"))


def _ends() -> Column:
    return F.when(F.col("bin1_id") == F.col("bin2_id"), F.array("bin1_id")).otherwise(F.array("bin1_id", "bin2_id"))


def ice_step(pixels: DataFrame, biases: DataFrame, ignore_diags: int = 1) -> DataFrame:
    """One round of balancing of sparse pixels: ``bin_id, bias`` divided by the row sums relative to their mean."""
    s = _weighted_sums(pixels, biases, ignore_diags)
    mean = s.where("s <> 0").agg(F.avg("s")).scalar()
    return biases.join(s, "bin_id", "left").select("bin_id", (F.col("bias") * F.when(F.col("s") != 0, F.col("s") / mean).otherwise(F.lit(1.0))).alias("bias"))


def ice_statistics(pixels: DataFrame, biases: DataFrame, ignore_diags: int = 1) -> DataFrame:
    """``mean, variance`` of the row sums that a round of balancing finds, empty rows left out."""
    return _weighted_sums(pixels, biases, ignore_diags).where("s <> 0").agg(F.avg("s").alias("mean"), F.var_pop("s").alias("variance"))


def balanced_bins(pixels: DataFrame, bins: DataFrame, ignore_diags: int = 1, mad_max: float = 5, min_nnz: int = 10, min_count: float = 0) -> DataFrame:
    """``bin_id`` of the bins that genome-wide balancing takes: at least ``min_nnz`` pixels above zero and ``min_count`` contacts, and a row
    sum, relative to its chromosome's median, whose log is not more than ``mad_max`` median deviations under the median. Empty rows are out."""
    p = pixels.where((F.col("bin2_id") - F.col("bin1_id") >= ignore_diags) & (F.col("count") != 0))
    rows = p.select(F.explode(_ends()).alias("bin_id"), "count").groupBy("bin_id").agg(F.count("*").alias("n"), F.sum("count").alias("s")).where("s > 0")
    rows = rows.join(bins.select("bin_id", "chrom"), "bin_id")
    good = (F.col("n") >= min_nnz) & (F.col("s") >= min_count)
    if mad_max > 0:
        rows = staged(rows)
        rows = staged(rows.join(medians(rows, ["chrom"], "s", "__m"), "chrom").withColumn("l", F.ln(F.col("s") / F.col("__m"))))
        rows = staged(rows.withColumn("dev", F.col("l") - medians(rows, [], "l", "mid").scalar()))
        good = good & (F.col("dev") >= -mad_max * medians(rows.select(F.abs("dev").alias("a")), [], "a", "mad").scalar())
    return rows.where(good).select("bin_id")


@dataclass(frozen=True)
class Balance:
    """``weights``: the bins with their ``weight``; the rounds made, the row sums' variance in the last one, and whether it fell under the tolerance."""

    weights: DataFrame
    rounds: int
    variance: float | None
    converged: bool


def balance_pixels(
    pixels: DataFrame, bins: DataFrame, ignore_diags: int = 1, mad_max: float = 5, min_nnz: int = 10, min_count: float = 0, tol: float = 1e-5, max_iter: int = 200
) -> Balance:
    """Genome-wide balancing of sparse pixels: the bins with ``weight``, so that count * weight1 * weight2 has row sums of mean 1.

    Bins are filtered once (:func:`balanced_bins`); then rounds as in :func:`ice_step`, each one's biases and row sums staged, until the
    variance of the row sums (those of counts divided by biases, not of the final map) is under ``tol``. ``max_iter`` rounds without that
    give a warning and ``converged`` = False, with the last round's weights. A bin that is filtered, or has no contact with a bin that is
    not, has weight NULL.
    """
    kept = staged(balanced_bins(pixels, bins, ignore_diags, mad_max, min_nnz, min_count))
    p = pixels.where(F.col("bin2_id") - F.col("bin1_id") >= ignore_diags)
    for e in (1, 2):
        p = p.join(kept.select(F.col("bin_id").alias(f"bin{e}_id")), f"bin{e}_id", "left_semi")
    p = staged(p.select("bin1_id", "bin2_id", "count"))
    biases, before = kept.select("bin_id", F.lit(1.0).alias("bias")), None
    rounds, variance, mean, converged = 0, None, None, False
    while rounds < max_iter and not converged:
        rows = staged(biases.join(_weighted_sums(p, biases, ignore_diags), "bin_id", "left").select("bin_id", "bias", "s"))
        if before is not None:
            unstage(before)  # nothing reads the round before any more
        rounds, before = rounds + 1, rows
        mean, variance = rows.where("s <> 0").agg(F.avg("s"), F.var_pop("s")).first()
        if mean is None:
            break
        biases = rows.select("bin_id", F.when(F.col("s") != 0, F.col("bias") * F.col("s") / mean).alias("bias")).where("bias IS NOT NULL")
        converged = variance < tol
    if not converged:
        warnings.warn(f"balancing did not converge: variance {variance} after {rounds} rounds", stacklevel=2)
    scale = None if mean is None else mean**0.5
    weights = biases.select("bin_id", (1 / (F.col("bias") * F.lit(scale).cast("double"))).alias("weight"))
    unweighted = bins.drop("weight")
    return Balance(unweighted.join(weights, "bin_id", "left").select(*unweighted.columns, "weight"), rounds, variance, converged)


def coarsen_map(m: DataFrame, factor: int) -> DataFrame:
    """Blocks of ``factor`` bins summed without masked cells; a remainder at the end is dropped."""
    size = m.groupBy("region").agg(F.floor((F.max("j") + 1) / factor).alias("__n"))
    full = mirrored(m).select("region", F.floor(F.col("i") / factor).alias("i"), F.floor(F.col("j") / factor).alias("j"), "v").where("i <= j")
    summed = full.groupBy("region", "i", "j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
    return summed.join(size, "region").where((F.col("i") < F.col("__n")) & (F.col("j") < F.col("__n"))).select("region", "i", "j", "v")


def coarsen_by_distance(m: DataFrame, agg: Callable[[Column], Column] = F.avg, base: int = 10, offset: int = 0) -> DataFrame:
    """Cells base^k from the diagonal take the aggregate of their 2^k-sized block of the original map; the largest k holds.

    Blocks begin at base^k + offset from the diagonal in steps of their size, row block by row block.
    """
    import math

    if base % 2:
        raise ValueError("base must be even")
    n_max = m.agg(F.max("j")).first()[0]
    if n_max is None:
        return m
    full, out = mirrored(m), m.withColumn("__best", F.struct(F.lit(0).alias("k"), F.col("v").alias("v")))
    size = m.groupBy("region").agg((F.max("j") + 1).alias("__n"))
    for k in range(1, math.ceil(math.log(n_max + 1) / math.log(base))):
        f, start, end = 2**k, offset + base**k, offset + base ** (k + 1)
        a = F.floor(F.col("i") / f) * f
        b = F.floor((F.col("j") - a - start) / f)
        rows = full.join(size, "region").withColumns({"a": a, "b": b})
        first = F.col("a") + start + F.col("b") * f
        last_k = F.ceil(F.log(F.col("__n").cast("double")) / math.log(base)) - 1  # the largest k of the region
        # A block is there if it begins before the band's and the map's end.
        inside = (F.col("b") >= 0) & (F.col("a") + start < F.col("__n")) & (first < F.least(F.col("a") + end, F.col("__n"))) & (F.lit(k) <= last_k)
        blocks = rows.where(inside).groupBy("region", "a", "b").agg(agg(F.col("v")).alias("__v"))
        cells = rows.where(inside & (F.col("i") <= F.col("j"))).select("region", "i", "j", "a", "b").join(blocks, ["region", "a", "b"])
        out = out.join(cells.select("region", "i", "j", F.struct(F.lit(k).alias("k"), F.col("__v").alias("v")).alias("__new")), ["region", "i", "j"], "left")
        out = out.withColumn("__best", F.coalesce("__new", "__best")).drop("__new")
    return out.select("region", "i", "j", F.col("__best.v").alias("v"))


def batch_factors(query: DataFrame, reference: DataFrame, separation: int = 5) -> DataFrame:
    """``region, d, factor, global_factor`` that bring the near decay of ``query`` maps to that of ``reference`` maps.

    One set per region and one, ``merged``, from the regions' mean decay. Means over masked cells are NULL and stay so.
    """

    def decay(m: DataFrame) -> DataFrame:
        ps = strict_average(m).where(F.col("d") <= separation)
        merged = ps.groupBy("d").agg(F.when(F.count("v") == F.count("*"), F.avg("v")).alias("v")).select(F.lit("merged").alias("region"), "d", "v")
        return ps.unionByName(merged)

    both = decay(query).withColumnRenamed("v", "q").join(decay(reference).withColumnRenamed("v", "r"), ["region", "d"])
    g = both.where(F.col("d") == separation).select("region", (F.col("r") / F.nullif("q", F.lit(0.0))).alias("global_factor"))
    return both.where(F.col("d") < separation).join(g, "region").select(
        "region", "d", (F.col("r") / F.nullif(F.col("q") * F.col("global_factor"), F.lit(0.0))).alias("factor"), "global_factor"
    )


def factor_report(factors: DataFrame) -> DataFrame:
    """``region, global_factor, factors`` as text with three decimals (nan where missing), the factors in order of their separation."""
    text = lambda c: F.when(c.isNull(), "nan").otherwise(F.format_string("%.3f", c))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("d", "factor"))), lambda x: text(x["factor"]))
    return factors.groupBy("region").agg(text(F.max("global_factor")).alias("global_factor"), F.array_join(listed, ",").alias("factors"))


def apply_batch_factors(m: DataFrame, factors: DataFrame) -> DataFrame:
    """The map times its region's global factor, and near the diagonal times the factor of the separation."""
    g = factors.groupBy("region").agg(F.max("global_factor").alias("__g"))
    near = factors.select("region", F.col("d").alias("__d"), F.col("factor").alias("__f"))
    rows = m.join(g, "region", "left").withColumn("__d", F.col("j") - F.col("i")).join(near, ["region", "__d"], "left")
    return rows.select("region", "i", "j", (F.col("v") * F.col("__g") * F.coalesce("__f", F.lit(1.0))).alias("v"))


def merged_map(upper: DataFrame, lower: DataFrame, main_diagonal: bool = True, lower_diagonal: bool = False) -> DataFrame:
    """A full (not triangular) map: ``upper``'s cells above the diagonal, ``lower``'s below it; the diagonal is upper's, zeros, or lower's."""
    top = upper if main_diagonal else upper.where("i < j")
    diag = upper.where("i = j").withColumn("v", F.lit(0.0)) if not main_diagonal else upper.limit(0)
    below = lower.where("i <= j" if lower_diagonal else "i < j").select("region", F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return top.unionByName(diag).unionByName(below)


def log_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """log2(a / b) per cell: NULL where either is masked or both are zero, infinite where one is zero."""
    rows = a.join(b.withColumnRenamed("v", "__b"), ["region", "i", "j"])
    x, y, inf = F.col("v"), F.col("__b"), F.lit(float("inf"))
    ratio = F.when((x == 0) & (y == 0), None).when(y == 0, inf).when(x == 0, -inf).otherwise(F.log2(x / F.nullif(y, F.lit(0.0))))
    return rows.select("region", "i", "j", F.when(x.isNotNull() & y.isNotNull(), ratio).alias("v"))


def smoothed_map(m: DataFrame, sigma: float) -> DataFrame:
    """Two-dimensional Gaussian smoothing of one width, first along rows, then along columns; a masked cell masks all it reaches."""
    across = gaussian(mirrored(m), ["region", "i"], "j", "v", sigma, "spread")
    return gaussian(across, ["region", "j"], "i", "v", sigma, "spread").where("i <= j").select("region", "i", "j", "v")


def compared(a: DataFrame, b: DataFrame, bw: float = 0) -> DataFrame:
    """:func:`log_ratio`; with ``bw`` a full map, in which the cells on and below the diagonal are those of the smoothed maps."""
    if bw <= 0:
        return log_ratio(a, b)
    return merged_map(log_ratio(a, b).where("i < j"), log_ratio(*(smoothed_map(x, bw) for x in (a, b))), True, True)


def select_region(m: DataFrame, first: int, last: int) -> DataFrame:
    """The square of bins [first, last) with bins renumbered from 0."""
    inside = m.where((F.col("i") >= first) & (F.col("j") < last))
    return inside.select("region", (F.col("i") - first).alias("i"), (F.col("j") - first).alias("j"), "v")


def rotated(m: DataFrame, start: int = 0, resolution: int = 1) -> DataFrame:
    """Cells with the centre of their rotated corners: ``x`` along the genome, ``y`` the separation."""
    x = start + resolution * (F.col("i") + F.col("j") + 1) / 2
    return m.select("region", "i", "j", x.alias("x"), (resolution * (F.col("j") - F.col("i"))).alias("y"), "v")


def bin_centers(bins: DataFrame, resolution: int) -> DataFrame:
    return bins.withColumn("x", F.col("start") + F.lit(resolution) / 2)


def mask_low_alpha(m: DataFrame, weights: DataFrame, min_alpha: float) -> DataFrame:
    """Cells masked where 1 / weight of either bin is under ``min_alpha``."""
    bad = weights.where(1 / F.nullif("weight", F.lit(0.0)) < min_alpha)
    for e in ("i", "j"):
        m = m.join(bad.select("region", F.col("i").alias(e), F.lit(True).alias("__bad")), ["region", e], "left")
        m = m.withColumn("v", F.when(F.col("__bad").isNull(), F.col("v"))).drop("__bad")
    return m
