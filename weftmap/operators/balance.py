"""Balancing, smoothing and peaks of regions' dense maps, as relations over (region, i, j, v); see :mod:`.maps` for the shapes.

A round of balancing is one job over the cells, whatever the number and size of regions; what is kept from round to round is a bias per bin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import staged, unstage
from ..functions.pairs import smoothing_width
from .maps import gaussian, interpolate_diagonals, invalid_rows, marginal

Width = float | Callable[[Column], Column]


def growing_width(scale: float = 2.0, exponent: float = 0.2, plateau: int = 2) -> Callable[[Column], Column]:
    """The kernel width as a function of the separation."""
    return lambda k: smoothing_width(k, scale, exponent, plateau)


def _divided(cells: DataFrame, biases: DataFrame) -> DataFrame:
    for e in ("i", "j"):
        cells = cells.join(biases.select("region", F.col("i").alias(e), F.col("bias").alias(f"__b{e}")), ["region", e])
    return cells.select("region", "i", "j", (F.col("v") / (F.col("__bi") * F.col("__bj"))).alias("v"))


def mask_invalid(m: DataFrame, rounds: int = 1000) -> DataFrame:
    """The map with the bins masked that balancing cannot take (:func:`weftmap.operators.maps.invalid_rows`), until none is left."""
    m = staged(m)
    for _ in range(rounds):
        bad = staged(invalid_rows(m))
        if bad.isEmpty():
            return m
        for e in ("i", "j"):
            m = m.join(bad.select("region", F.col("i").alias(e), F.lit(True).alias(f"__bad_{e}")), ["region", e], "left")
        m = staged(m.select("region", "i", "j", F.when(F.col("__bad_i").isNull() & F.col("__bad_j").isNull(), F.col("v")).alias("v")))
    raise RuntimeError(f"there were empty rows left after {rounds} rounds of masking")


def balance_map(m: DataFrame, max_iter: int = 50, tol: float = 1e-5, interpolate: bool = False, sigma: Width = 2.0, flanks: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every region balanced by itself: its cells, and ``region, i, bias, done``, so that cells times both bins' biases are the map.

    Each round divides the biases' map by its row sums relative to their mean; a region is done when the variance of all its row sums, those of masked
    rows included, falls under ``tol``, and is left alone from then on. Masked cells stay masked (in the first round they count as
    zeros in the mean decay of ``flanks``), or with ``interpolate`` are filled along their diagonals in every round.
    """
    m = staged(m)

    def view(biases: DataFrame, first: bool = False) -> DataFrame:
        w = _divided(m, biases)
        if interpolate:
            return interpolate_diagonals(w, sigma)
        return w.withColumn("v", F.coalesce("v", F.lit(0.0))) if first else w

    biases = staged(m.groupBy("region", "i").agg(F.lit(1.0).alias("bias"), F.lit(False).alias("done")))
    for k in range(max_iter):
        active = biases.where(~F.col("done"))
        seen = view(active, k == 0)
        if interpolate and flanks:  # read once for the sums and once for the decay
            seen = staged(seen)
        rows = marginal(seen, 1, flanks)
        over = Window.partitionBy("region")
        mean, var = F.avg(F.when(F.col("s") != 0, F.col("s"))).over(over), F.var_pop("s").over(over)
        step = F.when(F.col("s") != 0, F.col("s") / F.col("mean")).otherwise(F.lit(1.0))
        rows = rows.withColumns({"mean": mean, "var": var}).select("region", "i", step.alias("step"), (F.col("var") < tol).alias("now"))
        moved = active.drop("done").join(rows, ["region", "i"]).select("region", "i", (F.col("bias") * F.col("step")).alias("bias"), F.col("now").alias("done"))
        before, biases = biases, staged(moved.unionByName(biases.where("done")))
        unstage(before)
        if interpolate and flanks:
            unstage(seen)
        if biases.where(~F.col("done")).isEmpty():
            break
    return view(biases), biases


def balance_regions(m: DataFrame, max_iter: int = 50, tol: float = 1e-5, flanks: bool = True, sigma: Width = growing_width(), strict: bool = False) -> DataFrame:
    """Filtered maps balanced as they are, then with interpolation, then once more when complete: ``region, i, j, v, state``.

    Bins that cannot be balanced (empty without being masked) are masked first, or are an error if ``strict``. Every region comes out; ``state`` tells how: ``balanced``,
    ``not converged`` (within ``max_iter`` rounds of the last stage), or ``empty`` (no cell is left; all are NULL).
    """
    if strict and not invalid_rows(m).isEmpty():
        raise ValueError("the map cannot be balanced: a row is empty without being masked")
    m = mask_invalid(m)
    cells, _ = balance_map(m, max_iter, tol, flanks=flanks)
    cells, _ = balance_map(cells, max_iter, tol, True, sigma, flanks)
    cells, biases = balance_map(cells, max_iter, tol, flanks=flanks)
    state = biases.groupBy("region").agg(F.when(F.every("done"), "balanced").otherwise("not converged").alias("__state"))
    some = m.groupBy("region").agg((F.count("v") > 0).alias("__some"))
    state = state.join(some, "region").select("region", F.when(F.col("__some"), F.col("__state")).otherwise("empty").alias("state"))
    return cells.join(state, "region").select("region", "i", "j", "v", "state")


def smooth_by_distance(m: DataFrame, sigma: Width = growing_width(0.05, 0.5, 2), interpolate: bool = False, truncate: float = 4.0) -> DataFrame:
    """Two-dimensional Gaussian smoothing with the width of each cell's separation, of known cells among themselves; masked cells stay masked.

    Every cell meets the cells under its kernel in a join on (region, i, j), mirrored at the map's borders and at its diagonal; sums are combined before
    they are shuffled. The work is the number of cells times that of the kernel's, as nothing is shared between widths. ``interpolate`` widens the kernel to 100 bins and
    gives masked cells the mean of the known ones it reaches.
    """
    width = sigma(F.col("j") - F.col("i")) if callable(sigma) else F.lit(float(sigma))
    if interpolate:
        reach = F.greatest(F.lit(truncate) * F.col("__s"), F.lit(100.0))
    else:
        reach = F.lit(truncate) * F.col("__s")
    n = m.groupBy("region").agg((F.max("j") + 1).alias("__n"))
    rows = (m if interpolate else m.where("v IS NOT NULL")).join(n, "region").withColumn("__s", width.cast("double"))
    rows = rows.withColumn("__r", F.floor(reach + 0.5).cast("int"))
    rows = rows.select("region", "i", "j", "__n", "__s", "__r", F.explode(F.sequence(-F.col("__r"), F.col("__r"))).alias("__a"))
    rows = rows.select("*", F.explode(F.sequence(-F.col("__r"), F.col("__r"))).alias("__c"))

    def mirrored_at(p: Column) -> Column:
        p = F.pmod(p, 2 * F.col("__n"))
        return F.when(p < F.col("__n"), p).otherwise(2 * F.col("__n") - 1 - p)

    def weight(k: str) -> Column:
        return F.when(F.col(k) == 0, F.lit(1.0)).otherwise(F.exp(-0.5 * F.pow(F.col(k) / F.col("__s"), 2)))

    p, q = mirrored_at(F.col("i") + F.col("__a")), mirrored_at(F.col("j") + F.col("__c"))
    taps = rows.select("region", "i", "j", F.least(p, q).alias("__p"), F.greatest(p, q).alias("__q"), (weight("__a") * weight("__c")).alias("__w"))
    known = m.where("v IS NOT NULL").select("region", F.col("i").alias("__p"), F.col("j").alias("__q"), "v")
    sums = taps.join(known, ["region", "__p", "__q"]).groupBy("region", "i", "j").agg((F.sum(F.col("__w") * F.col("v")) / F.sum("__w")).alias("v"))
    return m.select("region", "i", "j").join(sums, ["region", "i", "j"], "left")


def local_peaks(values: DataFrame, keys: Sequence[str], pos: str, v: str, prominence: float) -> DataFrame:
    """``keys, pos, prominence``: local maxima (the middle of a flat top) that rise ``prominence`` or more above the higher of their two feet.

    A foot is the least value between the peak and the nearest higher one on that side, or the end. Equal neighbours are one run. Greatest and least values of 2^k
    runs on end are columns made by windows, each from the one before; every peak then finds its feet by jumping over blocks without a higher value, the
    longest first, in one equality join on (key, run) a size. ``v`` has no NULLs.
    """
    k = list(keys)
    over = Window.partitionBy(*k).orderBy(pos)
    starts = F.coalesce((F.lag(v).over(over) != F.col(v)).cast("int"), F.lit(1))
    runs = values.select(*k, pos, v, starts.alias("__new")).withColumn("__run", F.sum("__new").over(over))
    runs = runs.groupBy(*k, "__run").agg(F.first(v).alias("x"), F.min(pos).alias("a"), F.max(pos).alias("b"))
    by_run = Window.partitionBy(*k).orderBy("__run")
    runs = runs.withColumns({"__left": F.lag("x").over(by_run), "__right": F.lead("x").over(by_run)})
    runs = staged(runs.withColumn("top", F.coalesce((F.col("__left") < F.col("x")) & (F.col("__right") < F.col("x")), F.lit(False))))
    longest = runs.agg(F.max("__run")).first()[0] or 0
    levels = max(0, (longest - 1).bit_length())

    found = runs.where("top").select(*k, "__run", "x", "a", "b")
    for side, step in (("l", F.lag), ("r", F.lead)):
        blocks = runs.select(*k, "__run", F.col("x").alias("__hi0"), F.col("x").alias("__lo0"))
        for n in range(levels):
            hi, lo = step(f"__hi{n}", 1 << n).over(by_run), step(f"__lo{n}", 1 << n).over(by_run)
            blocks = blocks.withColumns({f"__hi{n + 1}": F.greatest(f"__hi{n}", hi), f"__lo{n + 1}": F.least(f"__lo{n}", lo)})
        blocks = staged(blocks)
        sign = -1 if side == "l" else 1
        found = found.withColumns({"__at": F.col("__run") + sign, f"__foot_{side}": F.col("x")})
        for n in reversed(range(levels + 1)):
            block = blocks.select(*k, F.col("__run").alias("__at"), F.col(f"__hi{n}").alias("__hi"), F.col(f"__lo{n}").alias("__lo"))
            found = found.join(block, [*k, "__at"], "left")
            clear = F.col("__hi") <= F.col("x")  # no higher value in the block; NULL behind the end
            found = found.withColumns({
                f"__foot_{side}": F.when(clear, F.least(f"__foot_{side}", "__lo")).otherwise(F.col(f"__foot_{side}")),
                "__at": F.when(clear, F.col("__at") + sign * (1 << n)).otherwise(F.col("__at")),
            }).drop("__hi", "__lo")
        found = found.drop("__at")
    rise = F.col("x") - F.greatest("__foot_l", "__foot_r")
    return found.select(*k, F.floor((F.col("a") + F.col("b")) / 2).alias(pos), rise.alias("prominence")).where(F.col("prominence") >= prominence)


def call_peaks(values: DataFrame, sigma: float = 5, prominence: float = 0.4) -> DataFrame:
    """``region, i, prominence``: peaks of the smoothed vector (region, i, s), which has no gaps."""
    return local_peaks(gaussian(values.select("region", "i", "s"), ["region"], "i", "s", sigma), ["region"], "i", "s", prominence)
