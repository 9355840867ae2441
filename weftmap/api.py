"""A contact map with its place on the genome, and the commands' Python side."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .operators import balance as B
from .operators import maps as M
from .sources import text as S


@dataclass(frozen=True)
class ContactMap:
    """The dense map of one region (see :mod:`weftmap.operators.maps`): lazy, every method gives a new map or table."""

    cells: DataFrame
    chrom: str
    start: int
    end: int
    resolution: int

    @classmethod
    def from_store(cls, spark: SparkSession, path: str, resolution: int, region: str, balance: bool | str = True, min_alpha: float = -1) -> ContactMap:
        """The region of a store written by :func:`save_store`; ``balance`` is off, on, or the name of a weight column.

        Bins that the region touches are taken whole. A resolution that the store does not have is an error.
        """
        if resolution not in S.resolutions(spark, f"{path}/bins"):
            raise ValueError(f"the store has no resolution {resolution}")
        chrom, start, end = S.parse_region(region)
        bins = S.read_store(spark, f"{path}/bins", resolution).where((F.col("chrom") == chrom) & (F.col("end") > start) & (F.col("start") < end))
        first = start // resolution
        bins = bins.withColumn("i", F.col("i") - first)
        low, high = bins.agg(F.min("bin_id"), F.max("bin_id")).first()
        pixels = S.read_store(spark, f"{path}/pixels", resolution)
        if low is not None:  # bounds that reach the scan
            pixels = pixels.where(F.col("bin1_id").between(low, high) & F.col("bin2_id").between(low, high))
        cells = M.cis_map(pixels, bins)
        weight = "weight" if balance is True else balance
        weights = bins.withColumn("region", F.lit(chrom))
        if weight:
            cells = M.balanced(cells, weights, weight)
        if min_alpha > 0:
            cells = M.mask_low_alpha(cells, weights, min_alpha)
        return cls(cells, chrom, start, end, resolution)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ContactMap:
        cells, meta = S.read_map(spark, path)
        chrom, start, end = S.parse_region(meta["region"])
        return cls(cells, chrom, start, end, meta["resolution"])

    def save(self, path: str, single: bool = True, **metadata) -> None:
        S.write_map(self.cells, path, {"region": f"{self.chrom}:{self.start}-{self.end}", "resolution": self.resolution, **metadata}, single)

    def comparable(self, other: ContactMap) -> bool:
        return (self.chrom, self.start, self.end) == (other.chrom, other.start, other.end)

    def coarsen(self, factor: int = 5) -> ContactMap:
        n = -(-(self.end - self.start) // self.resolution) // factor
        res = self.resolution * factor
        return replace(self, cells=M.coarsen_map(self.cells, factor), end=self.start + n * res, resolution=res)

    def select_region(self, start: int, end: int) -> ContactMap:
        if (start - self.start) % self.resolution or (end - self.end) % self.resolution or start < self.start or end > self.end:
            raise ValueError("the bounds must lie in the map, on its bins")
        a, b = (start - self.start) // self.resolution, -(-(end - self.start) // self.resolution)
        return replace(self, cells=M.select_region(self.cells, a, b), start=start, end=end)

    def merged(self, lower: ContactMap, main_diagonal: bool = True) -> DataFrame:
        self._check(lower)
        return M.merged_map(self.cells, lower.cells, main_diagonal)

    def compare(self, other: ContactMap, bw: float = 0) -> DataFrame:
        """log2(self / other) per cell; with ``bw`` a full map, the smoothed maps' ratio on and below the diagonal."""
        self._check(other)
        return M.compared(self.cells, other.cells, bw)

    def marginal(self, k: int = 1, flanks: bool = False) -> DataFrame:
        """Row sums with the coordinate of each bin's centre."""
        x = F.lit(self.start) + (F.col("i") + 0.5) * self.resolution
        return M.marginal(self.cells, k, flanks).withColumn("x", x)

    def distance_average(self, show_self: bool = False) -> DataFrame:
        return M.distance_average(self.cells, show_self)

    def balance(self, rates: DataFrame | None = None, mad_max: float = 2, min_nnz: int = 100, min_pair_rate: float = 0.2, **how) -> ContactMap:
        """Filtered and balanced with interpolation; the defaults are those of the ``region-balance`` command. A map that cannot be balanced gives a warning."""
        done = staged(B.balance_regions(M.filter_map(self.cells, rates, mad_max, min_nnz, min_pair_rate), **how))
        state = done.select("state").first()
        if state is not None and state[0] != "balanced":
            warnings.warn(f"the map is {state[0]}", stacklevel=2)
        return replace(self, cells=done.drop("state"))

    def neighbor_normalized(self, **how) -> ContactMap:
        return replace(self, cells=M.normalize_neighbor(self.cells, **how))

    def peaks(self, sigma: float = 5, prominence: float = 0.4) -> DataFrame:
        """Dips of the contact density."""
        s = self.marginal().withColumn("s", -F.log2(F.nullif("s", F.lit(0.0))))
        return B.call_peaks(s, sigma, prominence)

    def rotated(self) -> DataFrame:
        return M.rotated(self.cells, self.start, self.resolution)

    def _check(self, other: ContactMap) -> None:
        if not self.comparable(other):
            raise ValueError("the maps must have the same chromosome, start and end")


def save_store(bins: DataFrame, pixels: DataFrame, path: str, resolution: int) -> None:
    """Bins (with their weights) and pixels of one resolution; pixels sorted within files, so that a region reads a part."""
    S.write_store(bins, f"{path}/bins", resolution)
    S.write_store(pixels.repartitionByRange("bin1_id").sortWithinPartitions("bin1_id", "bin2_id"), f"{path}/pixels", resolution)


def balance_store(spark: SparkSession, path: str, resolution: int, **how) -> M.Balance:
    """Writes ``weight`` into the bins of one resolution of a store; a neighbour weight that was made from another one is dropped."""
    bins = staged(S.read_store(spark, f"{path}/bins", resolution).drop("weight", "weight_neighbor"))
    done = M.balance_pixels(S.read_store(spark, f"{path}/pixels", resolution), bins, **how)
    S.write_store(staged(done.weights), f"{path}/bins", resolution)
    return done


def zoom_store(spark: SparkSession, path: str, base: int, resolutions: Sequence[int], balance: bool = True, ignore_diags: int = 0, **how) -> dict[int, M.Balance | None]:
    """Adds the coarser ``resolutions`` to a store, each from the next finer one that divides it, and balances all, the base as well."""
    there = S.resolutions(spark, f"{path}/bins")
    if base not in there:
        raise ValueError(f"resolution {base} not found; there are {there}")
    if any(r % base or r <= base for r in resolutions):
        raise ValueError(f"all resolutions must be multiples of {base}")
    sizes = staged(S.read_store(spark, f"{path}/bins", base).groupBy("chrom").agg(F.max("end").alias("size")))
    made = [base]
    for r in sorted(set(resolutions)):
        fine = max(m for m in made if r % m == 0)
        coarse = M.make_bins(sizes, r)
        save_store(coarse, M.zoom_pixels(S.read_store(spark, f"{path}/pixels", fine), S.read_store(spark, f"{path}/bins", fine), coarse, r // fine), path, r)
        made.append(r)
    return {r: balance_store(spark, path, r, ignore_diags=ignore_diags, **how) if balance else None for r in made}


def add_neighbor_weights(spark: SparkSession, path: str, fine: int = 200, eps: float = 10.0) -> list[int]:
    """Adds ``weight_neighbor`` to the bins of every resolution of a store; the resolutions changed."""
    there = S.resolutions(spark, f"{path}/bins")
    if fine not in there:
        raise ValueError(f"resolution {fine} not found; there are {there}")
    if any(r % fine for r in there):
        raise ValueError(f"all resolutions must be multiples of {fine}; there are {there}")
    bins = S.read_store(spark, f"{path}/bins", fine).drop("weight_neighbor")
    diagonal = M.first_diagonal(S.read_store(spark, f"{path}/pixels", fine), bins, "weight")
    factors = staged(M.neighbor_factors(diagonal, ["chrom"]))
    for r in there:
        old = staged(S.read_store(spark, f"{path}/bins", r).drop("weight_neighbor"))
        S.write_store(staged(M.neighbor_weights(factors, old, fine, r, eps)), f"{path}/bins", r)
    return there


def load_maps(
    spark: SparkSession, root: str, conditions: Sequence[str], regions: Sequence[str], pattern: str = "{root}/{condition}/{condition}_output_{region}", **how
) -> DataFrame:
    """Saved maps of all conditions and regions, each normalised by its neighbour factors: ``condition, region, i, j, v``."""
    maps = None
    for condition in conditions:
        for region in regions:
            cells, _ = S.read_map(spark, pattern.format(root=root, condition=condition, region=region))
            one = cells.select(F.lit(condition).alias("condition"), F.lit(region).alias("region"), "i", "j", "v")
            maps = one if maps is None else maps.unionByName(one)
    return normalized_maps(maps, **how)


def normalized_maps(maps: DataFrame, **how) -> DataFrame:
    """Maps (condition, region, i, j, v), as :func:`weftmap.sources.text.read_maps` gives them, each normalised by its own neighbour factors."""
    named = staged(maps.select(F.concat_ws("\t", "condition", "region").alias("region"), "i", "j", "v"))
    parts = F.split("region", "\t")
    return M.normalize_neighbor(named, **how).select(parts[0].alias("condition"), parts[1].alias("region"), "i", "j", "v")


def batch_reports(maps: DataFrame, reference: str, conditions: Sequence[str], separation: int = 5) -> DataFrame:
    """``condition, region, global_factor, factors``: what brings each condition's near decay to the reference's, as :func:`load_maps` gives them."""
    of = lambda c: maps.where(F.col("condition") == c).drop("condition")
    out = None
    for c in conditions:
        one = M.factor_report(M.batch_factors(of(c), of(reference), separation)).withColumn("condition", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out.select("condition", "region", "global_factor", "factors")
