"""Queries on contact maps counted from the pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import staged, table
from ..operators import balance as B
from ..operators import maps as M
from ..operators.pairs import valid_pairs
from .pairs import valid_sql

RES = 1_000_000
FINE = 10_000
ZOOM = 4
MAD, NNZ, RATE = 1.7, 4, 0.02
DIGITS = 6


def _bins(spark: SparkSession, d: str, resolution: int = RES) -> DataFrame:
    return M.make_bins(table(spark, d, "chrom_sizes"), resolution)


def _valid(spark: SparkSession, d: str, **kw) -> DataFrame:
    return valid_pairs(table(spark, d, "pairs"), table(spark, d, "chrom_sizes"), **kw)


def _pixels(spark: SparkSession, d: str, **kw) -> DataFrame:
    return M.count_pixels(_valid(spark, d, **kw), _bins(spark, d), RES)


def _map(spark: SparkSession, d: str) -> DataFrame:
    """The cis maps, written once: the queries read them several times."""
    return staged(M.cis_map(_pixels(spark, d), _bins(spark, d)))


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    return staged(M.filter_map(_map(spark, d), None, MAD, NNZ))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in cols})


def bins_table(spark, d):
    return _bins(spark, d)


def bin_counts(spark, d):
    return _pixels(spark, d)


def merge_replicates(spark, d):
    """Runs counted apart as replicates, then added up."""
    by_run = M.count_pixels(_valid(spark, d), _bins(spark, d), RES, ["run"])
    return M.merge_pixels(by_run.drop("run"))


def zoomify(spark, d):
    return M.zoom_pixels(_pixels(spark, d), _bins(spark, d), _bins(spark, d, RES * ZOOM), ZOOM)


def remove_inward(spark, d):
    """All and inward pairs counted in one pass."""
    inward = (F.col("strand1") == "+") & (F.col("strand2") == "-")
    return M.without_inward(M.count_pixels(_valid(spark, d), _bins(spark, d), RES, also={"inward": inward}), _bins(spark, d), k=2)


def _fine(spark, d, **also):
    bins = _bins(spark, d, FINE)
    return M.count_pixels(_valid(spark, d), bins, FINE, **also), bins


def fine_counts(spark, d):
    """Pixels of 10 kb; those few queries whose work grows with the pairs, not with the square of the bins."""
    return _fine(spark, d)[0]


def fine_zoom(spark, d):
    return M.zoom_pixels(*_fine(spark, d), _bins(spark, d, FINE * ZOOM), ZOOM)


def fine_without_inward(spark, d):
    inward = (F.col("strand1") == "+") & (F.col("strand2") == "-")
    return M.without_inward(*_fine(spark, d, also={"inward": inward}), k=2)


def fine_distance_average(spark, d):
    """The decay over all distances of the longest chromosome, and of the others."""
    return _rounded(M.sparse_average(*_fine(spark, d), 1 << 30), "v")


def fine_neighbor_factors(spark, d):
    return _rounded(M.neighbor_factors(M.first_diagonal(*_fine(spark, d)), ["chrom"]), "nf")


def map_filter_all(spark, d):
    """Depth, capture and number of cells together."""
    rates = M.capture_rates(table(spark, d, "bed"), _regions(spark, d), RES)
    return M.filter_map(_map(spark, d), rates, MAD, NNZ, RATE)


def gaussian_interp(spark, d):
    m = M.marginal(_map(spark, d)).withColumn("s", F.when(F.col("s") > 3, F.col("s")))
    return _rounded(M.gaussian(m, ["region"], "i", "s", 1.0, "interp"), "s")


def first_diagonal(spark, d):
    return M.first_diagonal(_pixels(spark, d), _bins(spark, d))


def dense_map(spark, d):
    return M.cis_map(_pixels(spark, d), _bins(spark, d))


def sparse_distance_average(spark, d):
    return _rounded(M.sparse_average(_pixels(spark, d), _bins(spark, d), 100), "v")


def marginal_k1(spark, d):
    return M.marginal(_map(spark, d), 1)


def marginal_k2(spark, d):
    return M.marginal(_map(spark, d), 2)


def marginal_flanks(spark, d):
    return _rounded(M.marginal(_filtered(spark, d), 1, flanks=True), "s")


def distance_average(spark, d):
    return _rounded(M.distance_average(_filtered(spark, d), show_self=True), "v")


def strict_distance_average(spark, d):
    return _rounded(M.strict_average(_filtered(spark, d)), "v")


def mad_filter(spark, d):
    return M.mad_mask(_map(spark, d), MAD)


def nnz_filter(spark, d):
    return M.filter_map(_map(spark, d), None, 0, NNZ)


def map_filter(spark, d):
    return M.filter_map(_map(spark, d), None, MAD, NNZ)


def _regions(spark, d):
    return table(spark, d, "chrom_sizes").select(F.col("chrom").alias("region"), "chrom", F.lit(0).cast("long").alias("start"), (F.ceil(F.col("size") / RES) * RES).alias("end"))


def capture_rates(spark, d):
    return _rounded(M.capture_rates(table(spark, d, "bed"), _regions(spark, d), RES), "rate")


def capture_filter(spark, d):
    rates = M.capture_rates(table(spark, d, "bed"), _regions(spark, d), RES)
    return M.filter_map(_map(spark, d), rates, 0, 0, RATE).groupBy("region").agg(F.count("*").alias("cells"), F.count("v").alias("kept"), F.sum("v").alias("s"))


def map_validity(spark, d):
    return M.invalid_rows(_filtered(spark, d))


def _factors(average):
    def run(spark, d):
        diagonal = M.first_diagonal(_pixels(spark, d), _bins(spark, d)).withColumn("v", F.when(F.col("v") > 0, F.col("v")))
        return _rounded(M.neighbor_factors(diagonal, ["chrom"], average), "nf")

    run.__name__ = f"neighbor_factors_{average}"
    return run


def neighbor_weights(spark, d):
    """Weights of the coarse bins (one over the root of their counts) with and without the neighbour factors of the fine bins."""
    px, bins = staged(_pixels(spark, d)), _bins(spark, d)
    factors = M.neighbor_factors(M.first_diagonal(px, bins), ["chrom"])
    coarse = _bins(spark, d, RES * ZOOM)
    up = M.zoom_pixels(px, bins, coarse, ZOOM)
    depth = up.select(F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id"), "count").groupBy("bin_id").agg(F.sum("count").alias("s"))
    weighted = coarse.join(depth, "bin_id", "left").withColumn("weight", 1 / F.sqrt("s")).drop("s")
    out = M.neighbor_weights(factors, weighted, RES, RES * ZOOM)
    return out.select("bin_id", "chrom", "i", F.round("weight", DIGITS).alias("weight"), F.round("weight_neighbor", DIGITS).alias("weight_neighbor"))


def neighbor_normalize(spark, d):
    return _rounded(M.normalize_neighbor(_map(spark, d), bw=1), "v")


def neighbor_normalize_plain(spark, d):
    return _rounded(M.normalize_neighbor(_map(spark, d), bw=0), "v")


def gap_fill(spark, d):
    m = M.marginal(_map(spark, d)).withColumn("s", F.when(F.col("s") > 3, F.col("s")))
    return _rounded(M.fill_gaps(m, ["region"], "i", "s"), "s")


def gaussian_1d(spark, d):
    m = M.marginal(_map(spark, d)).withColumn("s", F.when(F.col("s") > 3, F.col("s")))
    return _rounded(M.gaussian(m, ["region"], "i", "s", 1.0, "mask"), "s")


def sliding_mean(spark, d):
    return _rounded(M.sliding_mean(M.marginal(_map(spark, d)), ["region"], "i", "s", 5), "mean")


def interpolate_diagonals(spark, d):
    return _rounded(M.interpolate_diagonals(_filtered(spark, d)), "v")


def ice_3iter(spark, d):
    """Three rounds of balancing the genome-wide pixels."""
    px = staged(_pixels(spark, d))
    bias = _bins(spark, d).select("bin_id", F.lit(1.0).alias("bias"))
    for _ in range(3):
        bias = staged(M.ice_step(px, bias))
    return _rounded(bias, "bias")


def balance_pixels(spark, d):
    """Genome-wide weights, and from them neighbour weights, of the bins and of those zoomed from them; the diagonal counts, as in the surveyed zoom."""
    bins, coarse = _bins(spark, d), _bins(spark, d, RES * ZOOM)
    px = staged(_pixels(spark, d))
    maps = {RES: (px, bins), RES * ZOOM: (staged(M.zoom_pixels(px, bins, coarse, ZOOM)), coarse)}
    done = {res: M.balance_pixels(*m, ignore_diags=0) for res, m in maps.items()}
    factors = staged(M.neighbor_factors(M.first_diagonal(px, done[RES].weights, "weight"), ["chrom"]))
    out = None
    for res, b in done.items():
        rows = M.neighbor_weights(factors, b.weights, RES, res).select(
            F.lit(res).alias("resolution"), "bin_id", "chrom", "i", "weight", "weight_neighbor", F.lit(b.rounds).alias("rounds"), F.lit(b.converged).alias("converged")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def coarsen_sum(spark, d):
    return M.coarsen_map(_filtered(spark, d), 5)


def coarsen_multiscale(spark, d):
    return _rounded(M.coarsen_by_distance(_map(spark, d), F.avg, base=4), "v")


def _two_maps(spark, d):
    """The maps of the run with the most pairs and of all others."""
    valid, bins = _valid(spark, d), _bins(spark, d)
    largest = table(spark, d, "pairs").where("run IS NOT NULL").groupBy("run").count().orderBy(F.desc("count"), "run").select("run").first()
    is_largest = F.coalesce(F.col("run") == F.lit(largest["run"] if largest else None), F.lit(False))
    return tuple(staged(M.cis_map(M.count_pixels(valid.where(c), bins, RES), bins)) for c in (is_largest, ~is_largest))


def batch_factors(spark, d):
    return _rounded(M.batch_factors(*_two_maps(spark, d), 3), "factor", "global_factor")


def batch_apply(spark, d):
    query, reference = _two_maps(spark, d)
    return _rounded(M.apply_batch_factors(query, staged(M.batch_factors(query, reference, 3))), "v")


def map_log_ratio(spark, d):
    return _rounded(M.log_ratio(*_two_maps(spark, d)), "v")


def map_merge(spark, d):
    return M.merged_map(*_two_maps(spark, d))


def map_select(spark, d):
    return M.select_region(_map(spark, d), 10, 40)


def map_rotated(spark, d):
    return M.rotated(_map(spark, d), 0, RES)


def region_balance(spark, d):
    """Every chromosome filtered, balanced, interpolated and balanced again; all come out, marked where they cannot be balanced."""
    return B.balance_regions(_filtered(spark, d), max_iter=20, tol=1e-5)


def region_balance_fixed(spark, d):
    """The same with one round a stage, whatever the variance."""
    return _rounded(B.balance_regions(_filtered(spark, d), max_iter=1, tol=0.0), "v")


def smooth_diagonals(spark, d):
    return _rounded(B.smooth_by_distance(_filtered(spark, d)), "v")


def interpolate_smoothed(spark, d):
    """Diagonals interpolated between values smoothed with the width of their separation."""
    return _rounded(M.interpolate_diagonals(_filtered(spark, d), B.growing_width()), "v")


def density_peaks(spark, d):
    s = M.marginal(_map(spark, d)).withColumn("s", -F.log2(F.col("s") + 1))
    return _rounded(B.call_peaks(s, 2, 0.4), "prominence")


def map_compare_smoothed(spark, d):
    return _rounded(M.compared(*_two_maps(spark, d), bw=1), "v")


_AVERAGES = ("arithmetic", "harmonic", "geometric", "mse")
QUERIES = {f.__name__: f for f in (
    bins_table, bin_counts, merge_replicates, zoomify, remove_inward, first_diagonal, dense_map, sparse_distance_average, marginal_k1, marginal_k2,
    marginal_flanks, distance_average, strict_distance_average, mad_filter, nnz_filter, map_filter, capture_rates, capture_filter, map_validity,
    *map(_factors, _AVERAGES), neighbor_weights, neighbor_normalize, neighbor_normalize_plain, gap_fill, gaussian_1d, sliding_mean,
    interpolate_diagonals, ice_3iter, balance_pixels, coarsen_sum, coarsen_multiscale, batch_factors, batch_apply, map_log_ratio, map_merge, map_select, map_rotated,
    fine_counts, fine_zoom, fine_without_inward, fine_distance_average, fine_neighbor_factors, map_filter_all, gaussian_interp, region_balance, region_balance_fixed, smooth_diagonals, interpolate_smoothed, density_peaks, map_compare_smoothed,
)}


# ---------------------------------------------------------------- SQL


def _bins_sql(name: str, res: int) -> str:
    return f"""{name}_sz AS (SELECT chrom, size, CAST(ceil(size / {res}.0) AS BIGINT) AS n FROM chrom_sizes),
{name}_of AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM {name}_sz),
{name} AS (SELECT chrom, unnest(range(n)) AS i, off + unnest(range(n)) AS bin_id, unnest(range(n)) * {res} AS start,
 least((unnest(range(n)) + 1) * {res}, size) AS "end" FROM {name}_of)"""


def _px_sql(name: str, where: str = "TRUE", keys: str = "", bins: str = "bins", res: int = RES) -> str:
    return f"""{name} AS (SELECT {keys} least(a, b) AS bin1_id, greatest(a, b) AS bin2_id, count(*) AS count FROM (
 SELECT v.*, x.off + CAST(floor((pos1 - 1) / {res}.0) AS BIGINT) AS a, y.off + CAST(floor((pos2 - 1) / {res}.0) AS BIGINT) AS b
 FROM ({valid_sql()}) v JOIN {bins}_of x ON x.chrom = v.chrom1 JOIN {bins}_of y ON y.chrom = v.chrom2 WHERE {where}) GROUP BY ALL)"""


def _map_sql(name: str, px: str) -> str:
    return f"""{name} AS (SELECT a.chrom AS region, a.i, b.i AS j, CAST(coalesce(count, 0) AS DOUBLE) AS v FROM bins a JOIN bins b ON a.chrom = b.chrom AND b.i >= a.i
 LEFT JOIN {px} p ON p.bin1_id = a.bin_id AND p.bin2_id = b.bin_id)"""


def _full_sql(name: str, m: str) -> str:
    return f"{name} AS (SELECT region, i, j, v FROM {m} UNION ALL SELECT region, j, i, v FROM {m} WHERE i < j)"


_B = "WITH " + _bins_sql("bins", RES)
_PX = _B + ",\n" + _px_sql("px")
_M = _PX + ",\n" + _map_sql("m", "px") + ",\n" + _full_sql("ff", "m")
_ROWS = "rs AS (SELECT region, i, coalesce(sum(CASE WHEN i <> j THEN v END), 0) AS s FROM ff GROUP BY ALL)"
_MAD = f"""{_ROWS},
lg AS (SELECT *, CASE WHEN s > 0 THEN ln(s) ELSE CAST('-inf' AS DOUBLE) END AS l FROM rs),
md AS (SELECT region, median(l) AS mid FROM lg GROUP BY region HAVING count(*) FILTER (s > 0) * 2 > count(*)),
dv AS (SELECT lg.*, mid, CASE WHEN s > 0 THEN abs(l - mid) ELSE CAST('inf' AS DOUBLE) END AS dev FROM lg JOIN md USING (region)),
mm AS (SELECT region, median(dev) AS mad FROM dv GROUP BY region),
low AS (SELECT region, i FROM dv JOIN mm USING (region) WHERE l < mid - {MAD} * mad)"""


def _nnz(source: str) -> str:
    return f"few AS (SELECT region, i FROM {source} GROUP BY region, i HAVING count(*) FILTER (v > 0) < {NNZ})"


_TRI = """SELECT region, least(i, j) AS i, greatest(i, j) AS j, CASE WHEN count(v) = count(*) THEN max(v) END AS v FROM (
 SELECT g.region, g.i, g.j, CASE WHEN a.i IS NULL AND b.i IS NULL THEN v END AS v FROM {0} g
 LEFT JOIN few a ON a.region = g.region AND a.i = g.i LEFT JOIN few b ON b.region = g.region AND b.i = g.j) GROUP BY 1, 2, 3"""
_FM = f"""{_M}, {_MAD},
g AS (SELECT ff.region, ff.i, ff.j, CASE WHEN low.i IS NULL THEN v END AS v FROM ff LEFT JOIN low ON low.region = ff.region AND low.i = ff.i),
{_nnz('g')}, fm AS ({_TRI.format('g')})"""


def _fill_sql(source: str, keys: str, pos: str, v: str) -> str:
    w = f"PARTITION BY {keys} ORDER BY {pos}"
    return f"""SELECT * EXCLUDE (lp, rp, lv, rv, {v}), coalesce({v}, CASE WHEN lp IS NULL THEN rv WHEN rp IS NULL THEN lv
 ELSE lv + (rv - lv) / (rp - lp) * ({pos} - lp) END) AS {v} FROM (SELECT *,
 last_value(CASE WHEN {v} IS NOT NULL THEN {pos} END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lp,
 first_value(CASE WHEN {v} IS NOT NULL THEN {pos} END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rp,
 last_value({v} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv,
 first_value({v} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv FROM {source})"""


def _smooth_sql(source: str, v: str, spread: bool, sigma: float = 1.0, truncate: float = 4.0) -> str:
    """A kernel over (region, i, v)."""
    w = M.gaussian_weights(sigma, truncate)
    taps = ", ".join(f"({k - len(w) // 2}, {x!r})" for k, x in enumerate(w))
    value = f"CASE WHEN count(s.{v}) = count(*) THEN sum(w * s.{v}) END" if spread else f"CASE WHEN max(t.{v}) IS NOT NULL THEN sum(w * s.{v}) / sum(CASE WHEN s.{v} IS NOT NULL THEN w END) END"
    return f"""SELECT t.region, t.i, {value} AS {v} FROM (
 SELECT x.*, w, CASE WHEN ((i + o) % (2 * n) + 2 * n) % (2 * n) < n THEN ((i + o) % (2 * n) + 2 * n) % (2 * n)
   ELSE 2 * n - 1 - ((i + o) % (2 * n) + 2 * n) % (2 * n) END AS p
 FROM (SELECT *, count(*) OVER (PARTITION BY region) AS n FROM {source}) x, (VALUES {taps}) k(o, w)) t
 JOIN {source} s ON s.region = t.region AND s.i = t.p GROUP BY t.region, t.i"""


_DIAG = """dg AS (SELECT a.chrom, a.i, CAST(coalesce(count, 0) AS DOUBLE) AS v FROM bins a JOIN bins b ON b.chrom = a.chrom AND b.i = a.i + 1
 LEFT JOIN px ON px.bin1_id = a.bin_id AND px.bin2_id = b.bin_id)"""
_AVG_SQL = {
    "arithmetic": "avg(v)", "harmonic": "1 / avg(1 / v)", "mse": "sum(v * v) / sum(v)",
    "geometric": "CASE WHEN count(v) = count(*) THEN pow(product(v), 1.0 / count(*)) WHEN count(v) > 0 THEN product(v) END",
}
_SIDES = "sd AS (SELECT chrom, i, v FROM dg UNION ALL SELECT chrom, i + 1, v FROM dg)"


def _norm_sql(smoothed: bool) -> str:
    return f"""{_M},
d0 AS (SELECT region, i, v FROM m WHERE j = i + 1), dm AS (SELECT region, avg(v) AS mean FROM d0 GROUP BY region),
d1 AS (SELECT region, i, greatest(least(v, mean / 0.1), mean * 0.1) AS v FROM d0 JOIN dm USING (region)),
n0 AS (SELECT region, i, avg(v) AS nf FROM (SELECT * FROM d1 UNION ALL SELECT region, i + 1, v FROM d1) GROUP BY ALL),
nf AS ({_smooth_sql('n0', 'nf', True) if smoothed else 'SELECT * FROM n0'}),
q AS (SELECT m.region, m.i, m.j, v / nullif(sqrt(a.nf * b.nf), 0) AS v FROM m LEFT JOIN nf a ON a.region = m.region AND a.i = m.i
      LEFT JOIN nf b ON b.region = m.region AND b.i = m.j),
mn AS (SELECT region, avg(v) AS mean FROM q WHERE j = i + 1 GROUP BY region)
SELECT q.region, i, j, round(CASE WHEN v / nullif(mean, 0) > 10 THEN 10 ELSE v / nullif(mean, 0) END, {DIGITS}) AS v FROM q LEFT JOIN mn USING (region)"""


def _ice_sql(rounds: int) -> str:
    out = _PX + ", b0 AS (SELECT bin_id, CAST(1 AS DOUBLE) AS bias FROM bins)"
    for k in range(rounds):
        out += f""",
v{k} AS (SELECT bin1_id, bin2_id, count / (a.bias * b.bias) AS v FROM px JOIN b{k} a ON a.bin_id = bin1_id JOIN b{k} b ON b.bin_id = bin2_id WHERE bin2_id > bin1_id),
s{k} AS (SELECT bin_id, sum(v) AS s FROM (SELECT bin1_id AS bin_id, v FROM v{k} UNION ALL SELECT bin2_id, v FROM v{k}) GROUP BY 1),
b{k + 1} AS (SELECT bin_id, bias * CASE WHEN s <> 0 THEN s / (SELECT avg(s) FROM s{k} WHERE s <> 0) ELSE 1 END AS bias FROM b{k} LEFT JOIN s{k} USING (bin_id))"""
    return out + f"\nSELECT bin_id, round(bias, {DIGITS}) AS bias FROM b{rounds}"


_LARGEST = "coalesce(run = (SELECT run FROM pairs WHERE run IS NOT NULL GROUP BY run ORDER BY count(*) DESC, run LIMIT 1), FALSE)"
_TWO = _B + ",\n" + _px_sql("pa", _LARGEST) + ",\n" + _px_sql("pb", f"NOT {_LARGEST}") + ",\n" + _map_sql("ma", "pa") + ",\n" + _map_sql("mb", "pb")
_FACTORS = """,
qa AS (SELECT region, j - i AS d, avg(v) AS v FROM ma WHERE j - i <= 3 GROUP BY ALL), qb AS (SELECT region, j - i AS d, avg(v) AS v FROM mb WHERE j - i <= 3 GROUP BY ALL),
ua AS (SELECT * FROM qa UNION ALL SELECT 'merged', d, avg(v) FROM qa GROUP BY d), ub AS (SELECT * FROM qb UNION ALL SELECT 'merged', d, avg(v) FROM qb GROUP BY d),
u AS (SELECT region, d, ua.v AS q, ub.v AS r FROM ua JOIN ub USING (region, d)),
gf AS (SELECT region, r / nullif(q, 0) AS g FROM u WHERE d = 3),
bf AS (SELECT region, d, r / nullif(q * g, 0) AS factor, g AS global_factor FROM u JOIN gf USING (region) WHERE d < 3)"""


def _multiscale_sql(base: int, ks: int) -> str:
    parts = []
    for k in range(1, ks + 1):
        f, start, end = 2**k, base**k, base ** (k + 1)
        parts.append(f"""SELECT region, i, j, {k} AS k, avg(v) OVER (PARTITION BY region, a, b) AS v FROM (
 SELECT ff.*, n, i // {f} * {f} AS a, CAST(floor((j - i // {f} * {f} - {start}) / {f}.0) AS BIGINT) AS b FROM ff JOIN sz USING (region))
 WHERE b >= 0 AND a + {start} < n AND a + {start} + b * {f} < least(a + {end}, n) AND {k} <= ceil(ln(n) / ln({base})) - 1""")
    return f"""{_M}, sz AS (SELECT region, max(j) + 1 AS n FROM m GROUP BY 1), bl AS ({' UNION ALL '.join(parts)}),
best AS (SELECT region, i, j, arg_max(v, k) AS nv FROM bl WHERE i <= j GROUP BY ALL)
SELECT m.region, m.i, m.j, round(coalesce(nv, v), {DIGITS}) AS v FROM m LEFT JOIN best USING (region, i, j)"""


def _flank_rows(p: str, m: str) -> str:
    """Row sums with the mean decay beyond the region on both sides."""
    return f"""{_full_sql(p + '_ff', m)},
{p}_r AS (SELECT region, i, coalesce(sum(CASE WHEN i <> j THEN v END), 0) AS s, max(j) + 1 AS n FROM {p}_ff GROUP BY region, i),
{p}_p0 AS (SELECT region, j - i AS d, avg(v) AS v FROM {m} WHERE j > i GROUP BY ALL), {p}_ps AS ({_fill_sql(p + '_p0', 'region', 'd', 'v')}),
{p}_tl AS (SELECT region, d, sum(v) OVER (PARTITION BY region ORDER BY d DESC) AS t FROM {p}_ps),
{p}_s AS (SELECT r.region, r.i, CASE WHEN s <> 0 THEN s + coalesce(a.t, 0) + coalesce(b.t, 0) ELSE s END AS s FROM {p}_r r
 LEFT JOIN {p}_tl a ON a.region = r.region AND a.d = r.i + 1 LEFT JOIN {p}_tl b ON b.region = r.region AND b.d = r.n - r.i + 1)"""


_MIRROR = "CASE WHEN (({0}) % (2 * n) + 2 * n) % (2 * n) < n THEN (({0}) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - (({0}) % (2 * n) + 2 * n) % (2 * n) END"


def _interpolated_sql(p: str, m: str, sigma: str) -> str:
    """Diagonals filled between smoothed values; sigma is an expression of d."""
    w = "PARTITION BY region, d ORDER BY i"
    return f"""{p}_z AS MATERIALIZED (SELECT *, j - i AS d, CAST(count(*) OVER (PARTITION BY region, j - i) AS BIGINT) AS n FROM {m}),
{p}_e AS (SELECT region, d, i, n, {sigma} AS g FROM (SELECT *, lag(v) OVER ({w}) AS lv, lead(v) OVER ({w}) AS rv FROM {p}_z)
 WHERE v IS NOT NULL AND ((i > 0 AND lv IS NULL) OR (i < n - 1 AND rv IS NULL))),
{p}_t AS (SELECT *, unnest(range(-CAST(floor(4 * g + 0.5) AS BIGINT), CAST(floor(4 * g + 0.5) AS BIGINT) + 1)) AS k FROM {p}_e),
{p}_q AS (SELECT region, d, i, exp(-0.5 * (k / g) * (k / g)) AS w, {_MIRROR.format('i + k')} AS p FROM {p}_t),
{p}_a AS (SELECT q.region, q.d, q.i, sum(w * z.v) / sum(w) AS a FROM {p}_q q JOIN {p}_z z ON z.region = q.region AND z.d = q.d AND z.i = q.p WHERE z.v IS NOT NULL GROUP BY ALL),
{p}_l AS (SELECT *, last_value(a IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS la,
 first_value(a IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ra,
 last_value(CASE WHEN a IS NOT NULL THEN i END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li,
 first_value(CASE WHEN a IS NOT NULL THEN i END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri
 FROM (SELECT z.*, a FROM {p}_z z LEFT JOIN {p}_a a ON a.region = z.region AND a.d = z.d AND a.i = z.i)),
{p}_d0 AS (SELECT region, d, avg(v) AS v FROM {p}_z GROUP BY ALL), {p}_dd AS ({_fill_sql(p + '_d0', 'region', 'd', 'v')}),
{p} AS MATERIALIZED (SELECT l.region, l.i, l.j, coalesce(l.v, CASE WHEN la IS NULL THEN ra WHEN ra IS NULL THEN la ELSE la + (ra - la) / (ri - li) * (l.i - li) END, dd.v) AS v
 FROM {p}_l l JOIN {p}_dd dd ON dd.region = l.region AND dd.d = l.d)"""


def _step_sql(p: str, rows: str, m: str) -> str:
    """One round: cells divided by their bins' sums relative to the mean."""
    return f"""{p}_st AS (SELECT region, i, CASE WHEN s <> 0 THEN s / avg(CASE WHEN s <> 0 THEN s END) OVER (PARTITION BY region) ELSE 1 END AS step FROM {rows}),
{p} AS MATERIALIZED (SELECT m.region, m.i, m.j, v / (a.step * b.step) AS v FROM {m} m JOIN {p}_st a ON a.region = m.region AND a.i = m.i JOIN {p}_st b ON b.region = m.region AND b.i = m.j)"""


def _masked_sql(p: str, m: str) -> str:
    return f"""{_full_sql(p + '_ff', m)},
{p}_b AS (SELECT region, i FROM {p}_ff GROUP BY ALL HAVING NOT coalesce(sum(CASE WHEN i <> j THEN v END), 0) > 0 AND count(v) > 0),
{p} AS MATERIALIZED (SELECT m.region, m.i, m.j, CASE WHEN a.i IS NULL AND b.i IS NULL THEN v END AS v FROM {m} m LEFT JOIN {p}_b a ON a.region = m.region AND a.i = m.i
 LEFT JOIN {p}_b b ON b.region = m.region AND b.i = m.j)"""


_GROWING = "2.0 * pow(greatest(1, d - 2), 0.2)"
_ZEROS = "{0} AS (SELECT region, i, j, coalesce(v, 0) AS v FROM {1})"
#: Masking four times is enough for these tables: the fifth time finds nothing.
_BALANCE = ",\n".join([
    *(_masked_sql(f"k{n + 1}", "fm" if n == 0 else f"k{n}") for n in range(4)),
    _ZEROS.format("z1", "k4"), _flank_rows("f1", "z1"), _step_sql("w1", "f1_s", "k4"),
    _interpolated_sql("i1", "w1", _GROWING), _flank_rows("f2", "i1"), _step_sql("w2", "f2_s", "w1"), _interpolated_sql("i2", "w2", _GROWING),
    _ZEROS.format("z3", "i2"), _flank_rows("f3", "z3"), _step_sql("w3", "f3_s", "i2"),
])


def _mirrored_taps(source: str, fixed: str, moved: str, v: str, taps: str) -> str:
    """A kernel along one axis of a full map."""
    return f"""SELECT t.region, t.{fixed}, t.{moved}, sum(w * s.{v}) AS {v} FROM (SELECT x.*, w, {_MIRROR.format(moved + ' + o')} AS p FROM
 (SELECT *, max({moved}) OVER (PARTITION BY region) + 1 AS n FROM {source}) x, (VALUES {taps}) k(o, w)) t
 JOIN {source} s ON s.region = t.region AND s.{fixed} = t.{fixed} AND s.{moved} = t.p GROUP BY ALL"""


_RATIO = """CASE WHEN a.v = 0 AND b.v = 0 THEN NULL WHEN b.v = 0 THEN CAST('inf' AS DOUBLE) WHEN a.v = 0 THEN CAST('-inf' AS DOUBLE) ELSE log2(a.v / b.v) END"""
_W1 = M.gaussian_weights(1.0)
_TAPS = ", ".join(f"({k - len(_W1) // 2}, {x!r})" for k, x in enumerate(_W1))


ORACLE = {
    "bins_table": _B + "\nSELECT * FROM bins",
    "bin_counts": _PX + "\nSELECT * FROM px",
    "merge_replicates": _B + ",\n" + _px_sql("px", keys="run,") + "\nSELECT bin1_id, bin2_id, CAST(sum(count) AS BIGINT) AS count FROM px GROUP BY ALL",
    "zoomify": _B + ",\n" + _bins_sql("cb", RES * ZOOM) + ",\n" + _px_sql("px", bins="cb", res=RES * ZOOM) + "\nSELECT * FROM px",
    "remove_inward": _PX + ",\n" + _px_sql("pi", "strand1 = '+' AND strand2 = '-'") + """
SELECT px.bin1_id, px.bin2_id, CAST(CASE WHEN a.chrom = b.chrom AND b.i - a.i <= 2 THEN floor(4 * (px.count - coalesce(pi.count, 0)) / 3.0) ELSE px.count END AS BIGINT) AS count
FROM px LEFT JOIN pi USING (bin1_id, bin2_id) JOIN bins a ON a.bin_id = px.bin1_id JOIN bins b ON b.bin_id = px.bin2_id""",
    "first_diagonal": f"{_PX}, {_DIAG} SELECT * FROM dg",
    "dense_map": _M + "\nSELECT * FROM m",
    "sparse_distance_average": f"{_M} SELECT region AS chrom, j - i AS d, round(avg(v), {DIGITS}) AS v FROM m WHERE j - i < 100 GROUP BY ALL",
    "marginal_k1": f"{_M}, {_ROWS} SELECT * FROM rs",
    "marginal_k2": f"{_M} SELECT region, i, coalesce(sum(CASE WHEN abs(i - j) >= 2 THEN v END), 0) AS s FROM ff GROUP BY ALL",
    "marginal_flanks": f"""{_FM}, {_full_sql('f2', 'fm')},
r2 AS (SELECT region, i, coalesce(sum(CASE WHEN i <> j THEN v END), 0) AS s, max(j) + 1 AS n FROM f2 GROUP BY region, i),
p0 AS (SELECT region, j - i AS d, avg(v) AS v FROM fm WHERE j > i GROUP BY ALL), ps AS ({_fill_sql('p0', 'region', 'd', 'v')}),
tl AS (SELECT region, d, sum(v) OVER (PARTITION BY region ORDER BY d DESC) AS t FROM ps)
SELECT r2.region, r2.i, round(CASE WHEN s <> 0 THEN s + coalesce(a.t, 0) + coalesce(b.t, 0) ELSE s END, {DIGITS}) AS s
FROM r2 LEFT JOIN tl a ON a.region = r2.region AND a.d = r2.i + 1 LEFT JOIN tl b ON b.region = r2.region AND b.d = r2.n - r2.i + 1""",
    "distance_average": f"{_FM} SELECT region, j - i AS d, round(avg(v), {DIGITS}) AS v FROM fm GROUP BY ALL",
    "strict_distance_average": f"{_FM} SELECT region, j - i AS d, round(CASE WHEN count(v) = count(*) THEN avg(v) END, {DIGITS}) AS v FROM fm GROUP BY ALL",
    "mad_filter": f"{_M}, {_MAD} SELECT * FROM low",
    "nnz_filter": f"{_M}, {_nnz('ff')} {_TRI.format('ff')}",
    "map_filter": f"{_FM} SELECT * FROM fm",
    "map_validity": f"{_FM}, {_full_sql('f2', 'fm')} SELECT region, i FROM f2 GROUP BY ALL HAVING NOT coalesce(sum(CASE WHEN i <> j THEN v END), 0) > 0 AND count(v) > 0",
    **{f"neighbor_factors_{a}": f"""{_PX}, {_DIAG.replace("CAST(coalesce(count, 0) AS DOUBLE)", "CAST(nullif(coalesce(count, 0), 0) AS DOUBLE)")}, {_SIDES}
SELECT chrom, i, round({_AVG_SQL[a]}, {DIGITS}) AS nf FROM sd GROUP BY ALL""" for a in _AVERAGES},
    "neighbor_weights": f"""{_PX}, {_bins_sql('cb', RES * ZOOM)}, {_px_sql('pc', bins='cb', res=RES * ZOOM)}, {_DIAG}, {_SIDES},
nf AS (SELECT chrom, i, avg(v) AS nf FROM sd GROUP BY ALL),
up AS (SELECT chrom, i // {ZOOM} AS i, avg(nf) AS nf FROM nf GROUP BY ALL), wh AS (SELECT chrom, avg(nf) AS whole FROM nf GROUP BY ALL),
uw AS (SELECT chrom, i, coalesce(nf, whole) AS nf FROM up JOIN wh USING (chrom)), md AS (SELECT median(nf) AS mid FROM uw),
cl AS (SELECT chrom, i, greatest(least(nf, mid * 10), mid / 10) AS nf FROM uw, md),
dp AS (SELECT bin_id, sum(count) AS s FROM (SELECT bin1_id AS bin_id, count FROM pc UNION ALL SELECT bin2_id, count FROM pc) GROUP BY ALL)
SELECT cb.bin_id, cb.chrom, cb.i, round(1 / sqrt(s), {DIGITS}) AS weight, round(1 / sqrt(s) / sqrt(nf), {DIGITS}) AS weight_neighbor
FROM cb LEFT JOIN dp USING (bin_id) LEFT JOIN cl ON cl.chrom = cb.chrom AND cl.i = cb.i""",
    "neighbor_normalize": _norm_sql(True),
    "neighbor_normalize_plain": _norm_sql(False),
    "capture_rates": f"""WITH rg AS (SELECT chrom, CAST(ceil(size / {RES}.0) AS BIGINT) AS n FROM chrom_sizes),
h AS (SELECT b.chrom, n, greatest(start, 0) AS low, least("end", n * {RES}) AS high FROM bed b JOIN rg ON rg.chrom = b.chrom
 WHERE start < "end" AND ((start >= 0 AND start < n * {RES}) OR ("end" >= 0 AND "end" < n * {RES}))),
x AS (SELECT *, unnest(generate_series(low // {RES}, (high - 1) // {RES})) AS i FROM h WHERE high > low),
r AS (SELECT chrom, i, sum(least(high, (i + 1) * {RES}) - greatest(low, i * {RES})) / {RES}.0 AS rate FROM x GROUP BY ALL),
s AS (SELECT chrom, unnest(range(n)) AS i FROM rg)
SELECT s.chrom AS region, s.i, round(CAST(coalesce(rate, 0) AS DOUBLE), {DIGITS}) AS rate FROM s LEFT JOIN r ON r.chrom = s.chrom AND r.i = s.i""",
    "gap_fill": f"""{_M}, {_ROWS}, z AS (SELECT region, i, CASE WHEN s > 3 THEN s END AS s FROM rs), y AS ({_fill_sql('z', 'region', 'i', 's')})
SELECT region, i, round(s, {DIGITS}) AS s FROM y""",
    "gaussian_1d": f"""{_M}, {_ROWS}, z AS (SELECT region, i, CASE WHEN s > 3 THEN s END AS s FROM rs), y AS ({_smooth_sql('z', 's', False)})
SELECT region, i, round(s, {DIGITS}) AS s FROM y""",
    "sliding_mean": f"""{_M}, {_ROWS}, z AS (SELECT *, count(*) OVER (PARTITION BY region) AS n FROM rs),
b AS (SELECT region, i, CASE WHEN i <= 5 THEN 0 ELSE i - 5 END AS lo, CASE WHEN i <= 5 THEN 2 * i ELSE least(i + 5, n - 1) END AS hi, n FROM z)
SELECT b.region, b.i, round(CASE WHEN max(b.hi) < max(b.n) THEN avg(rs.s) END, {DIGITS}) AS mean FROM b JOIN rs ON rs.region = b.region AND rs.i BETWEEN b.lo AND b.hi GROUP BY ALL""",
    "interpolate_diagonals": f"""{_FM}, p0 AS (SELECT region, j - i AS d, avg(v) AS v FROM fm GROUP BY ALL), ps AS ({_fill_sql('p0', 'region', 'd', 'v')}),
z AS (SELECT *, j - i AS d FROM fm), y AS ({_fill_sql('z', 'region, d', 'i', 'v')})
SELECT y.region, y.i, y.j, round(coalesce(y.v, ps.v), {DIGITS}) AS v FROM y JOIN ps ON ps.region = y.region AND ps.d = y.d""",
    "ice_3iter": _ice_sql(3),
    "interpolate_smoothed": f"{_FM}, {_interpolated_sql('o', 'fm', _GROWING)} SELECT region, i, j, round(v, {DIGITS}) AS v FROM o",
    "region_balance_fixed": f"""{_FM}, {_BALANCE},
em AS (SELECT region, count(v) > 0 AS has_cells FROM k4 GROUP BY region)
SELECT region, i, j, round(v, {DIGITS}) AS v, CASE WHEN has_cells THEN 'not converged' ELSE 'empty' END AS state FROM w3 JOIN em USING (region)""",
    "smooth_diagonals": f"""{_FM}, {_full_sql('f2', 'fm')}, z AS (SELECT *, max(j) OVER (PARTITION BY region) + 1 AS n, 0.05 * sqrt(greatest(1, j - i - 2)) AS g FROM fm),
y AS (SELECT *, CAST(floor(4 * g + 0.5) AS BIGINT) AS r FROM z WHERE v IS NOT NULL), x AS (SELECT *, unnest(range(-r, r + 1)) AS a FROM y), t AS (SELECT *, unnest(range(-r, r + 1)) AS c FROM x),
q AS (SELECT region, i, j, exp(-0.5 * (a * a + c * c) / (g * g)) AS w, {_MIRROR.format('i + a')} AS p, {_MIRROR.format('j + c')} AS q FROM t),
o AS (SELECT q.region, q.i, q.j, sum(w * f2.v) / sum(w) AS v FROM q JOIN f2 ON f2.region = q.region AND f2.i = q.p AND f2.j = q.q WHERE f2.v IS NOT NULL GROUP BY ALL)
SELECT fm.region, fm.i, fm.j, round(o.v, {DIGITS}) AS v FROM fm LEFT JOIN o USING (region, i, j)""",
    "density_peaks": f"""{_M}, {_ROWS}, z AS (SELECT region, i, -log2(s + 1) AS s FROM rs), x AS MATERIALIZED ({_smooth_sql('z', 's', False, 2.0)}),
g AS (SELECT *, sum(CASE WHEN s = before THEN 0 ELSE 1 END) OVER (PARTITION BY region ORDER BY i) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY region ORDER BY i) AS before FROM x)),
u AS (SELECT region, run, any_value(s) AS s, min(i) AS a, max(i) AS b FROM g GROUP BY region, run),
t AS (SELECT * FROM (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r FROM u WINDOW w AS (PARTITION BY region ORDER BY run)) WHERE l < s AND r < s),
e AS (SELECT t.*, (SELECT max(i) FROM x WHERE x.region = t.region AND x.i < t.a AND x.s > t.s) AS lo, (SELECT min(i) FROM x WHERE x.region = t.region AND x.i > t.b AND x.s > t.s) AS hi FROM t),
f AS (SELECT e.*, (SELECT min(s) FROM x WHERE x.region = e.region AND x.i <= e.a AND x.i > coalesce(e.lo, -1)) AS fl,
 (SELECT min(s) FROM x WHERE x.region = e.region AND x.i >= e.b AND x.i < coalesce(e.hi, 1000000000)) AS fr FROM e)
SELECT region, CAST((a + b) // 2 AS BIGINT) AS i, round(s - greatest(fl, fr), {DIGITS}) AS prominence FROM f WHERE s - greatest(fl, fr) >= 0.4""",
    "map_compare_smoothed": f"""{_TWO}, {_full_sql('fa', 'ma')}, {_full_sql('fb', 'mb')},
ga AS MATERIALIZED ({_mirrored_taps('fa', 'i', 'j', 'v', _TAPS)}), gb AS MATERIALIZED ({_mirrored_taps('fb', 'i', 'j', 'v', _TAPS)}),
ha AS ({_mirrored_taps('ga', 'j', 'i', 'v', _TAPS)}), hb AS ({_mirrored_taps('gb', 'j', 'i', 'v', _TAPS)})
SELECT region, i, j, round({_RATIO}, {DIGITS}) AS v FROM ma a JOIN mb b USING (region, i, j) WHERE i < j
UNION ALL SELECT region, j, i, round({_RATIO}, {DIGITS}) FROM ha a JOIN hb b USING (region, i, j) WHERE i <= j""",
    "coarsen_sum": f"""{_FM}, {_full_sql('f2', 'fm')}, sz AS (SELECT region, (max(j) + 1) // 5 AS n FROM fm GROUP BY 1)
SELECT region, i // 5 AS i, j // 5 AS j, coalesce(sum(v), 0) AS v FROM f2 JOIN sz USING (region) WHERE i // 5 <= j // 5 AND i // 5 < n AND j // 5 < n GROUP BY 1, 2, 3""",
    "coarsen_multiscale": _multiscale_sql(4, 4),
    "batch_factors": f"{_TWO}{_FACTORS} SELECT region, d, round(factor, {DIGITS}) AS factor, round(global_factor, {DIGITS}) AS global_factor FROM bf",
    "batch_apply": f"""{_TWO}{_FACTORS} SELECT ma.region, i, j, round(v * g.global_factor * CASE WHEN bf.d IS NULL THEN 1 ELSE coalesce(factor, 1) END, {DIGITS}) AS v
FROM ma LEFT JOIN (SELECT region, max(global_factor) AS global_factor FROM bf GROUP BY 1) g USING (region) LEFT JOIN bf ON bf.region = ma.region AND bf.d = ma.j - ma.i""",
    "map_log_ratio": f"""{_TWO} SELECT region, i, j, round(CASE WHEN ma.v = 0 AND mb.v = 0 THEN NULL WHEN mb.v = 0 THEN CAST('inf' AS DOUBLE) WHEN ma.v = 0 THEN CAST('-inf' AS DOUBLE)
 ELSE log2(ma.v / mb.v) END, {DIGITS}) AS v FROM ma JOIN mb USING (region, i, j)""",
    "map_merge": f"{_TWO} SELECT * FROM ma UNION ALL SELECT region, j, i, v FROM mb WHERE i < j",
    "map_select": _M + "\nSELECT region, i - 10 AS i, j - 10 AS j, v FROM m WHERE i >= 10 AND j < 40",
    "map_rotated": _M + f"\nSELECT region, i, j, CAST({RES} * (i + j + 1) / 2.0 AS DOUBLE) AS x, {RES} * (j - i) AS y, v FROM m",
}
_CR = "cr AS (" + ORACLE["capture_rates"].replace(f"round(CAST(coalesce(rate, 0) AS DOUBLE), {DIGITS})", "CAST(coalesce(rate, 0) AS DOUBLE)") + ")"
_FB, _FPX = "WITH " + _bins_sql("bins", FINE), "WITH " + _bins_sql("bins", FINE) + ",\n" + _px_sql("px", res=FINE)
ORACLE |= {
    "fine_counts": f"{_FPX} SELECT * FROM px",
    "fine_zoom": _FB + ",\n" + _bins_sql("cb", FINE * ZOOM) + ",\n" + _px_sql("px", bins="cb", res=FINE * ZOOM) + " SELECT * FROM px",
    "fine_without_inward": f"""{_FPX}, {_px_sql('pi', "strand1 = '+' AND strand2 = '-'", res=FINE)}
SELECT px.bin1_id, px.bin2_id, CAST(CASE WHEN a.chrom = b.chrom AND b.i - a.i <= 2 THEN floor(4 * (px.count - coalesce(pi.count, 0)) / 3.0) ELSE px.count END AS BIGINT) AS count
FROM px LEFT JOIN pi USING (bin1_id, bin2_id) JOIN bins a ON a.bin_id = px.bin1_id JOIN bins b ON b.bin_id = px.bin2_id""",
    "fine_distance_average": f"""{_FPX}, t AS (SELECT a.chrom, b.i - a.i AS d, sum(count) AS s FROM px JOIN bins a ON a.bin_id = bin1_id JOIN bins b ON b.bin_id = bin2_id WHERE a.chrom = b.chrom GROUP BY ALL)
SELECT bins.chrom, bins.i AS d, round(coalesce(s, 0) / CAST(n - bins.i AS DOUBLE), {DIGITS}) AS v FROM bins JOIN bins_sz USING (chrom) LEFT JOIN t ON t.chrom = bins.chrom AND t.d = bins.i""",
    "fine_neighbor_factors": f"{_FPX}, {_DIAG}, {_SIDES} SELECT chrom, i, round(avg(v), {DIGITS}) AS nf FROM sd GROUP BY ALL",
    "map_filter_all": f"""{_M}, {_MAD}, {_CR},
g0 AS (SELECT ff.region, ff.i, ff.j, CASE WHEN low.i IS NULL THEN v END AS v FROM ff LEFT JOIN low ON low.region = ff.region AND low.i = ff.i),
g AS (SELECT g0.region, g0.i, g0.j, CASE WHEN a.rate + b.rate >= {RATE} THEN v END AS v FROM g0 JOIN cr a ON a.region = g0.region AND a.i = g0.i JOIN cr b ON b.region = g0.region AND b.i = g0.j),
{_nnz('g')} {_TRI.format('g')}""",
    "gaussian_interp": f"""{_M}, {_ROWS}, z AS (SELECT region, i, CASE WHEN s > 3 THEN s END AS s FROM rs), x AS ({_smooth_sql('z', 's', False, 1.0, 100.0)}), y AS ({_fill_sql('x', 'region', 'i', 's')})
SELECT region, i, round(s, {DIGITS}) AS s FROM y""",
}
ORACLE["capture_filter"] = (
    _M + ", cr AS (" + ORACLE["capture_rates"].replace(f"round(CAST(coalesce(rate, 0) AS DOUBLE), {DIGITS})", "CAST(coalesce(rate, 0) AS DOUBLE)") + f""")
SELECT m.region, count(*) AS cells, count(CASE WHEN a.rate + b.rate >= {RATE} THEN v END) AS kept, sum(CASE WHEN a.rate + b.rate >= {RATE} THEN v END) AS s
FROM m JOIN cr a ON a.region = m.region AND a.i = m.i JOIN cr b ON b.region = m.region AND b.i = m.j GROUP BY m.region"""
)
