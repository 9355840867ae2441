import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmap.common import staged
from weftmap.operators import balance as B
from weftmap.operators import maps as M

N = None


def decaying(*masked, n=5):
    """A small map that decays from its diagonal, some of its cells masked on both sides of it."""
    near = [1.0, 14.0, 9.0, 6.0, 3.0, 2.0]
    hidden = {frozenset(c) for c in masked}
    return [[N if frozenset((i, j)) in hidden else near[abs(i - j)] + (i * j) % 4 for j in range(n)] for i in range(n)]


MAPS = {
    "whole": decaying(),
    "hole": decaying((1, 3)),
    "row": decaying(*((3, j) for j in range(5))),
    "diagonal": decaying(*((i, i + 2) for i in range(3))),
    "corner": decaying((0, 4)),
    "six": decaying((0, 1), (2, 4), (2, 5), n=6),
}


def frame(spark, **maps):
    rows = [(r, i, j, None if m[i][j] is None else float(m[i][j])) for r, m in maps.items() for i in range(len(m)) for j in range(i, len(m))]
    return spark.createDataFrame(rows, "region string, i long, j long, v double")


def vector(df, v, key="region"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], {})[r["i"]] = r[v]
    return {k: [x[i] for i in sorted(x)] for k, x in out.items()}


def matrix(df, region=None):
    rows = [r for r in df.collect() if region in (None, r.region)]
    n = max(max(r.i, r.j) for r in rows) + 1
    m = np.full((n, n), np.nan)
    for r in rows:
        m[r.i, r.j] = m[r.j, r.i] = np.nan if r.v is None else r.v
    return m


def array(m):
    return np.array([[np.nan if x is None else x for x in row] for row in m], float)


def line(spark, *xs):
    return spark.createDataFrame([("a", i, None if x is None else float(x)) for i, x in enumerate(xs)], "region string, i long, v double")


def test_marginals(spark):
    m = frame(spark, **MAPS)
    for k in (1, 2):
        got = vector(M.marginal(m, k), "s")
        for name, rows in MAPS.items():
            assert got[name] == pytest.approx(brute.row_sums(rows, k=k))
    assert vector(M.marginal(frame(spark, a=[[9, 1, 2], [1, 9, N], [2, N, 9]]), 1), "s") == {"a": [3, 1, 2]}


def test_flanks_agree_and_are_documented(spark):
    m = frame(spark, **MAPS)
    got = vector(M.marginal(m, 1, flanks=True), "s")
    for name, rows in MAPS.items():
        assert got[name] == pytest.approx(brute.row_sums(rows, True))
    unit = frame(spark, u=[[1.0] * 5 for _ in range(5)])
    extra = [x - 4 for x in vector(M.marginal(unit, 1, True), "s")["u"]]
    assert extra == [4 + 0, 3 + 0, 2 + 1, 1 + 2, 0 + 3]
    assert [x - 4 for x in vector(M.marginal(unit, 1, True, documented=True), "s")["u"]] == [4, 4, 4, 4, 4]


def test_gap_fill(spark):
    def filled(*xs, sigma=0):
        df = line(spark, *xs)
        if sigma:
            df = df.join(M.gaussian(df, ["region"], "i", "v", sigma).withColumnRenamed("v", "anchor"), ["region", "i"])
        out = vector(M.fill_gaps(df, ["region"], "i", "v", "anchor" if sigma else None), "v")["a"]
        assert out == pytest.approx(brute.filled(list(xs), sigma))
        return out

    assert filled(5, N, N, 11) == [5, 7, 9, 11]
    filled(7, 4, N, N, N, 1, 1, N, 6)
    filled(7, 4, N, N, N, 1, 1, N, 6, sigma=1.5)
    assert filled(N, N, 2, N, 8, N) == [2, 2, 2, 5, 8, 8]
    assert vector(M.fill_gaps(line(spark, N, N), ["region"], "i", "v"), "v")["a"] == [None, None]


def test_gaussian_mirrors_short_vectors(spark):
    for n in (1, 2, 3, 5, 9):
        xs = [float((7 * i) % 5 + 1) for i in range(n)]
        w, r = M.gaussian_weights(1.5), 6
        assert len(w) == 2 * r + 1 and sum(w) == pytest.approx(1)

        def at(p):
            p %= 2 * n
            return xs[p if p < n else 2 * n - 1 - p]

        want = [sum(w[k + r] * at(i + k) for k in range(-r, r + 1)) for i in range(n)]
        assert brute.smoothed(xs, 1.5) == pytest.approx(want)
        assert vector(M.gaussian(line(spark, *xs), ["region"], "i", "v", 1.5), "v")["a"] == pytest.approx(want)
    assert vector(M.gaussian(line(spark, 1, N, 3, *[1] * 12), ["region"], "i", "v", 1.0, "spread"), "v")["a"][:6] == [None] * 6
    masked = vector(M.gaussian(line(spark, 5, N, 5, 5), ["region"], "i", "v", 1.0), "v")["a"]
    assert masked[1] is None and [masked[i] for i in (0, 2, 3)] == pytest.approx([5, 5, 5])
    assert None not in vector(M.gaussian(line(spark, 5, N, 5, 5), ["region"], "i", "v", 1.0, "interp"), "v")["a"]


def test_neighbor_factors(spark):
    d = line(spark, 1, 2, 3, 4)

    def nf(df, avg="arithmetic", **kw):
        return vector(M.neighbor_factors(df, ["region"], avg, **kw), "nf")["a"]

    assert nf(d, "harmonic") == pytest.approx([1, 4 / 3, 12 / 5, 24 / 7, 4])
    assert nf(line(spark, 1, N)) == [1, 1, None]
    assert nf(d) == [1, 1.5, 2.5, 3.5, 4]
    assert nf(d, "geometric") == pytest.approx([1, math.sqrt(2), math.sqrt(6), math.sqrt(12), 4])
    assert nf(line(spark, 4, N), "geometric") == [4, 4, None]
    assert nf(d, "mse") == pytest.approx([1, 5 / 3, 13 / 5, 25 / 7, 4])
    assert nf(line(spark, 0, 2), "harmonic") == [0, 0, 2]
    assert nf(line(spark, 1, 100), eps=0.5) == pytest.approx([25.25, (25.25 + 100) / 2, 100])
    assert nf(d, main=line(spark, 9, 9, 9, 9, 9)) == pytest.approx([5, 4, 14 / 3, 16 / 3, 6.5])
    with pytest.raises(ValueError):
        M.neighbor_factors(d, ["region"], "median")


def store(spark, full, sizes=(("a", 5),)):
    bins = M.make_bins(spark.createDataFrame(list(sizes), "chrom string, size long"), 1)
    n = len(full)
    px = [(i, j, full[i][j]) for i in range(n) for j in range(i, n) if full[i][j]]
    return bins, spark.createDataFrame(px, "bin1_id long, bin2_id long, count long")


def test_remove_inward(spark):
    ones = [[1] * 5 for _ in range(5)]
    bins, full = store(spark, ones)

    def run(f, i, b, k=2, **kw):
        return {(r[0], r[1]): r[2] for r in M.remove_inward(f, i, b, 1, k, **kw).collect()}

    def diagonals(px):
        return [sum(v for (i, j), v in px.items() if j - i == d) for d in range(5)]

    assert diagonals(run(full, full, bins)) == [0, 0, 0, 2, 1]
    inward = [[1] * 5 for _ in range(5)]
    inward[0][1] = 0
    _, f4 = store(spark, [[4] * 5 for _ in range(5)])
    _, i1 = store(spark, inward)
    got = run(f4, i1, bins)
    assert (got[0, 0], got[0, 1], got[1, 2], got[0, 2]) == (4, 5, 4, 4) and all(v == 4 for (i, j), v in got.items() if j >= i + 2)
    two, ones2 = store(spark, ones, (("a", 2), ("b", 3)))
    assert diagonals(run(ones2, ones2, two)) == [0, 1, 2, 2, 1]
    _, five = store(spark, [[5] * 5 for _ in range(5)])
    assert run(full, five, bins)[0, 0] == math.floor(4 * -4 / 3)  # floors below zero
    assert run(f4, i1, bins, documented=True)[0, 3] == 5
    M.check_same_bins(bins, bins)
    with pytest.raises(ValueError):
        M.check_same_bins(bins, two)
    with pytest.raises(ValueError):
        M.remove_inward(full, full, bins, 1, -1)


def test_zoom_and_merge(spark):
    sizes = (("a", 5), ("b", 3))
    bins, px = store(spark, [[1] * 8 for _ in range(8)], sizes)
    coarse = M.make_bins(spark.createDataFrame(list(sizes), "chrom string, size long"), 2)
    got = {(r[0], r[1]): r[2] for r in M.zoom_pixels(px, bins, coarse, 2).collect()}
    assert coarse.count() == 5 and got[0, 0] == 3 and got[0, 1] == 4 and got[2, 2] == 1 and got[2, 3] == 2 and sum(got.values()) == 36
    assert {r[2] for r in M.merge_pixels(px, px, px).collect()} == {3}
    assert [r.end for r in bins.orderBy("bin_id").collect()] == [1, 2, 3, 4, 5, 1, 2, 3]


def ones(n, value, *at):
    m = [[1.0] * n for _ in range(n)]
    for a in at:
        for k in range(n):
            m[a][k] = m[k][a] = value
    return m


def test_filters(spark):
    m = frame(spark, zero=ones(40, 0.0, 10), low=ones(40, 0.1, 10))
    for kw in ({"mad_max": 0, "min_nnz": 10}, {"mad_max": 5, "min_nnz": 10}):
        got = matrix(M.filter_map(m, None, min_pair_rate=0, **kw), "zero")
        assert np.isnan(got[10]).all() and np.isnan(got[:, 10]).all() and not np.isnan(np.delete(np.delete(got, 10, 0), 10, 1)).any()
    assert np.isnan(matrix(M.filter_map(m, None, 5, 10, 0), "low")[10]).all()
    assert not np.isnan(matrix(M.filter_map(m, None, 0, 10, 0), "low")).any()
    rates = spark.createDataFrame([("low", i, 0.0 if i in (10, 20) else 0.15) for i in range(40)], "region string, i long, rate double")
    got = matrix(M.filter_map(m.where("region = 'low'"), rates, 0, 0, 0.1))
    assert {tuple(map(int, x)) for x in np.argwhere(np.isnan(got))} == {(a, b) for a in (10, 20) for b in (10, 20)}
    assert np.isnan(matrix(M.filter_map(m.where("region = 'low'"), rates, 0, 35, 0.2))[10]).all()
    # Half of the rows empty: the depth filter masks nothing.
    half = frame(spark, h=[[1.0 if i < 2 and j < 2 else 0.0 for j in range(4)] for i in range(4)])
    assert M.mad_mask(half).count() == 0
    assert {r.i for r in M.invalid_rows(half).collect()} == {2, 3}


def test_capture_rates(spark):
    probes = spark.createDataFrame([("c", 90, 110), ("c", 100, 150), ("c", 340, 500), ("c", 0, 1000), ("d", 100, 200), ("c", 130, 130)], "chrom string, start long, end long")
    regions = spark.createDataFrame([("r", "c", 100, 400)], "region string, chrom string, start long, end long")
    assert vector(M.capture_rates(probes, regions, 100), "rate")["r"] == pytest.approx([0.6, 0, 0.6])
    assert vector(M.capture_rates(probes, regions, 100, documented=True), "rate")["r"] == pytest.approx([1.6, 1, 1.6])


def test_balancing_agrees(spark):
    """Cells, biases and rounds against lists of numbers, with masks kept or filled."""
    m = frame(spark, **MAPS)
    for how, same in (({}, {}), ({"flanks": True}, {"flanks": True}), ({"interpolate": True, "sigma": 1.0}, {"sigma": 1.0})):
        cells, biases = (staged(x) for x in B.balance_map(m, 2, 1e-5, **how))
        bias = vector(biases, "bias")
        for name, rows in MAPS.items():
            want, b = brute.balanced(rows, 2, 1e-5, **same)
            assert bias[name] == pytest.approx(b)
            assert np.allclose(matrix(cells, name), array(want), equal_nan=True)
            assert (np.isnan(matrix(cells, name)) == (np.isnan(array(rows)) & ("sigma" not in same))).all()


def test_balanced_rows_are_even(spark):
    names = ["whole", "hole"]
    cells, biases = B.balance_map(frame(spark, **{k: MAPS[k] for k in names}), 12, 1e-3)
    assert biases.where("NOT done").isEmpty()
    # A masked row's sum is 0 and counts in the variance: such a region is done only when interpolated.
    assert {r.done for r in B.balance_map(frame(spark, row=MAPS["row"]), 2)[1].collect()} == {False}
    for name in names:
        s = [x for x in brute.row_sums([[None if np.isnan(x) else x for x in row] for row in matrix(cells, name)]) if x]
        assert np.std(s) < 0.01 * np.mean(s)


def test_region_balance(spark):
    """All regions come out: balanced and complete, or marked."""
    gone = [[N] * 4 for _ in range(4)]
    zero = decaying(n=6)
    for k in range(6):
        zero[2][k] = zero[k][2] = 0.0
    zero[4] = [N if x != 2 else 0.0 for x in range(6)]  # masked but for its cell with the empty row
    for k in range(6):
        zero[k][4] = zero[4][k]
    m = frame(spark, **MAPS, gone=gone, zero=zero)
    got = staged(B.balance_regions(m, 3, 1e9))
    states = {r.region: r.state for r in got.select("region", "state").distinct().collect()}
    assert states == {**dict.fromkeys([*MAPS, "zero"], "balanced"), "gone": "empty"}
    assert got.where("region = 'gone' AND v IS NOT NULL").isEmpty() and got.where("region <> 'gone' AND v IS NULL").isEmpty()
    for name, rows in MAPS.items():
        want = brute.balanced(rows, 3, 1e9, flanks=True)[0]
        want = brute.balanced(want, 3, 1e9, lambda d: 2.0 * max(1, d - 2) ** 0.2, True)[0]
        want = brute.balanced(want, 3, 1e9, flanks=True)[0]
        assert np.allclose(matrix(got.drop("state"), name), array(want))
    few = B.balance_regions(m.where("region = 'six'"), 1, 0.0)
    assert {r.state for r in few.collect()} == {"not converged"}
    with pytest.raises(ValueError):
        B.balance_regions(m.where("region = 'zero'"), strict=True)
    assert B.balance_regions(m.limit(0), 1).isEmpty()


def test_both_ways_of_balancing_agree(spark):
    bins, px = store(spark, [[0, 10, 5, 3, 2], [0, 0, 10, 5, 3], [0, 0, 0, 10, 6], [0, 0, 0, 0, 10], [0] * 5])
    bias = bins.select("bin_id", F.lit(1.0).alias("bias"))
    for _ in range(5):
        bias = staged(M.ice_step(px, bias))
    _, want = B.balance_map(M.cis_map(px, bins), max_iter=5, tol=0)
    assert [r.bias for r in bias.orderBy("bin_id").collect()] == pytest.approx(vector(want, "bias")["a"])


def test_interpolation_agrees(spark):
    m = frame(spark, **MAPS)
    for sigma, same in ((0.0, 0.0), (1.0, 1.0), (B.growing_width(), lambda d: 2.0 * max(1, d - 2) ** 0.2)):
        got = M.interpolate_diagonals(m, sigma)
        for name, rows in MAPS.items():
            assert np.allclose(matrix(got, name), array(brute.filled_map(rows, same)))


def test_neighbor_normalization(spark):
    rnd = np.random.default_rng(1)
    a = rnd.uniform(1, 9, (12, 12))
    a = a + a.T
    got = matrix(M.normalize_neighbor(frame(spark, r=a.tolist())))
    d = np.diagonal(a, 1).copy()
    d = np.clip(d, d.mean() * 0.1, d.mean() / 0.1)
    nf = np.array([d[0], *((d[1:] + d[:-1]) / 2), d[-1]])
    nf = np.array(brute.smoothed(nf.tolist(), 1.0))
    want = a / np.sqrt(np.outer(nf, nf))
    want = np.minimum(want / np.diagonal(want, 1).mean(), 10)
    assert np.allclose(got, want) and np.diagonal(got, 1).mean() == pytest.approx(1)


def test_coarsening(spark):
    n = 7
    a = np.arange(n * n, dtype=float).reshape(n, n)
    a = a + a.T
    got = matrix(M.coarsen_map(frame(spark, r=a.tolist()), 3))
    assert np.allclose(got, a[:6, :6].reshape(2, 3, 2, 3).sum((1, 3)))
    n, base = 70, 4
    rnd = np.random.default_rng(2)
    a = rnd.uniform(0, 1, (n, n))
    a = a + a.T
    want = a.copy()
    for k in (1, 2, 3):
        f = 2**k
        if k < math.ceil(math.log(n) / math.log(base)):
            for i in range(0, n - base**k, f):
                for j in range(i + base**k, min(i + base ** (k + 1), n), f):
                    want[i : i + f, j : j + f] = a[i : i + f, j : j + f].mean()
    want = np.triu(want) + np.triu(want, 1).T
    assert np.allclose(matrix(M.coarsen_by_distance(frame(spark, r=a.tolist()), base=base)), want)


def test_distance_smoothing(spark):
    rnd = np.random.default_rng(3)
    n = 9
    a = rnd.uniform(1, 2, (n, n))
    a = a + a.T
    a[2, 5] = a[5, 2] = a[0, 0] = np.nan
    m = frame(spark, r=[[N if np.isnan(x) else x for x in row] for row in a.tolist()])
    for sigma, width in ((1.0, lambda d: 1.0), (B.growing_width(0.5, 0.5, 2), lambda d: 0.5 * max(1, d - 2) ** 0.5)):
        got = matrix(B.smooth_by_distance(m, sigma))
        for i in range(n):
            for j in range(i, n):
                s = width(j - i)
                r = int(4 * s + 0.5)
                taps = [
                    (math.exp(-0.5 * (p * p + q * q) / s**2), a[brute.mirrored(i + p, n), brute.mirrored(j + q, n)]) for p in range(-r, r + 1) for q in range(-r, r + 1)
                ]
                want = sum(w * x for w, x in taps if x == x) / sum(w for w, x in taps if x == x)
                assert got[i, j] == pytest.approx(want) if a[i, j] == a[i, j] else np.isnan(got[i, j])
    assert np.allclose(matrix(B.smooth_by_distance(m)), a, equal_nan=True)  # a width this small changes nothing
    assert not np.isnan(matrix(B.smooth_by_distance(m, 1.0, interpolate=True))).any()


def test_compare_smoothed(spark):
    rnd = np.random.default_rng(9)
    a, b = ((lambda x: x + x.T)(rnd.uniform(1, 2, (6, 6))) for _ in range(2))
    both = lambda x: np.array([brute.smoothed(c, 1.0) for c in np.array([brute.smoothed(r, 1.0) for r in x.tolist()]).T.tolist()]).T
    cells = {(r.i, r.j): r.v for r in M.compared(frame(spark, x=a.tolist()), frame(spark, x=b.tolist()), 1.0).collect()}
    assert len(cells) == 36
    plain, smooth = np.log2(a / b), np.log2(both(a) / both(b))
    assert all(v == pytest.approx((plain if i < j else smooth)[i, j]) for (i, j), v in cells.items())


def test_peaks(spark):
    rnd = np.random.default_rng(6)
    vectors = {"flat": [0, 1, 3, 3, 1, 2, 1, 5, 0.0], "even": [1.0] * 5, "one": [4.0], "up": [1.0, 2.0, 3.0]}
    vectors |= {f"r{k}": rnd.integers(0, 6, int(rnd.integers(2, 70))).astype(float).tolist() for k in range(12)}
    rows = [(k, i, float(x)) for k, xs in vectors.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "region string, i long, s double")
    for least in (0.5, 2.0):
        got = {}
        for r in B.local_peaks(df, ["region"], "i", "s", least).collect():
            got.setdefault(r.region, []).append((r.i, r.prominence))
        assert {k: sorted(v) for k, v in got.items()} == {k: p for k, xs in vectors.items() if (p := brute.peaks(xs, least))}
    assert B.local_peaks(df.limit(0), ["region"], "i", "s", 0.1).isEmpty()
    assert set(B.call_peaks(df.where("region = 'even'"), 2).collect()) == set()


def test_batch_and_compare(spark):
    rnd = np.random.default_rng(4)
    a, b = (lambda x: x + x.T)(rnd.uniform(1, 2, (8, 8))), (lambda x: x + x.T)(rnd.uniform(1, 2, (8, 8)))
    q, r = frame(spark, x=a.tolist(), y=b.tolist()), frame(spark, x=b.tolist(), y=b.tolist())
    f = M.batch_factors(q, r, 3)
    rows = {(x.region, x.d): x for x in f.collect()}
    assert set(k[0] for k in rows) == {"x", "y", "merged"} and rows["y", 0].factor == pytest.approx(1)
    report = {x.region: x for x in M.factor_report(f).collect()}
    assert report["y"].global_factor == "1.000" and report["y"].factors == "1.000,1.000,1.000"
    fixed = matrix(M.apply_batch_factors(q, f), "x")
    for d in range(4):
        assert np.diagonal(fixed, d).mean() == pytest.approx(np.diagonal(b, d).mean())
    assert np.allclose(matrix(M.log_ratio(q, r), "x"), np.log2(a / b))
    cells = {(c.i, c.j): c.v for c in M.merged_map(q, r).where("region = 'x'").collect()}
    assert len(cells) == 64 and cells[1, 5] == a[1, 5] and cells[5, 1] == b[1, 5]
    part = matrix(M.select_region(q, 2, 6), "x")
    assert np.allclose(part, a[2:6, 2:6])


def test_sliding_mean(spark):
    xs = [float(x * x % 7) for x in range(11)]
    want = [np.mean(xs[: 2 * i + 1]) if i <= 3 else np.mean(xs[max(i - 3, 0) : i + 4]) for i in range(11)]
    assert vector(M.sliding_mean(line(spark, *xs), ["region"], "i", "v", 3), "mean")["a"] == pytest.approx(want)


def test_neighbor_weights(spark):
    nf = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 3.0, None, None, 5.0])] + [("b", 0, 1000.0)], "chrom string, i long, nf double")
    bins = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("a", 2, None), ("b", 0, 1.0)], "chrom string, i long, weight double")
    got = {(r.chrom, r.i): r.weight_neighbor for r in M.neighbor_weights(nf, bins, 200, 400).collect()}
    mid = np.median([2, 3, 5, 1000])
    assert got["a", 0] == pytest.approx(1 / math.sqrt(2)) and got["a", 1] == pytest.approx(1 / math.sqrt(3))
    assert got["a", 2] is None and got["b", 0] == pytest.approx(1 / math.sqrt(10 * mid))
    with pytest.raises(ValueError):
        M.neighbor_weights(nf, bins, 200, 500)


def test_neighbor_weights_without_neighbors(spark):
    """Where most bins have no neighbours, the median and the clipped factors are 0 and weights infinite; a missing weight stays missing."""
    nf = spark.createDataFrame([("c", i, 4.0 if i == 0 else 0.0) for i in range(6)], "chrom string, i long, nf double")
    bins = spark.createDataFrame([("c", i, None if i == 2 else 1.0) for i in range(3)], "chrom string, i long, weight double")
    got = {r.i: r.weight_neighbor for r in M.neighbor_weights(nf, bins, 200, 400).collect()}
    assert got == {0: math.inf, 1: math.inf, 2: None}


def test_balance_pixels(spark):
    """Bin filter, rounds until the variance is small, and weights of all resolutions of a zoomed store, beside numpy."""
    import tempfile
    import warnings

    from weftmap import api, cli
    from weftmap.sources import text as S

    rnd = np.random.default_rng(3)
    n = 24
    m = rnd.poisson(30 * np.outer(*[rnd.uniform(0.5, 2, n)] * 2)) + 1
    m = np.triu(m) + np.triu(m, 1).T
    m[5] = m[:, 5] = 0
    m[5, 6] = m[6, 5] = 400  # too few cells
    m[9] = m[:, 9] = m[9] > 0  # 1 a cell: too low

    def weights(m):
        nnz, s = (m > 0).sum(axis=1), m.sum(axis=1)
        half = len(m) * 2 // 3
        rel = s / np.repeat([np.median(s[:half]), np.median(s[half:])], [half, len(m) - half])
        l = np.log(rel)
        good = (nnz >= 6) & (l >= np.median(l) - 5 * np.median(abs(l - np.median(l))))
        w = np.where(good, 1.0, 0.0)
        while True:
            s = (m * np.outer(w, w)).sum(axis=1)
            mean, var = s[good].mean(), s[good].var()
            w = np.where(good, w / np.where(good, s / mean, 1), 0)
            if var < 1e-5:
                return np.where(good, w / np.sqrt(mean), np.nan)

    px = spark.createDataFrame([(i, j, int(m[i, j])) for i in range(n) for j in range(i, n) if m[i, j]], "bin1_id long, bin2_id long, count long")
    bins = M.make_bins(spark.createDataFrame([("a", 3200), ("b", 1600)], "chrom string, size long"), 200)
    done = M.balance_pixels(px, bins, ignore_diags=0, min_nnz=6)
    got = np.array([np.nan if r.weight is None else r.weight for r in done.weights.orderBy("bin_id").collect()])
    assert done.converged and done.variance < 1e-5 and done.rounds > 3 and np.isnan(got[[5, 9]]).all() and np.isnan(got).sum() == 2
    np.testing.assert_allclose(got, weights(m), rtol=1e-6)
    w = np.nan_to_num(got)
    assert (m * np.outer(w, w)).sum(axis=1)[~np.isnan(got)] == pytest.approx(1, abs=1e-4)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        few = M.balance_pixels(px, bins, ignore_diags=0, max_iter=2)
        none = M.balance_pixels(px.limit(0), bins)
    assert not few.converged and few.rounds == 2 and not none.converged and none.weights.where("weight IS NULL").count() == n
    assert sum("did not converge" in str(x.message) for x in said) == 2

    path = tempfile.mkdtemp(prefix="spark-") + "/store"
    api.save_store(bins, px, path, 200)
    cli.main(["zoomify", path, "--resolutions", "400", "--min-nnz", "6"], spark)
    assert S.resolutions(spark, f"{path}/bins") == [200, 400]
    up = m.astype(float).reshape(n // 2, 2, n // 2, 2).sum(axis=(1, 3))
    up[np.diag_indices(n // 2)] = [np.triu(m[a : a + 2, a : a + 2]).sum() for a in range(0, n, 2)]  # a pixel of the diagonal counts once
    for r, want in ((200, weights(m)), (400, weights(up))):
        got = [np.nan if x.weight is None else x.weight for x in S.read_store(spark, f"{path}/bins", r).orderBy("bin_id").collect()]
        np.testing.assert_allclose(got, want, rtol=1e-6)
    assert api.add_neighbor_weights(spark, path, 200) == [200, 400]
    assert api.ContactMap.from_store(spark, path, 400, "b:0-1600").cells.where("v > 0").count() > 0
