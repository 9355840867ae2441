import math
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftmap.operators.impute import _with_cells, impute_pmm
from weftmap.operators.intervals import periods_and_gaps
from weftmap.operators.rawlines import parse_batch, parse_pairs_lines, rejects, valid_records
from weftmap.operators.salted import salted_aggregate

IV = "k string, s long, e long, kind string, rank long, from_pos string"


def run_intervals(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], IV)  # extra columns with the operator's own names
    return Counter(map(tuple, periods_and_gaps(df, ["k"], "s", "e", **kw).collect()))


def test_intervals_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(f"k{min(rnd.randrange(6), 3)}", s := rnd.randrange(-300, 3000), s + rnd.choice([-3, 0, 1, 5, 40, 200])) for _ in range(600)]
    rows += [(None, 1, 5), ("n", None, 5), ("n", 3, None), ("tie", 5, 9), ("tie", 5, 9), ("tie", 9, 12), ("tie", 14, 20), ("tie", 13, 14)]
    want = Counter(brute.periods_and_gaps(rows))
    for width in (1, 7, 1 << 16):
        assert run_intervals(spark, rows, cell_width=width) == want
    assert run_intervals(spark, []) == Counter()


def test_salted_aggregate(spark):
    rnd = random.Random(5)
    rows = [("hot", 1, rnd.randrange(100))] * 700 + [(rnd.choice("abc"), rnd.randrange(50), rnd.randrange(100)) for _ in range(900)]
    rows += [(None, None, 3), (None, None, None), ("a", None, 7), ("a", 1, None)]
    df = spark.createDataFrame(rows, "k string, p long, slot long")
    v = F.col("slot")
    got = salted_aggregate(df, ["k", "p"], {"n": ("count", F.lit(1)), "nv": ("count", v), "s": ("sum", v), "lo": ("min", v),
                                            "hi": ("max", v), "k": ("avg", v)}, heavy_fraction=0.05, salts=5)
    assert got.columns == ["k", "p", "n", "nv", "s", "lo", "hi", "k_"]
    want = defaultdict(list)
    for k, p, x in rows:
        want[k, p].append(x)
    assert got.count() == len(want)
    for k, p, n, nv, s, lo, hi, avg in got.collect():
        xs = [x for x in want[k, p] if x is not None]
        assert (n, nv, s, lo, hi) == (len(want[k, p]), len(xs), sum(xs) if xs else None, min(xs, default=None), max(xs, default=None))
        assert avg == (pytest.approx(sum(xs) / len(xs)) if xs else None)
    assert salted_aggregate(df.limit(0), ["k"], {"n": ("count", F.lit(1))}).count() == 0


SIZES = {"chr1": 1000, "chr2": 50, '"q': 9}
GOOD = ["r1", "chr1", "10", "chr2", "50", "+", "-", "UU", 's"1\x19', 's"', "0", "60"]


def lines_strategy():
    field = st.one_of(
        st.sampled_from([*GOOD, ".", "!", "chr9", "0010", "51", "1" * 30, "", '"', '""', '"a', 'a"b', '"a\tb"', '"a""b"', '"""', "é", "uu", "-1", "+5"]),
        st.text(alphabet='"\ta1é', max_size=5),
    )
    free = st.lists(field, max_size=14).map("\t".join)
    near = st.tuples(st.integers(0, 11), field, st.booleans()).map(
        lambda x: "\t".join(('"' + v.replace('"', '""') + '"' if x[2] else v) if i != x[0] else x[1] for i, v in enumerate(GOOD))
    )
    return st.lists(st.one_of(free, near), max_size=30)


@settings(max_examples=300, deadline=None)
@given(lines_strategy())
def test_line_index_against_brute_force(lines):
    got = parse_batch(pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())).to_pydict()
    for i, line in enumerate(lines):
        want = brute.reason(line, SIZES)
        fields = brute.split_quoted(line)
        if want in ("quoting", "column_count"):
            assert got["reason"][i] == want and got["chrom1"][i] is None
        else:
            assert got["read_id"][i] == fields[0] and got["sam1"][i] == fields[8] and got["pair_type"][i] == fields[7]
            assert got["reason"][i] in (None, "bad_value")
            if want is None:
                assert got["reason"][i] is None


def quoted_last(field):
    return "\t".join([*GOOD[:11], f'"{field}"'])


@settings(max_examples=200, deadline=None)
@given(lines_strategy(), st.sampled_from(['ab""c', '""', 'a""', '"ab""c"', '""x']), st.randoms(use_true_random=False))
def test_lines_parse_alike_alone_and_in_any_batch(lines, read_id, rnd):
    lines = [*lines, quoted_last("60"), "\t".join([read_id, *GOOD[1:]]), quoted_last('6""0'), "\t".join([read_id, *GOOD[1:]])]
    rnd.shuffle(lines)

    def rows(lines):
        out = parse_batch(pa.array([0] * len(lines), pa.int64()), pa.array(lines, pa.string())).to_pydict()
        return list(zip(*out.values()))

    assert rows(lines) == [rows([x])[0] for x in lines]
    fields = [brute.split_quoted(x) for x in lines]
    assert all(r[1] == (f[0] if f and len(f) == 12 else None) for r, f in zip(rows(lines), fields))


def test_quotes_do_not_reach_the_next_line():
    lines = [quoted_last("60"), "\t".join(['ab""c', *GOOD[1:]])]
    for batch in (lines, lines[1:]):
        assert parse_batch(pa.array(range(len(batch)), pa.int64()), pa.array(batch, pa.string())).to_pydict()["read_id"][-1] == 'ab""c'


def test_parse_lines_with_chromosomes(spark):
    rnd = random.Random(11)
    lines = ["\t".join(GOOD), "", None, "#header", "#", "\t" * 11, "x" * 300_000, '"' + "y\t" * 20_000 + '"']
    for _ in range(400):
        f = list(GOOD)
        for _ in range(rnd.randrange(3)):
            f[rnd.randrange(12)] = rnd.choice(["!", ".", "chr2", "1000", "1001", "50", "51", "0", "007", "9" * 25, "٣", " +", "+", "-", "uu", "WW", "61", '"', '"60"'])
        lines.append("\t".join(f))
    lines += lines[8:60]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "line_id long, line string, reason string")
    sizes = spark.createDataFrame([*SIZES.items(), ("chr2", 10), (None, 5)], "chrom string, size long")
    parsed = parse_pairs_lines(df, sizes)
    got = {r.line_id: r.reason for r in parsed.select("line_id", "reason").collect()}
    want = {i: brute.reason(x, SIZES) for i, x in enumerate(lines) if x is None or not x.startswith("#")}
    assert got == want
    assert {v for v in want.values()} == {None, "quoting", "column_count", "bad_value"}
    row = valid_records(parsed).where("line_id = 0").first()
    assert (row.chrom1, row.pos1, row.mapq2, row.sam1) == ("chr1", 10, 60, 's"1\x19')
    assert rejects(parsed).count() + valid_records(parsed).count() == len(want)
    assert parse_pairs_lines(df.limit(0), sizes).count() == 0


CM = "row_id long, g string, m long, u string, weight double, donor_id string"


def impute(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "old") for r in rows], CM)
    out = impute_pmm(df, "row_id", "weight", ["g"], ["m"], "u", **kw)
    assert out.columns == [*df.columns, "filled_value", "is_filled", "fill_scope", "donor_id_", "prediction"]
    return {r.row_id: r for r in out.collect()}


def ok(w):
    return w is not None and math.isfinite(w) and w > 0


def test_pmm_donors_are_nearest(spark):
    rnd = random.Random(13)
    rows, bad = [], [None, float("nan"), float("inf"), -float("inf"), 0.0, -1.0]
    for g in "ab":
        for m in range(60):
            level = math.exp(rnd.gauss(0, 1))
            for u in range(3):
                w = level * (1 + u / 5) * math.exp(rnd.gauss(0, 0.05))
                rows.append((len(rows), g, m, f"u{u}", rnd.choice(bad) if rnd.random() < 0.25 or m == 7 else w))
    rows += [(1000, "empty", 1, "u0", None), (1001, None, None, None, None), (1002, None, None, None, 2.0), (1003, "one", 5, "u", 3.0), (1004, "one", 5, "v", None)]
    for kw in ({"cells": 1}, {"cells": 4, "cell_rows": 11}, {"cells": 1, "cell_rows": 11}, {"cells": 64, "cell_rows": 1}, {}):
        got = impute(spark, rows, **kw)
        by_id = {r[0]: r for r in rows}
        assert len(got) == len(rows)
        for i, (_, g, m, u, w) in by_id.items():
            r = got[i]
            similar = [x for x in rows if x[0] != i and g is not None and x[1] == g and x[2] == m and ok(x[4])]
            pool = [x for x in rows if x[1] == g and ok(x[4])]
            if ok(w):
                assert (r.filled_value, r.is_filled, r.fill_scope) == (w, False, None)
            elif not pool:
                assert (r.filled_value, r.is_filled) == (None, False)
            else:
                assert r.is_filled and r.fill_scope == ("match" if similar else "group")
                assert by_id[r.donor_id_][1] == g and by_id[r.donor_id_][4] == r.filled_value
    # Donors, against predictions made with numpy.
    for g in "ab":
        pred = {}
        mine = [x for x in rows if x[1] == g]
        stat = {}
        for x in mine:
            sim = [math.log(y[4]) for y in mine if y[0] != x[0] and y[2] == x[2] and ok(y[4])]
            stat[x[0]] = sum(sim) / len(sim) if sim else None
        for u in ("u0", "u1", "u2"):
            obs = [x for x in mine if x[3] == u and ok(x[4])]
            fit = [x for x in obs if stat[x[0]] is not None]
            b, a = np.polyfit([stat[x[0]] for x in fit], [math.log(x[4]) for x in fit], 1)
            for x in mine:
                if x[3] == u:
                    pred[x[0]] = a + b * stat[x[0]] if stat[x[0]] is not None else float(np.mean([math.log(y[4]) for y in obs]))
        for x in mine:
            if not ok(x[4]):
                best = min(abs(pred[y[0]] - pred[x[0]]) for y in mine if ok(y[4]))
                assert abs(pred[got[x[0]].donor_id_] - pred[x[0]]) <= best + 1e-7
                assert got[x[0]].prediction == pytest.approx(math.exp(pred[x[0]]))


@pytest.mark.parametrize("cells", [1, 2, 17, 64, 100])
def test_cells_are_ordered_and_bounded(spark, cells):
    pred = [float(x * x % 997) for x in range(500)]
    points = spark.createDataFrame([(g, p, 1, True) for g in "ab" for p in pred], "g0 string, pred double, donor int, asks boolean")
    got = sorted((r.g0, r.pred, r.cell) for r in _with_cells(points, ["g0"], cells).collect())
    assert len(got) == 1000 and {c for _, _, c in got} <= set(range(cells))
    for g in "ab":
        mine = [c for k, _, c in got if k == g]
        assert mine == sorted(mine) and len(set(mine)) > 0.9 * cells


def test_pmm_held_out_accuracy(spark):
    """Values held out come back nearer than with the group's mean."""
    rnd = random.Random(17)
    rows, truth = [], {}
    for m in range(200):
        level = math.exp(rnd.gauss(0, 1))
        for u in range(3):
            w = level * math.exp(rnd.gauss(0, 0.1))
            if rnd.random() < 0.15:
                truth[len(rows)] = w
            rows.append((len(rows), "g", m, f"u{u}", None if len(rows) in truth else w))
    got = impute(spark, rows)
    mean = np.mean([r[4] for r in rows if r[4]])
    ours = np.mean([abs(math.log(got[i].filled_value / w)) for i, w in truth.items()])
    assert ours < 0.4 * np.mean([abs(math.log(mean / w)) for w in truth.values()])


def test_pmm_empty(spark):
    assert impute(spark, []) == {}
