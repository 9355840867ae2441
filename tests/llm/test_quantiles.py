import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from weftmap.llm.quantiles import merge, percentiles, sketch


def test_percentiles_error_bound_and_merging(spark):
    rnd = random.Random(7)
    values = [0.0, -0.0, 5e-324, -1e-300, 1.7e308, -1.7e308, 1.0, -1.0] + [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-9, 12) for _ in range(3000)]
    rows = [("a", i % 3, v) for i, v in enumerate(values)] + [("b", 0, float("inf")), ("b", 1, -float("inf")), ("b", 1, 2.0)]
    rows += [("b", 2, None), ("b", 2, float("nan")), (None, 0, 4.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, part int, v double")
    qs = [0, 0.01, 0.3, 0.5, 0.9, 1]
    for alpha in (0.01, 0.1):
        parts = sketch(df, ["g", "part"], {"v": F.col("v")}, alpha)
        a, b = parts.where("part = 0"), parts.where("part > 0")
        got = percentiles(merge(a.unionByName(b), ["g"]), ["g"], qs, alpha).collect()
        whole = percentiles(sketch(df, ["g"], {"v": F.col("v")}, alpha), ["g"], qs, alpha).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, whole))
        data = defaultdict(list)
        for g, _, v in rows:
            if v is not None and not math.isnan(v):
                data[g].append(v)
        assert len(got) == len(qs) * len(data)
        for r in got:
            xs = sorted(data[r.g])
            exact = xs[math.floor(r.q * (len(xs) - 1))]
            assert r.n_values == len(xs)
            assert r.estimate == exact or abs(r.estimate - exact) <= alpha * abs(exact) * (1 + 1e-9) + 1e-323
    assert percentiles(sketch(df.limit(0), ["g"], {"v": F.col("v")}), ["g"], qs).count() == 0
