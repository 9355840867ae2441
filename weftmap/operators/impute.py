"""Filling missing values by predictive mean matching."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import col, fresh, staged


def usable(value: Column) -> Column:
    """A finite number above zero; NULL and NaN are not (Spark holds NaN greater than any number)."""
    v = value.cast("double")
    return F.coalesce((v > 0) & (v < F.lit(float("inf"))) & ~F.isnan(v), F.lit(False))


#: Decimals of a prediction (a logarithm): the order in which sums were made does not reach them.
DIGITS = 9
SALTS = 16


def _spread(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` (which have an ``id`` or a ``pred``) joined null-safely with the few ``side`` rows of their keys, which stand there once a salt, so that a large key is no single task's."""
    by = "id" if "id" in rows.columns else "pred"
    a = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS))).alias("a")
    b = side.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.__salt") == F.col("b.__salt")], how)
    return joined.select("a.*", *[F.col(f"b.{c}").alias(c) for c in side.columns if c not in keys]).drop("__salt")


def _scored(df: DataFrame, row_id: str, target: str, group: Sequence[str], match: Sequence[str], unit: str, min_fit: int) -> tuple[DataFrame, int]:
    """Every row with its prediction: ``id, g.., w, has, matched, pred``; and the largest group's number of rows."""
    g, m = [f"g{i}" for i in range(len(group))], [f"m{i}" for i in range(len(match))]
    base = df.select(
        col(row_id).alias("id"), *[col(c).alias(k) for c, k in zip([*group, *match], [*g, *m])], col(unit).alias("u"),
        col(target).cast("double").alias("w"), usable(col(target)).alias("has"),
    ).withColumn("y", F.when(F.col("has"), F.log("w")))

    # The similar rows of a row: same group and match columns, without the row itself.
    similar = base.where(F.col("has")).groupBy(*g, *m).agg(F.count("*").alias("sim_n"), F.sum("y").alias("sim_y"))
    own = F.col("has").cast("int")
    others = F.coalesce(F.col("sim_n"), F.lit(0)) - own
    base = base.join(similar, [*g, *m], "left").withColumn("matched", others > 0)
    base = base.withColumn("x", F.when(F.col("matched"), (F.col("sim_y") - F.coalesce("y", F.lit(0.0))) / others))
    base = staged(base.select("id", *g, "u", "w", "has", "y", "matched", "x"))

    # One line per unit of a group, from sums; a unit with too few rows takes its group's line.
    xy = F.col("has") & F.col("matched")
    sums = {
        "n": F.sum(F.when(xy, 1).otherwise(0)), "sx": F.sum(F.when(xy, F.col("x"))), "sy": F.sum(F.when(xy, F.col("y"))),
        "sxx": F.sum(F.when(xy, F.col("x") * F.col("x"))), "sxy": F.sum(F.when(xy, F.col("x") * F.col("y"))),
        "ny": F.count("y"), "ty": F.sum("y"), "rows": F.count("*"),
    }
    per_unit = base.groupBy(*g, "u").agg(*[v.alias(k) for k, v in sums.items()])
    per_group = per_unit.groupBy(*g).agg(*[F.sum(k).alias("g" + k) for k in sums])

    def line(p: str) -> tuple[Column, Column, Column]:
        n, sx, sy, sxx, sxy = (F.col(p + k) for k in ("n", "sx", "sy", "sxx", "sxy"))
        spread = n * sxx - sx * sx
        fits = (n >= min_fit) & (spread > F.lit(1e-9) * n * sxx)
        slope = F.when(fits, (n * sxy - sx * sy) / spread)
        return slope, F.when(fits, (sy - slope * sx) / n), F.when(F.col(p + "ny") > 0, F.col(p + "ty") / F.col(p + "ny"))

    (ub, ua, um), (gb, ga, gm) = line(""), line("g")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in g]
    fit = per_unit.alias("a").join(per_group.alias("b"), same).select(
        *[F.col(f"a.{k}").alias(k) for k in g], "u", F.coalesce(ub, gb, F.lit(1.0)).alias("slope"),
        F.coalesce(ua, ga, F.lit(0.0)).alias("icept"), F.coalesce(um, gm).alias("level"), "grows",
    )
    fit = staged(fit)
    largest = fit.agg(F.max("grows")).first()[0] or 0
    base = _spread(base, fit.drop("grows"), [*g, "u"])
    pred = F.when(F.col("matched"), F.col("icept") + F.col("slope") * F.col("x")).otherwise(F.col("level"))
    return base.select("id", *g, "w", "has", "matched", F.round(pred, DIGITS).alias("pred")), largest


def _with_cells(points: DataFrame, g: Sequence[str], cells: int) -> DataFrame:
    """``points`` with the quantile cell (0 to cells - 1) of each prediction within its group."""
    step = math.isqrt(cells)
    cuts = points.groupBy(*g).agg(F.percentile_approx("pred", [i / cells for i in range(1, cells)], 16 * cells).alias("cuts"))
    cuts = cuts.withColumn("coarse", F.filter("cuts", lambda c, i: (i + 1) % step == 0))
    rows = _spread(points, cuts, g)
    # Cuts are sorted: every step-th one tells the block, the block's own ones the cell.
    block = F.size(F.filter("coarse", lambda c: c < F.col("pred"))) * step
    cell = block + F.size(F.filter(F.slice("cuts", block + 1, F.lit(step)), lambda c: c < F.col("pred")))
    return rows.select(*g, "pred", "donor", "asks", F.coalesce(cell, F.lit(0)).alias("cell"))  # one cell has no cuts


def _nearest(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The asking points with the nearest donors ``below`` and ``above`` among those of the same keys; running values in both directions."""
    up, down = Window.partitionBy(*keys).orderBy("pred"), Window.partitionBy(*keys).orderBy(F.desc("pred"))
    upto = lambda w: F.last("donor", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return points.withColumns({"below": upto(up), "above": upto(down)}).where("asks")


def impute_pmm(
    df: DataFrame, row_id: str, target: str, group: Sequence[str], match: Sequence[str], unit: str, min_fit: int = 8, cells: int = 64,
    cell_rows: int = 250_000,
) -> DataFrame:
    """``df`` with missing ``target`` values filled by predictive mean matching, and every fill marked.

    * Predictor, aware of the group: log(target) of a row is predicted from the mean log(target) of its similar
      rows (same ``group`` and ``match`` values, the row itself left out), with one least-squares line per
      (``group``, ``unit``), falling back on the group's line under ``min_fit`` rows. A row without similar rows is
      predicted by its unit's mean, or its group's.
    * Range search: the donor is the observed row of the group whose prediction, to nine decimals, is nearest (on a tie the lower
      prediction, among equal predictions the lowest row id). Equal predictions are one point. The nearest donors below and above come from running values over a
      group's points; where a group has over ``cell_rows`` rows, over those of a quantile cell (``cells`` a group, or as many as the largest group needs at ``cell_rows`` a cell),
      and for points without one in their cell over the cells' outermost donors. The search is exact either way, and no task has more than a cell.
    * The donor's observed value is copied, with the donor's id.

    Added columns (underscored where taken): ``filled_value`` (observed or copied), ``is_filled``, ``fill_scope``
    (``match``: similar rows predicted it; ``group``: only its unit or group did; NULL if not filled), ``donor_id``,
    ``prediction`` (in the target's unit).

    Defined cases: a usable value is finite and above zero, anything else (NULL, NaN, infinite, zero, negative) is
    missing; a NULL in a match or group column equals no other row's, so such a row has no similar rows (rows of a
    NULL group still fill each other); a group without any usable value stays unfilled with is_filled false and
    filled_value NULL; repeated rows are rows of their own; ``row_id`` must be unique; an empty table gives an
    empty result. All columns of ``df`` are kept.
    """
    g = [f"g{i}" for i in range(len(group))]
    scored, largest = _scored(df, row_id, target, group, match, unit, min_fit)
    donor = F.struct(F.col("pred").alias("at"), F.col("id").alias("id"), F.col("w").alias("w"))
    points = scored.where(F.col("pred").isNotNull()).groupBy(*g, "pred").agg(
        F.min(F.when(F.col("has"), donor)).alias("donor"), F.max(~F.col("has")).alias("asks")
    )
    if largest <= cell_rows:
        asking, below, above = _nearest(points, g), F.col("below"), F.col("above")
    else:
        points = _with_cells(points, g, max(cells, math.ceil(largest / cell_rows)))
        ends = points.groupBy(*g, "cell").agg(F.min("donor").alias("lowest"), F.max("donor").alias("highest"))
        forth, back = Window.partitionBy(*g).orderBy("cell"), Window.partitionBy(*g).orderBy(F.desc("cell"))
        ends = ends.select(
            *g, "cell", F.last("highest", True).over(forth.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
            F.last("lowest", True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("after"),
        )
        asking = _nearest(points, [*g, "cell"]).alias("p").join(ends.alias("e"), [F.col(f"p.{k}").eqNullSafe(F.col(f"e.{k}")) for k in [*g, "cell"]])
        asking = asking.select("p.*", "before", "after")
        below, above = F.coalesce("below", "before"), F.coalesce("above", "after")
    near = F.when(below.isNull() | (above["at"] - F.col("pred") < F.col("pred") - below["at"]), above).otherwise(below)
    chosen = asking.select(*g, "pred", near.alias("donor")).where(F.col("donor").isNotNull())
    missing = scored.where(~F.col("has")).alias("s").join(
        chosen.alias("c"), [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in g] + [F.col("s.pred") == F.col("c.pred")]
    )
    fills = missing.select(
        F.col("s.id").alias("__id"), F.col("donor.w").alias("__w"), F.col("donor.id").alias("__donor"),
        F.when(F.col("matched"), "match").otherwise("group").alias("__scope"), F.exp("s.pred").alias("__pred"),
    )
    out = df.join(fills, col(row_id) == F.col("__id"), "left")
    added = {
        "filled_value": F.when(usable(col(target)), col(target).cast("double")).otherwise(F.col("__w")),
        "is_filled": F.col("__donor").isNotNull(), "fill_scope": F.col("__scope"), "donor_id": F.col("__donor"), "prediction": F.col("__pred"),
    }
    return out.select(*[col(c) for c in df.columns], *[v.alias(fresh(k, df.columns)) for k, v in added.items()])
