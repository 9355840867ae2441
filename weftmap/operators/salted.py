"""Per-key aggregation that stays balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import col, fresh, staged

#: What a result column may be computed with: partial aggregate of a value, and how partials merge.
PARTIALS = {
    "count": (lambda v: F.count(v), F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}
SLOTS = 1 << 16


def salted_aggregate(
    df: DataFrame, keys: Sequence[str], aggs: Mapping[str, tuple[str, Column]],
    heavy_fraction: float = 0.001, salts: int = 64, seed: int = 17, total_name: str | None = None,
) -> DataFrame:
    """``df.groupBy(keys)`` with ``aggs``, in two stages for the keys that hold many rows.

    ``aggs`` maps a result name to (kind, value column); kind is count, sum, min, max or avg
    (count counts the non-NULL values; ``F.lit(1)`` counts rows).

    1. Keys are counted in 65,536 hash slots. A slot with ``heavy_fraction`` of the rows or more is
       heavy: every heavy key lies in one, and there are at most 1 / heavy_fraction of them. That
       bound, not the data, sizes what is broadcast.
    2. Rows of heavy slots get a random salt, all others the salt 0, and all are aggregated per (key, salt) in one scan.
    3. The partials of heavy slots are merged per key: a hot key becomes ``salts`` groups, and reaches its one merging task
       as at most ``salts`` partials. The groups of the other slots are whole already.

    ``total_name`` adds a column with the number of all rows, from the slots' counts.

    Defined cases: NULL keys form groups as in ``groupBy``; NULL values are skipped as the SQL
    aggregates do; an empty table gives no rows; repeated rows count as often as they occur;
    other columns are ignored, and a result name equal to a key's gets an underscore.
    """
    names = [f"k{i}" for i in range(len(keys))]
    parts: dict[str, tuple[str, str]] = {}
    values: dict[str, Column] = {}
    out: list[Column] = []
    for i, (name, (kind, value)) in enumerate(aggs.items()):
        values[f"v{i}"] = value
        name = fresh(name, keys)
        if kind == "avg":
            parts[f"s{i}"], parts[f"n{i}"] = ("sum", f"v{i}"), ("count", f"v{i}")
            out.append(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}")).alias(name))
        else:
            parts[f"p{i}"] = (kind, f"v{i}")
            out.append(F.col(f"p{i}").alias(name))

    rows = df.select(
        *[col(c).alias(k) for c, k in zip(keys, names)], *[v.alias(k) for k, v in values.items()]
    )
    slot = F.pmod(F.xxhash64(*names), F.lit(SLOTS)).cast("int")
    slots = staged(rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")))  # at most 65,536 rows, read twice
    total = slots.agg(F.sum("n")).scalar()
    heavy = F.broadcast(slots.where(F.col("n") >= F.lit(heavy_fraction) * total).select("slot", F.lit(True).alias("hot")))

    rows = rows.withColumn("slot", slot).join(heavy, "slot", "left")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.floor(F.rand(seed) * salts).cast("int")).otherwise(0))
    first = [PARTIALS[kind][0](F.col(v)).alias(p) for p, (kind, v) in parts.items()]
    merge = [PARTIALS[kind][1](F.col(p)).alias(p) for p, (kind, _) in parts.items()]
    # Whether a group is hot is an aggregate, so that both branches below read the same shuffled rows.
    partial = rows.groupBy(*names, "salt").agg(*first, F.max("hot").alias("hot"))
    cold = partial.where(F.col("hot").isNull()).select(*names, *parts)
    hot = partial.where("hot").groupBy(*names).agg(*merge)
    if total_name is not None:
        out.append(total.alias(fresh(total_name, [*keys, *aggs])))
    return cold.unionByName(hot).select(*[F.col(k).alias(c) for c, k in zip(keys, names)], *out)
