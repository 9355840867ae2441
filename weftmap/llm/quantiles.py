"""Mergeable percentile sketches with a guaranteed relative value error."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import col

#: Buckets of the infinities; every finite double's bucket is far below.
INFINITE = 2_000_000_000


def gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket_of(value: Column, alpha: float) -> Column:
    """Signed bucket: sign(v) * (ceil(log_gamma |v|) + offset), 0 for zero; the offset keeps the sign apart from the exponent."""
    v = value.cast("double")
    size = F.abs(v)
    exponent = F.ceil(F.log(size) / F.lit(math.log(gamma(alpha)))).cast("long") + F.lit(_offset(alpha))
    size_bucket = F.when(size == F.lit(float("inf")), F.lit(INFINITE).cast("long")).otherwise(exponent)
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(F.when(v < 0, -size_bucket).otherwise(size_bucket))


def _offset(alpha: float) -> int:
    """More than the exponent of the smallest positive double, so that every bucket number keeps its sign."""
    return math.ceil(1100 * math.log(2) / math.log(gamma(alpha)))


def value_of(bucket: Column, alpha: float) -> Column:
    """The value whose relative distance to every value of the bucket is at most alpha."""
    g = gamma(alpha)
    size = F.pow(F.lit(g), F.abs(bucket) - F.lit(_offset(alpha))) * F.lit(2 / (g + 1))
    size = F.when(F.abs(bucket) == INFINITE, F.lit(float("inf"))).otherwise(size)
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def sketch(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column], alpha: float = 0.01) -> DataFrame:
    """Bucket counts ``keys..., metric, bucket, n``: the sketch, itself a table that can be kept.

    Counts are combined before the shuffle, so what moves is buckets, not values: of positions up to 2.5e8 at most
    log(2.5e8) / log(gamma), 967 at 1 %, a group and metric and sign, whatever the number of rows or however much of it one group holds. NULL and NaN values are not counted; infinities have buckets
    of their own; a NULL key is a group. An empty table gives an empty sketch.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket_of(v, alpha).alias("bucket"),
                               F.isnan(v.cast("double")).alias("nan")) for m, v in metrics.items()])
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[col(c).alias(k) for c, k in zip(keys, names)], F.inline(pairs))
    counted = rows.where(F.col("bucket").isNotNull() & ~F.col("nan")).groupBy(*names, "metric", "bucket").agg(F.count("*").alias("n"))
    return counted.select(*[F.col(k).alias(c) for c, k in zip(keys, names)], "metric", "bucket", "n")


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up the bucket counts of sketches (of runs, days, partitions) per ``keys``; exact, in any order."""
    return sketches.groupBy(*[col(k) for k in keys], "metric", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: Sequence[str], probabilities: Sequence[float], alpha: float = 0.01) -> DataFrame:
    """``keys..., metric, q, n_values, estimate, rel_error`` from a merged sketch.

    The q-percentile is the value of 0-based rank floor(q * (n - 1)) in sorted order; the estimate e of a
    value v satisfies \\|e - v\\| <= alpha * \\|v\\| (exact for 0 and the infinities; up to rounding of the
    logarithm at bucket edges, about 1e-13). The window runs over the buckets of a group, whose number is bounded.
    """
    k = [col(c) for c in keys]
    over = Window.partitionBy(*k, "metric")
    rows = sketches.select(
        *k, "metric", "bucket", F.sum("n").over(over.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"),
        F.col("n").alias("__n"), F.sum("n").over(over).alias("n_values"),
    )
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in probabilities])).alias("q")
    rows = rows.select("*", wanted).withColumn("__rank", F.floor(F.col("q") * (F.col("n_values") - 1)))
    hit = rows.where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__n")))
    return hit.select(*k, "metric", "q", "n_values", value_of(F.col("bucket"), alpha).alias("estimate"), F.lit(alpha).alias("rel_error"))
