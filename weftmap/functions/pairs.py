"""Column functions on pair records; the same for batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F


def shifted(pos: Column, strand: Column, by: int) -> Column:
    """A read end moved ``by`` bases along its orientation; anything but ``+`` counts as the minus strand, NULL stays NULL."""
    return F.when(strand == "+", pos + by).otherwise(pos - by)


def median_position(pos: Column, pos5: Column, pos3: Column) -> Column:
    """The floored middle of an end's outermost mapped bases, or its position where one is missing."""
    return F.coalesce(F.floor((pos5 + pos3) / 2).cast("long"), pos)


def with_shift(df, by: int = 65):
    """Both ends shifted along their orientation."""
    return df.withColumns({f"pos{k}": shifted(F.col(f"pos{k}"), F.col(f"strand{k}"), by) for k in (1, 2)})


def with_median(df):
    """Both ends moved to their median position; an end without the two columns stays."""
    have: Collection[str] = set(df.columns)
    ends = [k for k in (1, 2) if {f"pos5{k}", f"pos3{k}"} <= have]
    return df.withColumns({f"pos{k}": median_position(F.col(f"pos{k}"), F.col(f"pos5{k}"), F.col(f"pos3{k}")) for k in ends})


def direction(s1: Column, s2: Column, strict: bool = False) -> Column:
    """inward, outward, tandemexit (++) or tandementry (--), as the pair filter names them; NULL, or an error if strict, for other strands."""
    other = F.raise_error(F.concat(F.lit("invalid strands: "), F.concat_ws(", ", s1, s2))).cast("string") if strict else F.lit(None).cast("string")
    return (
        F.when((s1 == "+") & (s2 == "-"), "inward").when((s1 == "-") & (s2 == "+"), "outward")
        .when((s1 == "+") & (s2 == "+"), "tandemexit").when((s1 == "-") & (s2 == "-"), "tandementry").otherwise(other)
    )


def decay_direction(s1: Column, s2: Column, documented: bool = False) -> Column:
    """The distance-decay curves' naming, in which ++ is tandem_entry and whatever is not + is minus.

    ``documented`` gives the two tandem names the other way round, as the filter has them.
    """
    plus1, plus2 = F.coalesce(s1 == "+", F.lit(False)), F.coalesce(s2 == "+", F.lit(False))
    pp, mm = ("tandem_exit", "tandem_entry") if documented else ("tandem_entry", "tandem_exit")
    return F.when(plus1 & plus2, pp).when(~plus1 & ~plus2, mm).when(plus1, "inward").otherwise("outward")


def plot_direction(s1: Column, s2: Column) -> Column:
    """As :func:`decay_direction`, but only for exact strands; '' otherwise."""
    known = s1.isin("+", "-") & s2.isin("+", "-")
    return F.when(known, decay_direction(s1, s2)).otherwise("")


def direction_shift(pos: Column, direct: Column, end: int, by: int) -> Column:
    """Inward ends move towards each other, outward ends apart, tandem pairs stay."""
    sign = 1 if end == 1 else -1
    return F.when(direct == "inward", pos + sign * by).when(direct == "outward", pos - sign * by).otherwise(pos)


def separation() -> Column:
    return F.col("pos2") - F.col("pos1")


def windowed_separation(window: int) -> Column:
    return F.floor(F.col("pos2") / window) - F.floor(F.col("pos1") / window)


def smoothing_width(k: Column, scale: float = 0.05, exponent: float = 0.5, plateau: int = 2) -> Column:
    """Kernel width that grows with the separation k."""
    return F.lit(scale) * F.pow(F.greatest(F.lit(1), k - plateau).cast("double"), F.lit(exponent))


def styled_gene(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 20)))
