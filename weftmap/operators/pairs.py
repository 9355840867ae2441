"""Operators on pair records: filtering, deduplication, distance curves, read ends and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import fresh, staged
from ..functions import pairs as P
from .intervals import periods_and_gaps

#: The four curves of a distance-decay table.
CURVES = ("inward", "outward", "tandem_entry", "tandem_exit")
CELL = 1 << 16


def with_sizes(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """``size1`` and ``size2`` of the ends' chromosomes, NULL where unknown."""
    for k in (1, 2):
        df = df.join(sizes.select(F.col("chrom").alias(f"chrom{k}"), F.col("size").alias(f"size{k}")), f"chrom{k}", "left")
    return df


def valid_pairs(
    df: DataFrame, sizes: DataFrame, direction: str | None = None, min_distance: int = 0, regions: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Unique pairs on their chromosomes, of one direction, a cis separation of ``min_distance`` or more, both ends inside ``regions``.

    The separation is signed and only tested for cis pairs. ``regions`` has chrom, start, end (half-open, 0-based; ends are
    1-based). An unknown direction keeps nothing. ``strict`` raises for invalid strands and unknown chromosomes of unique
    pairs, which are otherwise dropped, as are pairs without a position.
    """
    columns = df.columns
    df = df.where(F.col("pair_type") == "UU").withColumn("__dir", P.direction(F.col("strand1"), F.col("strand2"), strict))
    df = df.where(F.col("__dir").isNotNull() if direction is None else F.col("__dir") == F.lit(direction))
    df = with_sizes(df, sizes)
    for k in (1, 2):
        size = F.col(f"size{k}")
        if strict:
            size = F.coalesce(size, F.raise_error(F.concat(F.lit("unknown chromosome: "), F.col(f"chrom{k}"))).cast("long"))
        df = df.where((F.col(f"pos{k}") >= 1) & (F.col(f"pos{k}") <= size))
    df = df.where((F.col("chrom1") != F.col("chrom2")) | (P.separation() >= min_distance))
    if regions is not None:
        for k in (1, 2):
            df = inside_regions(df, regions, f"chrom{k}", f"pos{k}")
    return df.select(*columns)


def inside_regions(df: DataFrame, regions: DataFrame, chrom: str, pos: str, salts: int = 16) -> DataFrame:
    """Rows whose 1-based position lies in a region: a semi join, so overlapping regions repeat nothing.

    Regions are merged first and dealt to position cells, so that the join has an equality on (chromosome, cell)
    and at most a few disjoint periods for each. The periods stand there ``salts`` times, and every row draws one of them, so that a cell
    that holds a large part of all rows is spread as well.
    """
    merged = periods_and_gaps(regions, ["chrom"], "start", "end").where("kind = 'period'")
    cells = F.explode(F.sequence(F.floor((F.col("from_pos") + 1) / CELL), F.floor(F.col("to_pos") / CELL)))
    merged = merged.select(F.col("chrom").alias("__c"), F.col("from_pos").alias("__s"), F.col("to_pos").alias("__e"), cells.alias("__k"))
    merged = merged.select("*", F.explode(F.array(*[F.lit(k) for k in range(salts)])).alias("__z"))
    salt = fresh("__salt", df.columns)
    rows = df.withColumn(salt, F.floor(F.rand(23) * salts).cast("int"))
    hit = (F.col(chrom) == F.col("__c")) & (F.floor(F.col(pos) / CELL) == F.col("__k")) & (F.col(salt) == F.col("__z"))
    return rows.join(merged, hit & (F.col(pos) > F.col("__s")) & (F.col(pos) <= F.col("__e")), "left_semi").drop(salt)


def cis(df: DataFrame) -> DataFrame:
    return df.where(F.col("chrom1") == F.col("chrom2"))


def _spine(spark: SparkSession, high: int, name: str) -> DataFrame:
    return spark.range(high).withColumnRenamed("id", name)


def distance_curves(df: DataFrame, high: int = 100_000, documented: bool = False) -> DataFrame:
    """Base-resolution decay: per distance in [0, high) the unique cis pairs of each direction with that positive separation; zero-filled."""
    rows = cis(df.where(F.col("pair_type") == "UU")).select(
        P.separation().alias("distance"), P.decay_direction(F.col("strand1"), F.col("strand2"), documented).alias("direction")
    )
    rows = rows.where((F.col("distance") > 0) & (F.col("distance") < high))
    counts = rows.groupBy("distance").agg(*[F.count(F.when(F.col("direction") == c, 1)).alias(c) for c in CURVES])
    spine = _spine(df.sparkSession, high, "distance")
    return spine.join(counts, "distance", "left").select("distance", *[F.coalesce(c, F.lit(0)).alias(c) for c in CURVES])


def raw_and_shifted(df: DataFrame, by: int = 65, high: int = 1000) -> DataFrame:
    """Distance histograms per direction before and after :func:`weftmap.functions.pairs.direction_shift`; zero-filled."""
    d = P.plot_direction(F.col("strand1"), F.col("strand2"))
    rows = cis(df.where(F.col("pair_type") == "UU")).withColumn("direction", d).where("direction <> ''")
    moved = P.direction_shift(F.col("pos2"), F.col("direction"), 2, by) - P.direction_shift(F.col("pos1"), F.col("direction"), 1, by)
    rows = rows.select("direction", F.inline(F.array(
        F.struct(F.lit("raw").alias("kind"), P.separation().alias("distance")), F.struct(F.lit("shifted").alias("kind"), moved.alias("distance"))
    )))
    counts = rows.where((F.col("distance") > 0) & (F.col("distance") < high)).groupBy("kind", "direction", "distance").agg(F.count("*").alias("n"))
    spine = _spine(df.sparkSession, high, "distance").withColumn("kind", F.explode(F.array(F.lit("raw"), F.lit("shifted"))))
    spine = spine.withColumn("direction", F.explode(F.array(*map(F.lit, CURVES))))
    keys = ["kind", "direction", "distance"]
    return spine.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def cis_fractions(df: DataFrame, near: int = 100_000) -> DataFrame:
    """Of the unique pairs the fraction in cis, and of those the fraction nearer than ``near``; one row."""
    is_cis = F.coalesce(F.col("chrom1") == F.col("chrom2"), F.lit(False))
    is_near = F.coalesce(P.separation() < near, F.lit(False))
    return df.where(F.col("pair_type") == "UU").agg(
        F.count("*").alias("n"), F.avg(is_cis.cast("int")).alias("frac_cis"), F.avg(F.when(is_cis, is_near.cast("int"))).alias("frac_near")
    )


def windowed_distances(df: DataFrame, window: int = 200, high: int = 10) -> DataFrame:
    """Histogram of the separation in windows, relative to a separation of one window; zero-filled."""
    known = P.plot_direction(F.col("strand1"), F.col("strand2")) != ""
    rows = cis(df.where((F.col("pair_type") == "UU") & known)).select(P.windowed_separation(window).alias("distance"))
    counts = rows.where((F.col("distance") >= 0) & (F.col("distance") < high)).groupBy("distance").agg(F.count("*").alias("n"))
    full = _spine(df.sparkSession, high, "distance").join(counts, "distance", "left").select("distance", F.coalesce("n", F.lit(0)).alias("n"))
    one = full.where("distance = 1").select("n").scalar()
    return full.select("distance", "n", (F.col("n") / F.nullif(one, F.lit(0))).alias("relative"))


def read_ends(df: DataFrame, sizes: DataFrame, by: int = 0, median: bool = False, pair_type: str | None = "UU") -> DataFrame:
    """Both ends of each pair as 1-base intervals: ``chrom, start, end, strand, length``.

    A pair counts if both ends lie in [0, size) of their chromosomes. ``length`` is |pos5 - pos3| where both are known.
    """
    if pair_type:
        df = df.where(F.col("pair_type") == pair_type)
    df = P.with_median(df) if median else P.with_shift(df, by)
    df = with_sizes(df, sizes)
    for k in (1, 2):
        df = df.where((F.col(f"pos{k}") >= 0) & (F.col(f"pos{k}") < F.col(f"size{k}")))

    def end(k: int) -> Column:
        have = {f"pos5{k}", f"pos3{k}"} <= set(df.columns)
        length = F.abs(F.col(f"pos5{k}") - F.col(f"pos3{k}")) if have else F.lit(None).cast("long")
        pos = F.col(f"pos{k}")
        return F.struct(F.col(f"chrom{k}").alias("chrom"), pos.alias("start"), (pos + 1).alias("end"), F.col(f"strand{k}").alias("strand"), length.alias("length"))

    return df.select(F.inline(F.array(end(1), end(2))))


def ends_by_length(ends: DataFrame, threshold: int) -> DataFrame:
    """Read ends of known length with ``length_class`` below or above (the threshold itself is above)."""
    known = ends.where(F.col("length").isNotNull())
    return known.withColumn("length_class", F.when(F.col("length") < threshold, "below").otherwise("above"))


def coverage_runs(ends: DataFrame, strand: str | None = None) -> DataFrame:
    """bedGraph of the ends' depth: maximal runs of neighbouring bases with the same depth above zero.

    Ends are counted per base before anything else, so a base with a tenth of all ends is one row. A run begins where the
    base before has another depth.
    """
    if strand is not None:
        ends = ends.where(F.col("strand") == strand)
    depth = ends.groupBy("chrom", F.col("start").alias("pos")).agg(F.count("*").alias("depth"))
    cell = Window.partitionBy("chrom", "cell").orderBy("pos")
    rows = depth.withColumn("cell", F.floor(F.col("pos") / CELL))
    # Runs are cut at cell borders first and glued where they go on: a window never holds more than a cell's bases.
    begins = (F.lag("pos").over(cell) == F.col("pos") - 1) & (F.lag("depth").over(cell) == F.col("depth"))
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(begins, F.lit(False)), 0).otherwise(1)).over(cell))
    runs = rows.groupBy("chrom", "cell", "run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.first("depth").alias("depth"))
    over = Window.partitionBy("chrom").orderBy("start")
    borders = runs.where((F.col("start") % CELL == 0) | (F.col("end") % CELL == 0))
    inner = runs.where(~((F.col("start") % CELL == 0) | (F.col("end") % CELL == 0)))
    go_on = (F.lag("end").over(over) == F.col("start")) & (F.lag("depth").over(over) == F.col("depth"))
    borders = borders.withColumn("glue", F.sum(F.when(F.coalesce(go_on, F.lit(False)), 0).otherwise(1)).over(over))
    glued = borders.groupBy("chrom", "glue").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("depth").alias("depth"))
    return inner.select("chrom", "start", "end", "depth").unionByName(glued.select("chrom", "start", "end", "depth"))


def length_heatmap(
    df: DataFrame, chrom: str, start: int, end: int, length_min: int = 20, length_max: int = 80, bin_size: int = 1, pair_type: str | None = "UU"
) -> DataFrame:
    """Counts of aligned spans by (length, position bin) in a region: each end marks every bin its span covers. Sparse."""
    if pair_type:
        df = df.where(F.col("pair_type") == pair_type)
    ends = df.select(F.inline(F.array(*[
        F.struct(F.col(f"chrom{k}").alias("chrom"), F.col(f"pos5{k}").alias("p5"), F.col(f"pos3{k}").alias("p3")) for k in (1, 2)
    ])))
    low, high = F.greatest(F.least("p5", "p3"), F.lit(start)), F.least(F.greatest("p5", "p3"), F.lit(end - 1))
    ends = ends.where((F.col("chrom") == chrom) & F.abs(F.col("p5") - F.col("p3")).between(length_min, length_max))
    ends = ends.select(F.abs(F.col("p5") - F.col("p3")).alias("length"), low.alias("low"), high.alias("high")).where("high >= low")
    bins = F.sequence(F.floor((F.col("low") - start) / bin_size), F.floor((F.col("high") - start) / bin_size))
    return ends.select("length", F.explode(bins).alias("xbin")).groupBy("length", "xbin").agg(F.count("*").alias("n"))


def mark_duplicates(df: DataFrame, order: list[str], mismatch: int = 1, rounds: int = 60) -> DataFrame:
    """``df`` with ``is_duplicate``: all but the first (by ``order``) of each cluster of pairs.

    Pairs with the same chromosomes and strands belong together if both ends lie within ``mismatch`` bases, and through
    others. Distinct positions are clustered, not rows, so repeated loci cost one row each. Neighbours are found with
    equality joins on the shifted positions; linked positions are contracted round by round until no link is left,
    each round written to the shared folder. Pairs without a position or strand are never duplicates.
    """
    key = ["chrom1", "chrom2", "strand1", "strand2", "pos1", "pos2"]
    complete = F.lit(True)
    for c in key:
        complete = complete & F.col(c).isNotNull()
    # 128 bits name a position: at 10^12 positions two of them share a name with a chance of 10^-15.
    name = F.struct(F.xxhash64(*key).alias("a"), F.xxhash64(F.lit(1), *key).alias("b"))
    points = staged(df.where(complete).select(*key).distinct().withColumn("id", name))
    steps = [(a, b) for a in range(-mismatch, mismatch + 1) for b in range(-mismatch, mismatch + 1) if (a, b) > (0, 0)]
    steps = steps or [(0, 0)]  # with no mismatch a position's only neighbour is itself
    moved = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])).alias("step")
    probes = points.select(*key, F.col("id").alias("x"), moved).select(
        *key[:4], (F.col("pos1") + F.col("step.a")).alias("pos1"), (F.col("pos2") + F.col("step.b")).alias("pos2"), "x"
    )
    half = probes.join(points.withColumnRenamed("id", "y"), key).select("x", "y")
    edges = staged(half.unionByName(half.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    labels = staged(edges.select(F.col("x").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        if edges.isEmpty():
            break
        # Every member joins the least of its neighbours, then theirs; joined members are one from then on. At least half
        # of them vanish in a round, however long the chain is that holds a cluster together.
        parent = staged(edges.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p")))
        for _ in range(2):
            up = parent.select(F.col("x").alias("p"), F.col("p").alias("next"))
            parent = parent.join(up, "p", "left").select("x", F.coalesce("next", "p").alias("p"))
        parent = staged(parent)
        of = lambda e: parent.withColumnsRenamed({"x": e, "p": f"p{e}"})  # noqa: B023, E731
        labels = staged(labels.join(of("label"), "label", "left").select("id", F.coalesce("plabel", "label").alias("label")))
        joined = edges.join(of("x"), "x").join(of("y"), "y").where("px <> py")
        edges = staged(joined.select(F.col("px").alias("x"), F.col("py").alias("y")).distinct())
    else:
        raise RuntimeError(f"clusters did not settle in {rounds} rounds")
    # The row number makes rows that are equal in every column differ; staged, as it must not be drawn twice.
    order = [*order, "__row"]
    tagged = staged(df.where(complete).withColumns({"__id": name, "__row": F.monotonically_increasing_id()}))
    tagged = tagged.join(labels.select(F.col("id").alias("__id"), F.col("label").alias("__label")), "__id", "left")
    # The first row of a cluster: a minimum that is combined before the shuffle, not a sort of the cluster.
    tagged = tagged.withColumn("__cluster", F.coalesce("__label", "__id"))
    first = tagged.groupBy("__cluster").agg(F.min(F.struct(*order)).alias("__first"))
    out = tagged.join(first, "__cluster").select(*df.columns, (F.struct(*order) != F.col("__first")).alias("is_duplicate"))
    # Rows that cannot be compared are in no join: they would share one NULL key.
    return out.unionByName(df.where(~complete).select(*df.columns, F.lit(False).alias("is_duplicate")))


def sorted_pairs(df: DataFrame) -> DataFrame:
    return df.orderBy("chrom1", "chrom2", "pos1", "pos2")
