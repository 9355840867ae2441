"""Queries on tracks and interval tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..operators import maps as M
from ..operators import tracks as T
from ..operators.pairs import coverage_runs, read_ends
from ..sources.text import declared_columns
from .pairs import ORACLE as PAIRS_SQL

STEP = 100_000


def _binned(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "chrom_sizes")
    runs = coverage_runs(read_ends(table(spark, d, "pairs"), sizes, by=73)).withColumnRenamed("depth", "value")
    return T.bin_track(runs, sizes, STEP)


def bin_track(spark, d):
    return _binned(spark, d).withColumn("value", F.round("value", 9))


def track_limits(spark, d):
    return T.track_limits(_binned(spark, d)).withColumn("high", F.round("high", 9))


def smoothed_track(spark, d):
    out = M.gaussian(_binned(spark, d).select("chrom", "i", "value"), ["chrom"], "i", "value", 2.0, "spread")
    return out.withColumn("value", F.round("value", 6))


def bedgraph_deoverlap(spark, d):
    """Per track and chromosome the rows of bed that begin behind the last row kept."""
    return T.drop_overlaps(table(spark, d, "bed").select("track", "chrom", "start", "end", "bed_id"), ["track", "chrom"], "start", "end", ["end", "bed_id"])


def clipped_intervals(spark, d):
    return T.clipped(table(spark, d, "bed").where("start < end").select("bed_id", "chrom", "start", "end"), table(spark, d, "chrom_sizes"))


def header_columns(spark, d):
    return declared_columns(table(spark, d, "pairs_raw"))


def parsed_regions(spark, d):
    """Region strings written from bed and read back into columns."""
    text = F.concat("chrom", F.lit(":"), F.format_number("start", 0), F.lit("-"), F.format_number("end", 0))
    rows = table(spark, d, "bed").where("chrom IS NOT NULL AND start >= 0 AND start < end").select("bed_id", text.alias("region"))
    part = lambda k: F.regexp_replace(F.regexp_extract("region", r"^([^:]+):([\d,]+)-([\d,]+)$", k), ",", "")
    return rows.select("bed_id", part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))


QUERIES = {f.__name__: f for f in (
    bin_track, track_limits, smoothed_track, bedgraph_deoverlap, clipped_intervals, header_columns, parsed_regions,
)}

_BIN = f"""WITH runs AS ({PAIRS_SQL['coverage_runs']}),
x AS (SELECT r.*, unnest(generate_series(start // {STEP}, ("end" - 1) // {STEP})) AS i FROM runs r),
b AS (SELECT chrom, i, sum((least("end", (i + 1) * {STEP}) - greatest(start, i * {STEP})) * depth) AS s FROM x GROUP BY ALL),
sp AS (SELECT chrom, size, unnest(range(CAST(ceil(size / {STEP}.0) AS BIGINT))) AS i FROM chrom_sizes),
bt AS (SELECT chrom, i, i * {STEP} AS x, CAST(coalesce(s, 0) AS DOUBLE) / least({STEP}, size - i * {STEP}) AS value FROM sp LEFT JOIN b USING (chrom, i))
"""
_W = M.gaussian_weights(2.0)
ORACLE = {
    "bin_track": _BIN + "SELECT chrom, i, x, round(value, 9) AS value FROM bt",
    "track_limits": _BIN + "SELECT chrom, CAST(0 AS DOUBLE) AS low, round(max(value), 9) AS high FROM bt GROUP BY chrom",
    "smoothed_track": _BIN + f""", n AS (SELECT *, count(*) OVER (PARTITION BY chrom) AS n FROM bt),
t AS (SELECT chrom, i, w, ((i + o) % (2 * n) + 2 * n) % (2 * n) AS q, n FROM n, (VALUES {', '.join(f'({k - len(_W) // 2}, {x!r})' for k, x in enumerate(_W))}) k(o, w))
SELECT t.chrom, t.i, round(sum(w * bt.value), 6) AS value FROM t JOIN bt ON bt.chrom = t.chrom AND bt.i = CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END GROUP BY ALL""",
    "bedgraph_deoverlap": """WITH RECURSIVE r AS (SELECT track, chrom, start, "end", bed_id, row_number() OVER (PARTITION BY track, chrom ORDER BY start, "end", bed_id) AS rn
 FROM bed WHERE track IS NOT NULL AND chrom IS NOT NULL AND start < "end"),
k AS (SELECT track, chrom, rn, "end" AS reach, bed_id, TRUE AS kept FROM r WHERE rn = 1
 UNION ALL SELECT r.track, r.chrom, r.rn, CASE WHEN r.start >= k.reach THEN r."end" ELSE k.reach END, r.bed_id, r.start >= k.reach
 FROM k JOIN r ON r.track = k.track AND r.chrom = k.chrom AND r.rn = k.rn + 1)
SELECT b.track, b.chrom, b.start, b."end", b.bed_id FROM k JOIN bed b USING (bed_id) WHERE kept""",
    "clipped_intervals": """SELECT bed_id, b.chrom, start, least("end", size) AS "end" FROM bed b JOIN chrom_sizes c ON c.chrom = b.chrom WHERE start < "end" AND start < size""",
    "header_columns": """WITH h AS (SELECT run, line, row_number() OVER (PARTITION BY run ORDER BY line_no) AS k FROM pairs_raw WHERE starts_with(line, '#columns:')),
c AS (SELECT run, regexp_extract_all(substr(line, 10), '\\S+') AS names FROM h WHERE k = 1)
SELECT run, CAST(generate_subscripts(names, 1) - 1 AS INT) AS position, unnest(names) AS "column" FROM c""",
    "parsed_regions": """SELECT bed_id, chrom, start, "end" FROM bed WHERE chrom IS NOT NULL AND start >= 0 AND start < "end\"""",
}
