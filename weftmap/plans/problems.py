"""Queries of the general data problems (p1, p2, p3, p5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..operators.impute import impute_pmm
from ..operators.intervals import periods_and_gaps
from ..operators.rawlines import FIELDS, MAX_MAPQ, PAIR_TYPES, parse_pairs_lines, rejects, valid_records
from ..operators.salted import salted_aggregate

HEAVY = 0.01


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "bed"), ["track", "chrom"], "start", "end")


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and uncovered bases per track and chromosome, from the same operator."""
    found = p1_found(spark, sf_dir)
    size = F.col("to_pos") - F.col("from_pos")
    is_period = F.col("kind") == "period"
    return found.groupBy("track", "chrom").agg(
        F.sum(is_period.cast("long")).alias("n_periods"), F.sum(F.when(is_period, size).otherwise(0)).alias("covered"),
        F.sum(F.when(~is_period, size).otherwise(0)).alias("gap_bases"), F.max(F.when(~is_period, size)).alias("longest_gap"),
    )


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute_pmm(
        table(spark, sf_dir, "contact_map"), "row_id", "weight", group=["condition", "resolution"], match=["chrom", "start"], unit="replicate"
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).where(F.col("is_filled") & (F.col("fill_scope") == "match")).select("row_id")


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).select(
        "row_id", "condition", "replicate", "resolution", "chrom", "start", "weight", "filled_value", "is_filled", "fill_scope", "donor_id",
        F.round("prediction", 6).alias("prediction"),
    )


def _loci(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    distance = F.when(F.col("chrom1") == F.col("chrom2"), F.col("pos2") - F.col("pos1"))
    return salted_aggregate(
        table(spark, sf_dir, "pairs"), ["chrom1", "pos1"],
        {"n_pairs": ("count", F.lit(1)), "n_cis": ("count", distance), "min_distance": ("min", distance),
         "max_distance": ("max", distance), "mean_distance": ("avg", distance)},
        heavy_fraction=HEAVY / 4, **more,
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    heavy = _loci(spark, sf_dir, total_name="n_total").where(F.col("chrom1").isNotNull() & F.col("pos1").isNotNull())
    return heavy.where(F.col("n_pairs") * 100 >= F.col("n_total")).select("chrom1", "pos1")


def p3_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-locus results; the mean is rounded for comparison."""
    return _loci(spark, sf_dir).withColumn("mean_distance", F.round("mean_distance", 4))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pairs_lines(table(spark, sf_dir, "pairs_raw"), table(spark, sf_dir, "chrom_sizes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(_parsed(spark, sf_dir))


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_records(_parsed(spark, sf_dir)).drop("sam1", "sam2")


QUERIES = {f.__name__: f for f in (
    p1_found, p1_coverage, p2_found, p2_filled, p3_found, p3_loci, p5_found, p5_loaded,
)}

_P1 = """
WITH iv AS (SELECT DISTINCT track, chrom, start AS s, "end" AS e FROM bed
            WHERE track IS NOT NULL AND chrom IS NOT NULL AND start < "end"),
     up AS (SELECT *, max(e) OVER (PARTITION BY track, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
     isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
                    OVER (PARTITION BY track, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM up),
     per AS (SELECT track, chrom, island, min(s) AS from_pos, max(e) AS to_pos FROM isl GROUP BY track, chrom, island),
     nxt AS (SELECT *, lead(from_pos) OVER (PARTITION BY track, chrom ORDER BY from_pos) AS next_from FROM per),
     found AS (SELECT track, chrom, 'period' AS kind, from_pos, to_pos FROM per
               UNION ALL
               SELECT track, chrom, 'gap', to_pos, next_from FROM nxt WHERE next_from IS NOT NULL)
"""

_USABLE = "coalesce({0} > 0 AND NOT isnan({0}) AND NOT isinf({0}), FALSE)"

_G, _M, _SAME = "condition, resolution", "chrom, start", "{0}.condition IS NOT DISTINCT FROM {1}.condition AND {0}.resolution IS NOT DISTINCT FROM {1}.resolution"
_LINE = """CASE WHEN {0}n >= 8 AND {0}n * {0}sxx - {0}sx * {0}sx > 1e-9 * {0}n * {0}sxx THEN ({0}n * {0}sxy - {0}sx * {0}sy) / ({0}n * {0}sxx - {0}sx * {0}sx) END AS {0}slope"""
_P2 = f"""
WITH b AS (SELECT *, {_USABLE.format('weight')} AS has, CASE WHEN {_USABLE.format('weight')} THEN ln(weight) END AS y FROM contact_map),
sim AS (SELECT {_G}, {_M}, count(*) AS k, sum(y) AS t FROM b WHERE has GROUP BY ALL),
r AS (SELECT b.*, coalesce(k, 0) - CAST(has AS INT) AS others, t FROM b LEFT JOIN sim ON sim.condition = b.condition AND sim.resolution = b.resolution
 AND sim.chrom = b.chrom AND sim.start = b.start),
x AS (SELECT *, others > 0 AS matched, CASE WHEN others > 0 THEN (t - coalesce(y, 0)) / others END AS x FROM r),
pu AS (SELECT {_G}, replicate, count(*) FILTER (has AND matched) AS n, sum(x) FILTER (has AND matched) AS sx, sum(y) FILTER (has AND matched) AS sy,
 sum(x * x) FILTER (has AND matched) AS sxx, sum(x * y) FILTER (has AND matched) AS sxy, count(y) AS ny, sum(y) AS ty FROM x GROUP BY ALL),
pg AS (SELECT {_G}, sum(n) AS gn, sum(sx) AS gsx, sum(sy) AS gsy, sum(sxx) AS gsxx, sum(sxy) AS gsxy, sum(ny) AS gny, sum(ty) AS gty FROM pu GROUP BY ALL),
lu AS (SELECT pu.*, {_LINE.format('')}, gn, gsx, gsy, gny, gty, {_LINE.format('g')} FROM pu JOIN pg ON {_SAME.format('pu', 'pg')}),
fit AS (SELECT {_G}, replicate, coalesce(slope, gslope, 1) AS slope, coalesce((sy - slope * sx) / n, (gsy - gslope * gsx) / gn, 0) AS icept,
 coalesce(CASE WHEN ny > 0 THEN ty / ny END, CASE WHEN gny > 0 THEN gty / gny END) AS level FROM lu),
s AS (SELECT x.*, round(CASE WHEN matched THEN icept + slope * x ELSE level END, 9) AS pred FROM x JOIN fit ON {_SAME.format('x', 'fit')} AND fit.replicate IS NOT DISTINCT FROM x.replicate),
dn AS (SELECT coalesce(condition, '-') AS c, coalesce(resolution, -1) AS r, pred, min(row_id) AS id, arg_min(weight, row_id) AS w FROM s WHERE has AND pred IS NOT NULL GROUP BY ALL),
ask AS (SELECT DISTINCT coalesce(condition, '-') AS c, coalesce(resolution, -1) AS r, pred FROM s WHERE NOT has AND pred IS NOT NULL),
lo AS (SELECT ask.*, dn.pred AS lp, dn.id AS li, dn.w AS lw FROM ask ASOF LEFT JOIN dn ON ask.c = dn.c AND ask.r = dn.r AND ask.pred >= dn.pred),
hi AS (SELECT lo.*, dn.pred AS hp, dn.id AS hi, dn.w AS hw FROM lo ASOF LEFT JOIN dn ON lo.c = dn.c AND lo.r = dn.r AND lo.pred <= dn.pred),
ch AS (SELECT c, r, pred, CASE WHEN up THEN hi ELSE li END AS donor_id, CASE WHEN up THEN hw ELSE lw END AS w
 FROM (SELECT *, lp IS NULL OR coalesce(hp - pred < pred - lp, FALSE) AS up FROM hi))
SELECT s.row_id, s.condition, s.replicate, s.resolution, s.chrom, s.start, s.weight, CASE WHEN has THEN weight ELSE w END AS filled_value, donor_id IS NOT NULL AS is_filled,
 CASE WHEN donor_id IS NOT NULL THEN CASE WHEN matched THEN 'match' ELSE 'group' END END AS fill_scope, donor_id, CASE WHEN donor_id IS NOT NULL THEN round(exp(s.pred), 6) END AS prediction
FROM s LEFT JOIN ch ON NOT has AND ch.c = coalesce(s.condition, '-') AND ch.r = coalesce(s.resolution, -1) AND ch.pred = s.pred"""

_P3 = """
SELECT chrom1, pos1, count(*) AS n_pairs,
       count(CASE WHEN chrom1 = chrom2 THEN pos2 - pos1 END) AS n_cis,
       min(CASE WHEN chrom1 = chrom2 THEN pos2 - pos1 END) AS min_distance,
       max(CASE WHEN chrom1 = chrom2 THEN pos2 - pos1 END) AS max_distance,
       round(avg(CASE WHEN chrom1 = chrom2 THEN pos2 - pos1 END), 4) AS mean_distance
FROM pairs GROUP BY chrom1, pos1
"""


_FIELD = r'''(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'''
_TYPES = ", ".join(f"'{t}'" for t in PAIR_TYPES)


def _pos_ok(chrom: str, pos: str, size: str) -> str:
    return f"""(({size} IS NOT NULL OR {chrom} = '!') AND ({pos} = '.' OR coalesce(regexp_full_match({pos}, '[0-9]+') AND TRY_CAST({pos} AS HUGEINT) BETWEEN 1 AND {size}, FALSE)))"""


_P5 = f"""
WITH r AS (SELECT line_id, regexp_full_match(line, '{_FIELD}(?:\\t{_FIELD})*') AS closed,
            regexp_extract_all(line, '(?:^|\\t)("(?:[^"]|"")*"|[^\\t]*)', 1) AS raw FROM pairs_raw WHERE NOT starts_with(line, '#')),
v AS (SELECT line_id, closed, len(raw) AS n, {', '.join(f"CASE WHEN starts_with(raw[{k + 1}], chr(34)) THEN replace(substr(raw[{k + 1}], 2, length(raw[{k + 1}]) - 2), chr(34) || chr(34), chr(34)) ELSE raw[{k + 1}] END AS {c}" for k, c in enumerate(FIELDS))} FROM r),
z AS (SELECT v.*, a.size AS size1, b.size AS size2 FROM v LEFT JOIN chrom_sizes a ON a.chrom = v.chrom1 LEFT JOIN chrom_sizes b ON b.chrom = v.chrom2),
p AS (SELECT *, CASE WHEN NOT closed THEN 'quoting' WHEN n <> 12 THEN 'column_count'
  WHEN NOT ({_pos_ok('chrom1', 'pos1', 'size1')} AND {_pos_ok('chrom2', 'pos2', 'size2')} AND strand1 IN ('+', '-') AND strand2 IN ('+', '-') AND pair_type IN ({_TYPES})
    AND regexp_full_match(mapq1, '[0-9]+') AND regexp_full_match(mapq2, '[0-9]+')
    AND coalesce(TRY_CAST(mapq1 AS HUGEINT) <= {MAX_MAPQ} AND TRY_CAST(mapq2 AS HUGEINT) <= {MAX_MAPQ}, FALSE)) THEN 'bad_value' END AS reason FROM z)
"""


ORACLE = {
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_coverage": _P1 + """
SELECT track, chrom, CAST(sum(CASE WHEN kind = 'period' THEN 1 ELSE 0 END) AS BIGINT) AS n_periods,
       CAST(sum(CASE WHEN kind = 'period' THEN to_pos - from_pos ELSE 0 END) AS BIGINT) AS covered,
       CAST(sum(CASE WHEN kind = 'gap' THEN to_pos - from_pos ELSE 0 END) AS BIGINT) AS gap_bases,
       max(CASE WHEN kind = 'gap' THEN to_pos - from_pos END) AS longest_gap
FROM found GROUP BY track, chrom""",
    "p2_found": f"""
SELECT a.row_id FROM contact_map a WHERE NOT {_USABLE.format('a.weight')} AND EXISTS (
  SELECT 1 FROM contact_map b WHERE b.condition = a.condition AND b.resolution = a.resolution AND b.chrom = a.chrom
    AND b.start = a.start AND b.row_id <> a.row_id AND {_USABLE.format('b.weight')})""",
    "p2_filled": _P2,
    "p3_found": "SELECT chrom1, pos1 FROM pairs WHERE chrom1 IS NOT NULL AND pos1 IS NOT NULL GROUP BY chrom1, pos1 "
    "HAVING count(*) * 100 >= (SELECT count(*) FROM pairs)",
    "p3_loci": _P3,
    "p5_found": _P5 + "SELECT line_id, reason FROM p WHERE reason IS NOT NULL",
    "p5_loaded": _P5 + """SELECT line_id, read_id, chrom1, CAST(nullif(pos1, '.') AS BIGINT) AS pos1, chrom2, CAST(nullif(pos2, '.') AS BIGINT) AS pos2,
 strand1, strand2, pair_type, CAST(mapq1 AS INT) AS mapq1, CAST(mapq2 AS INT) AS mapq2 FROM p WHERE reason IS NULL""",
}
