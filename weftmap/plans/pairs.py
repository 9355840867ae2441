"""Queries on pair records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..functions import pairs as P
from ..operators import pairs as O

SHIFT = 65
HIGH = 100_000
HEAT = ("chr1", 0, 200_000_000, 1_000_000)


def _pairs(spark, d):
    return table(spark, d, "pairs")


def _sizes(spark, d):
    return table(spark, d, "chrom_sizes")


SHOWN = ("read_id", "run", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "pair_type")


def pairs_shift_orientation(spark: SparkSession, d: str) -> DataFrame:
    return P.with_shift(_pairs(spark, d), SHIFT).select(*SHOWN)


def pairs_shift_median(spark: SparkSession, d: str) -> DataFrame:
    return P.with_median(_pairs(spark, d)).select(*SHOWN)


def pairs_direction(spark: SparkSession, d: str) -> DataFrame:
    s1, s2 = F.col("strand1"), F.col("strand2")
    named = _pairs(spark, d).select(
        P.direction(s1, s2).alias("filter_name"), P.decay_direction(s1, s2).alias("decay_name"), P.plot_direction(s1, s2).alias("plot_name")
    )
    return named.groupBy("filter_name", "decay_name", "plot_name").agg(F.count("*").alias("n"))


def pairs_filter_valid(spark: SparkSession, d: str) -> DataFrame:
    return O.valid_pairs(_pairs(spark, d), _sizes(spark, d)).select(*SHOWN)


def pairs_filter_inward(spark: SparkSession, d: str) -> DataFrame:
    return O.valid_pairs(_pairs(spark, d), _sizes(spark, d), direction="inward", min_distance=100).select(*SHOWN)


def pairs_filter_regions(spark: SparkSession, d: str) -> DataFrame:
    return O.valid_pairs(_pairs(spark, d), _sizes(spark, d), regions=table(spark, d, "bed")).select(*SHOWN)


def pairs_sorted(spark: SparkSession, d: str) -> DataFrame:
    return O.sorted_pairs(_pairs(spark, d)).select(*SHOWN)


def pairs_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows and duplicates of each run; duplicates within one base at either end."""
    marked = O.mark_duplicates(_pairs(spark, d), ["loaded_at", "read_id"])
    return marked.groupBy("run").agg(F.count("*").alias("n"), F.sum(F.col("is_duplicate").cast("long")).alias("n_duplicates"))


def pairs_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The same for duplicates at exactly the same positions."""
    marked = O.mark_duplicates(_pairs(spark, d), ["loaded_at", "read_id"], mismatch=0)
    return marked.agg(F.count("*").alias("n"), F.sum(F.col("is_duplicate").cast("long")).alias("n_duplicates"))


def base_ps(spark: SparkSession, d: str) -> DataFrame:
    return O.distance_curves(_pairs(spark, d), HIGH)


def analyze_pairs(spark: SparkSession, d: str) -> DataFrame:
    return O.raw_and_shifted(_pairs(spark, d), SHIFT, 1000)


def cis_fractions(spark: SparkSession, d: str) -> DataFrame:
    return O.cis_fractions(_pairs(spark, d)).select("n", F.round("frac_cis", 9).alias("frac_cis"), F.round("frac_near", 9).alias("frac_near"))


def windowed_distance(spark: SparkSession, d: str) -> DataFrame:
    return O.windowed_distances(_pairs(spark, d)).withColumn("relative", F.round("relative", 9))


def ends_bed(spark: SparkSession, d: str) -> DataFrame:
    return O.read_ends(_pairs(spark, d), _sizes(spark, d), by=73).select("chrom", "start", "end", "strand")


def ends_bed_median(spark: SparkSession, d: str) -> DataFrame:
    return O.read_ends(_pairs(spark, d), _sizes(spark, d), median=True).select("chrom", "start", "end", "strand")


def ends_bed_split(spark: SparkSession, d: str) -> DataFrame:
    return O.ends_by_length(O.read_ends(_pairs(spark, d), _sizes(spark, d), median=True), 60)


def coverage_runs(spark: SparkSession, d: str) -> DataFrame:
    return O.coverage_runs(O.read_ends(_pairs(spark, d), _sizes(spark, d), by=73))


def coverage_runs_plus(spark: SparkSession, d: str) -> DataFrame:
    return O.coverage_runs(O.read_ends(_pairs(spark, d), _sizes(spark, d), by=73), "+")


def length_heatmap(spark: SparkSession, d: str) -> DataFrame:
    chrom, start, end, step = HEAT
    return O.length_heatmap(_pairs(spark, d), chrom, start, end, bin_size=step).withColumn("log_n", F.round(F.log1p("n"), 9))


QUERIES = {f.__name__: f for f in (
    pairs_shift_orientation, pairs_shift_median, pairs_direction, pairs_filter_valid, pairs_filter_inward, pairs_filter_regions, pairs_sorted,
    pairs_duplicates, pairs_exact_duplicates, base_ps, analyze_pairs, cis_fractions, windowed_distance, ends_bed, ends_bed_median, ends_bed_split,
    coverage_runs, coverage_runs_plus, length_heatmap,
)}

_PLAIN = ", ".join(SHOWN)


def _shown(**expr: str) -> str:
    return ", ".join(f"{expr[c]} AS {c}" if c in expr else c for c in SHOWN)


def _move(k: int, by: int) -> str:
    return f"(CASE WHEN strand{k} = '+' THEN pos{k} + {by} ELSE pos{k} - {by} END)"


def _median(k: int) -> str:
    return f"coalesce(CAST(floor((pos5{k} + pos3{k}) / 2.0) AS BIGINT), pos{k})"


_FILTER_NAME = """CASE WHEN strand1 = '+' AND strand2 = '-' THEN 'inward' WHEN strand1 = '-' AND strand2 = '+' THEN 'outward'
 WHEN strand1 = '+' AND strand2 = '+' THEN 'tandemexit' WHEN strand1 = '-' AND strand2 = '-' THEN 'tandementry' END"""
_P1, _P2 = "coalesce(strand1 = '+', FALSE)", "coalesce(strand2 = '+', FALSE)"
_DECAY_NAME = f"""CASE WHEN {_P1} AND NOT {_P2} THEN 'inward' WHEN NOT {_P1} AND {_P2} THEN 'outward'
 WHEN {_P1} THEN 'tandem_entry' ELSE 'tandem_exit' END"""
_PLOT_NAME = f"CASE WHEN strand1 IN ('+', '-') AND strand2 IN ('+', '-') THEN {_DECAY_NAME} ELSE '' END"


def valid_sql(more: str = "") -> str:
    return f"""SELECT p.* FROM pairs p JOIN chrom_sizes a ON a.chrom = p.chrom1 JOIN chrom_sizes b ON b.chrom = p.chrom2
WHERE pair_type = 'UU' AND strand1 IN ('+', '-') AND strand2 IN ('+', '-') AND pos1 BETWEEN 1 AND a.size AND pos2 BETWEEN 1 AND b.size
AND (chrom1 <> chrom2 OR pos2 - pos1 >= 0) {more}"""


_ENDS = """
ends AS (SELECT chrom1 AS chrom, q1 AS start, q1 + 1 AS "end", strand1 AS strand, abs(pos51 - pos31) AS length FROM ok
         UNION ALL SELECT chrom2, q2, q2 + 1, strand2, abs(pos52 - pos32) FROM ok)"""


def _ends(one: str, two: str) -> str:
    return f"""WITH q AS (SELECT *, {one} AS q1, {two} AS q2 FROM pairs WHERE pair_type = 'UU'),
ok AS (SELECT q.* FROM q JOIN chrom_sizes a ON a.chrom = chrom1 JOIN chrom_sizes b ON b.chrom = chrom2
       WHERE q1 >= 0 AND q1 < a.size AND q2 >= 0 AND q2 < b.size),{_ENDS}
"""


def _runs(where: str) -> str:
    return _ends(_move(1, 73), _move(2, 73)) + f""",
dep AS (SELECT chrom, start AS pos, count(*) AS depth FROM ends {where} GROUP BY ALL),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom, depth ORDER BY pos) AS g FROM dep)
SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", depth FROM isl GROUP BY chrom, depth, g"""


_CIS = f"SELECT *, pos2 - pos1 AS distance, {_DECAY_NAME} AS direction, {_PLOT_NAME} AS plotted FROM pairs WHERE pair_type = 'UU' AND chrom1 = chrom2"

ORACLE = {
    "pairs_shift_orientation": f"SELECT {_shown(pos1=_move(1, SHIFT), pos2=_move(2, SHIFT))} FROM pairs",
    "pairs_shift_median": f"SELECT {_shown(pos1=_median(1), pos2=_median(2))} FROM pairs",
    "pairs_direction": f"SELECT {_FILTER_NAME} AS filter_name, {_DECAY_NAME} AS decay_name, {_PLOT_NAME} AS plot_name, count(*) AS n FROM pairs GROUP BY ALL",
    "pairs_filter_valid": f"SELECT {_PLAIN} FROM ({valid_sql()})",
    "pairs_filter_inward": f"SELECT {_PLAIN} FROM ({valid_sql()}) WHERE strand1 = '+' AND strand2 = '-' AND (chrom1 <> chrom2 OR pos2 - pos1 >= 100)",
    "pairs_filter_regions": f"""WITH r AS (SELECT chrom, start, "end" FROM bed WHERE chrom IS NOT NULL AND start < "end"),
up AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
isl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM up),
per AS (SELECT chrom, min(start) AS s, max("end") AS e FROM isl GROUP BY chrom, g)
SELECT {_PLAIN} FROM ({valid_sql()}) v
WHERE EXISTS (SELECT 1 FROM per WHERE per.chrom = v.chrom1 AND v.pos1 > s AND v.pos1 <= e)
  AND EXISTS (SELECT 1 FROM per WHERE per.chrom = v.chrom2 AND v.pos2 > s AND v.pos2 <= e)""",
    "pairs_sorted": f"SELECT {_PLAIN} FROM pairs ORDER BY chrom1, chrom2, pos1, pos2",
    "pairs_duplicates": """WITH RECURSIVE f AS (SELECT * FROM pairs WHERE chrom1 IS NOT NULL AND chrom2 IS NOT NULL AND strand1 IS NOT NULL
 AND strand2 IS NOT NULL AND pos1 IS NOT NULL AND pos2 IS NOT NULL),
pt AS (SELECT *, row_number() OVER () AS id FROM (SELECT DISTINCT chrom1, chrom2, strand1, strand2, pos1, pos2 FROM f)),
step AS (SELECT a, b FROM (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b) WHERE a <> 0 OR b <> 0),
edge AS (SELECT p.id AS x, q.id AS y FROM pt p, step s JOIN pt q ON q.chrom1 = p.chrom1 AND q.chrom2 = p.chrom2 AND q.strand1 = p.strand1
 AND q.strand2 = p.strand2 AND q.pos1 = p.pos1 + s.a AND q.pos2 = p.pos2 + s.b),
reach AS (SELECT id AS x, id AS y FROM pt UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y),
lab AS (SELECT x AS id, min(y) AS label FROM reach GROUP BY x),
o AS (SELECT f.run, row_number() OVER (PARTITION BY label ORDER BY loaded_at, read_id) AS k
 FROM f JOIN pt USING (chrom1, chrom2, strand1, strand2, pos1, pos2) JOIN lab USING (id))
SELECT run, count(*) AS n, CAST(coalesce(max(d), 0) AS BIGINT) AS n_duplicates
FROM pairs LEFT JOIN (SELECT run, count(*) AS d FROM o WHERE k > 1 GROUP BY run) USING (run) GROUP BY run""",
    "pairs_exact_duplicates": """WITH k AS (SELECT *, chrom1 IS NOT NULL AND chrom2 IS NOT NULL AND strand1 IS NOT NULL AND strand2 IS NOT NULL
 AND pos1 IS NOT NULL AND pos2 IS NOT NULL AS full_key FROM pairs)
SELECT (SELECT count(*) FROM k) AS n, CAST((SELECT count(*) FROM k WHERE full_key) - (SELECT count(*) FROM
 (SELECT DISTINCT chrom1, chrom2, strand1, strand2, pos1, pos2 FROM k WHERE full_key)) AS BIGINT) AS n_duplicates""",
    "base_ps": f"""WITH c AS ({_CIS}), s AS (SELECT range AS distance FROM range({HIGH})),
n AS (SELECT distance, {', '.join(f"count(*) FILTER (direction = '{x}') AS {x}" for x in O.CURVES)} FROM c WHERE distance > 0 AND distance < {HIGH} GROUP BY 1)
SELECT s.distance, {', '.join(f"coalesce({x}, 0) AS {x}" for x in O.CURVES)} FROM s LEFT JOIN n USING (distance)""",
    "analyze_pairs": f"""WITH c AS ({_CIS}), m AS (
 SELECT 'raw' AS kind, plotted AS direction, distance FROM c
 UNION ALL SELECT 'shifted', plotted, CASE plotted WHEN 'inward' THEN distance - {2 * SHIFT} WHEN 'outward' THEN distance + {2 * SHIFT} ELSE distance END FROM c),
n AS (SELECT kind, direction, distance, count(*) AS n FROM m WHERE distance > 0 AND distance < 1000 GROUP BY ALL),
s AS (SELECT kind, direction, range AS distance FROM (VALUES ('raw'), ('shifted')) k(kind), (VALUES {', '.join(f"('{x}')" for x in O.CURVES)}) e(direction), range(1000))
SELECT s.kind, s.direction, s.distance, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (kind, direction, distance)""",
    "cis_fractions": """SELECT count(*) AS n, round(avg(CAST(coalesce(chrom1 = chrom2, FALSE) AS INT)), 9) AS frac_cis,
 round(avg(CASE WHEN chrom1 = chrom2 THEN CAST(coalesce(pos2 - pos1 < 100000, FALSE) AS INT) END), 9) AS frac_near FROM pairs WHERE pair_type = 'UU'""",
    "windowed_distance": f"""WITH c AS ({_CIS}),
n AS (SELECT CAST(floor(pos2 / 200.0) - floor(pos1 / 200.0) AS BIGINT) AS distance, count(*) AS n FROM c WHERE plotted <> '' GROUP BY 1),
f AS (SELECT range AS distance, coalesce(n, 0) AS n FROM range(10) LEFT JOIN n ON n.distance = range)
SELECT distance, n, round(n / nullif((SELECT n FROM f WHERE distance = 1), 0), 9) AS relative FROM f""",
    "ends_bed": _ends(_move(1, 73), _move(2, 73)) + 'SELECT chrom, start, "end", strand FROM ends',
    "ends_bed_median": _ends(_median(1), _median(2)) + 'SELECT chrom, start, "end", strand FROM ends',
    "ends_bed_split": _ends(_median(1), _median(2))
    + "SELECT *, CASE WHEN length < 60 THEN 'below' ELSE 'above' END AS length_class FROM ends WHERE length IS NOT NULL",
    "coverage_runs": _runs(""),
    "coverage_runs_plus": _runs("WHERE strand = '+'"),
    "length_heatmap": f"""WITH e AS (SELECT chrom1 AS chrom, pos51 AS a, pos31 AS b FROM pairs WHERE pair_type = 'UU'
  UNION ALL SELECT chrom2, pos52, pos32 FROM pairs WHERE pair_type = 'UU'),
c AS (SELECT abs(a - b) AS length, greatest(least(a, b), {HEAT[1]}) AS low, least(greatest(a, b), {HEAT[2] - 1}) AS high
      FROM e WHERE chrom = '{HEAT[0]}' AND abs(a - b) BETWEEN 20 AND 80),
x AS (SELECT length, unnest(generate_series(CAST(floor((low - {HEAT[1]}) / {HEAT[3]}.0) AS BIGINT), CAST(floor((high - {HEAT[1]}) / {HEAT[3]}.0) AS BIGINT))) AS xbin
      FROM c WHERE high >= low)
SELECT length, xbin, count(*) AS n, round(ln(1 + count(*)), 9) AS log_n FROM x GROUP BY ALL""",
}
