"""Queries that go through the text formats, the map store and the batch factors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..common import fresh_folder, staged, table
from ..functions import pairs as P
from ..operators import maps as M
from ..operators import pairs as O
from ..operators import tracks as T
from ..operators.rawlines import FIELDS
from ..sources import text as S
from . import maps as PM
from .pairs import HIGH, SHOWN
from .pairs import ORACLE as PAIRS_SQL
from .tracks import STEP
from .tracks import _binned

REGION = ("chr1", 10_000_000, 60_000_000)
MIN_ALPHA = 2.0


def pairs_text(spark: SparkSession, d: str) -> DataFrame:
    """The pairs written as pairs text and read back by their header."""
    path = fresh_folder(spark)
    S.write_pairs(table(spark, d, "pairs").select(*SHOWN), path, ["## pairs format v1.0"])
    return S.read_pairs(spark, path)


def pairs_lines(spark, d):
    """Delivered lines taken apart as a pairs file's are: by any white space, without a check of their values."""
    return S.pairs_rows(table(spark, d, "pairs_raw").select("line"), FIELDS, typed=False)


def runs_united(spark, d):
    """Pairs files of single runs, read apart and put together."""
    pairs = table(spark, d, "pairs").select(*SHOWN)
    parts = [pairs.where(F.col("run") == r[0]) for r in pairs.select("run").distinct().where("run IS NOT NULL").collect()] + [pairs.where("run IS NULL")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sizes_text(spark, d):
    path = fresh_folder(spark)
    S.write_bed(table(spark, d, "chrom_sizes").select("chrom", "size"), path)
    return S.read_chrom_sizes(spark, path)


def _bed(spark, d):
    return table(spark, d, "bed").where("chrom IS NOT NULL AND start >= 0 AND start < `end`")


def bed_text(spark, d):
    """Intervals sorted, written as BED with their names behind, and read back."""
    path = fresh_folder(spark)
    S.write_bed(_bed(spark, d).orderBy("chrom", "start", "end").select("chrom", "start", "end", F.coalesce("name", F.lit(".")).alias("name")), path)
    return S.read_bed(spark, path)


def bedgraph_text(spark, d):
    """A table with a header made into a bedGraph, with chromosomes renamed, and read back."""
    path, out = fresh_folder(spark), fresh_folder(spark)
    named = _bed(spark, d).select(F.col("chrom").alias("Chromosome"), F.col("start").alias("Start"), F.col("end").alias("End"), (F.col("bed_id") / 4).alias("depth"))
    named.write.csv(path, sep="\t", header=True)
    S.write_bed(T.renamed_chromosomes(S.table_to_bedgraph(S.read_table(spark, path), "depth"), "x"), out)
    return S.read_bedgraph(spark, out)


def curves_text(spark, d):
    path = fresh_folder(spark)
    S.write_curves(O.distance_curves(table(spark, d, "pairs"), HIGH), path)
    return spark.read.csv(path, header=True, schema="distance long, inward long, outward long, tandem_entry long, tandem_exit long")


def _gtf(spark, d):
    """The intervals as GTF lines, those of every third id as transcripts, read back."""
    path = fresh_folder(spark)
    attrs = F.concat(F.lit('gene_id "G'), "bed_id", F.lit('"; gene_name "'), F.coalesce("name", F.lit("")), F.lit('"; flag'))
    feature = F.when(F.col("bed_id") % 3 == 0, "transcript").otherwise("gene")
    fields = ["chrom", F.coalesce("track", F.lit(".")), feature, (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs]
    _bed(spark, d).select(F.concat_ws("\t", *fields)).write.text(path)
    return S.read_gtf(spark, path)


def gtf_text(spark, d):
    return _gtf(spark, d).select(
        "seqname", "source", "feature", "start", "end", "score", "strand", F.col("attrs")["gene_id"][0].alias("gene_id"), F.col("attrs")["gene_name"][0].alias("gene_name"),
        F.col("attrs")["INFO3"][0].alias("third"),
    )


def genes_in_region(spark, d):
    """Genes that overlap a region: labels, clipped bounds, the names of a set marked, and names as they are shown."""
    chrom, start, end = REGION
    marked = [r[0] for r in _bed(spark, d).where("name IS NOT NULL").groupBy("name").count().orderBy(F.desc("count"), "name").limit(3).collect()]
    return T.genes_in_region(_gtf(spark, d), chrom, start, end, marked).withColumn("shown", P.styled_gene(F.col("label")))


def wig_track(spark, d):
    """Intervals as lines under a line for each of their tracks, and the lines of the first track whose line says so."""
    path = fresh_folder(spark)
    rows = _bed(spark, d).where("track IS NOT NULL")
    heads = rows.select("track").distinct().select("track", F.lit(-1).cast("long").alias("bed_id"), F.concat(F.lit("track name="), "track").alias("line"))
    body = rows.select("track", "bed_id", F.concat_ws(" ", "chrom", "start", "end").alias("line"))
    heads.unionByName(body).orderBy("track", "bed_id").select("line").write.text(path)
    second = rows.select("track").distinct().orderBy("track").limit(2).agg(F.max("track")).first()[0]
    return S.select_wig_track(spark, path, f"name={second}").select("line")


def track_range(spark, d):
    """A track's values over a range, zero where it has none."""
    sizes = table(spark, d, "chrom_sizes")
    runs = O.coverage_runs(O.read_ends(table(spark, d, "pairs"), sizes, by=73)).select("chrom", "start", "end", F.col("depth").cast("double").alias("value"))
    return T.track_range(runs, sizes, *REGION)


def track_range_unknown(spark, d):
    """The same on a chromosome that the assembly does not have: one run without a value."""
    sizes = table(spark, d, "chrom_sizes")
    runs = _binned(spark, d).select("chrom", F.col("x").alias("start"), (F.col("x") + STEP).alias("end"), "value")
    return T.track_range(runs, sizes, "none", *REGION[1:])


def bin_centers(spark, d):
    return M.bin_centers(PM._bins(spark, d), PM.RES)


def bins_differ(spark, d):
    """The bins that the assembly has and one of the chromosomes' reads alone would not have, and the other way round."""
    seen = table(spark, d, "pairs").groupBy(F.col("chrom1").alias("chrom")).agg(F.max("pos1").alias("size")).where("chrom <> '!' AND size IS NOT NULL")
    return M.differing_bins(PM._bins(spark, d), M.make_bins(seen, PM.RES))


def smoothing_width(spark, d):
    """Pairs by the kernel width of their separation in bins."""
    k = F.floor((F.col("pos2") - F.col("pos1")) / 10_000)
    cis = O.cis(table(spark, d, "pairs")).where("pos1 IS NOT NULL AND pos2 IS NOT NULL")
    return cis.groupBy(F.round(P.smoothing_width(k), 6).alias("width")).agg(F.count("*").alias("n"))


def _weighted(spark, d, resolution):
    bins = PM._bins(spark, d, resolution)
    px = M.count_pixels(PM._valid(spark, d), bins, resolution)
    depth = px.select(F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id"), "count").groupBy("bin_id").agg(F.sum("count").alias("s"))
    return bins.join(depth, "bin_id", "left").withColumn("weight", 1 / F.sqrt("s")).drop("s"), px


def _store(spark, d):
    path = fresh_folder(spark)
    for r in (PM.RES, PM.RES * PM.ZOOM):
        api.save_store(*_weighted(spark, d, r), path, r)
    return path


def store_region(spark, d):
    """A region of a stored map, balanced by the weights of its bins."""
    chrom, start, end = REGION
    m = api.ContactMap.from_store(spark, _store(spark, d), PM.RES, f"{chrom}:{start:,}-{end:,}")
    return PM._rounded(m.cells, "v")


def store_region_alpha(spark, d):
    """The same with cells of bins masked whose 1 / weight is too low."""
    chrom, start, end = REGION
    m = api.ContactMap.from_store(spark, _store(spark, d), PM.RES, f"{chrom}:{start}-{end}", min_alpha=MIN_ALPHA)
    return PM._rounded(m.cells, "v")


def store_saved_map(spark, d):
    """The region saved, and loaded again with its place."""
    chrom, start, end = REGION
    path = fresh_folder(spark)
    api.ContactMap.from_store(spark, _store(spark, d), PM.RES, f"{chrom}:{start}-{end}", balance=False).save(path)
    m = api.ContactMap.load(spark, path)
    return m.cells.select(F.lit(m.chrom).alias("chrom"), (F.col("i") * m.resolution + m.start).alias("x"), (F.col("j") * m.resolution + m.start).alias("y"), "v")


def store_neighbor_weights(spark, d):
    """Neighbour weights added to the bins of every resolution of a store."""
    path = _store(spark, d)
    out = None
    for r in api.add_neighbor_weights(spark, path, PM.RES):
        bins = S.read_store(spark, f"{path}/bins", r).select(F.lit(r).alias("resolution"), "bin_id", F.round("weight", PM.DIGITS).alias("weight"), F.round("weight_neighbor", PM.DIGITS).alias("weight_neighbor"))
        out = bins if out is None else out.unionByName(bins)
    return out


def saved_maps(spark, d):
    """Maps of two conditions and all chromosomes, saved, read back and normalised each by its neighbours."""
    path = fresh_folder(spark)
    query, reference = PM._two_maps(spark, d)
    S.write_maps(query.withColumn("condition", F.lit("largest")).unionByName(reference.withColumn("condition", F.lit("rest"))), path)
    return PM._rounded(api.normalized_maps(S.read_maps(spark, path)), "v")


def batch_report(spark, d):
    return M.factor_report(M.batch_factors(*PM._two_maps(spark, d), 3))


def ice_statistics(spark, d):
    """Mean and variance of the row sums that each of three rounds of balancing finds."""
    px = staged(PM._pixels(spark, d))
    bias = PM._bins(spark, d).select("bin_id", F.lit(1.0).alias("bias"))
    out = None
    for k in range(3):
        row = M.ice_statistics(px, bias).select(F.lit(k).alias("round"), F.round("mean", PM.DIGITS).alias("mean"), F.round("variance", PM.DIGITS).alias("variance"))
        out = row if out is None else out.unionByName(row)
        bias = staged(M.ice_step(px, bias))
    return out


def genome_weights(spark, d):
    """Genome-wide weights after the bin filter and three rounds, whatever the variance."""
    done = M.balance_pixels(staged(PM._pixels(spark, d)), PM._bins(spark, d), tol=0.0, max_iter=3)
    return PM._rounded(done.weights.select("bin_id", "chrom", "i", "weight"), "weight")


QUERIES = {f.__name__: f for f in (
    pairs_text, pairs_lines, runs_united, sizes_text, bed_text, bedgraph_text, curves_text, gtf_text, genes_in_region, wig_track, track_range, track_range_unknown, bin_centers,
    bins_differ, smoothing_width, store_region, store_region_alpha, store_saved_map, store_neighbor_weights, saved_maps, batch_report, ice_statistics, genome_weights,
)}

_BED = """FROM bed WHERE chrom IS NOT NULL AND start >= 0 AND start < "end\""""
_DOT = ", ".join(f"coalesce({c}, '.') AS {c}" if c not in ("pos1", "pos2") else c for c in SHOWN)
_C, _S, _E = REGION
_GENES = f"""g AS (SELECT *, CASE WHEN coalesce(name, '') = '' THEN 'G' || bed_id ELSE name END AS label {_BED} AND bed_id % 3 <> 0),
h AS (SELECT name {_BED} AND name IS NOT NULL GROUP BY name ORDER BY count(*) DESC, name LIMIT 3)"""


def _depth_sql(name: str, px: str, bins: str) -> str:
    return f"""{name}_d AS (SELECT bin_id, sum(count) AS s FROM (SELECT bin1_id AS bin_id, count FROM {px} UNION ALL SELECT bin2_id, count FROM {px}) GROUP BY ALL),
{name} AS (SELECT {bins}.*, 1 / sqrt(s) AS weight FROM {bins} LEFT JOIN {name}_d USING (bin_id))"""


_REGION_SQL = f"""{PM._PX}, {_depth_sql('w', 'px', 'bins')}, r AS (SELECT *, i - {_S // PM.RES} AS k FROM w WHERE chrom = '{_C}' AND "end" > {_S} AND start < {_E}),
c AS (SELECT a.k AS i, b.k AS j, coalesce(count, 0) AS n, a.weight AS wa, b.weight AS wb FROM r a JOIN r b ON b.k >= a.k LEFT JOIN px ON bin1_id = a.bin_id AND bin2_id = b.bin_id)"""


def _weights_sql(rounds: int) -> str:
    """The bin filter and rounds of balancing of bins that are a diagonal apart at least."""
    out = f"""{PM._PX}, q AS (SELECT * FROM px WHERE bin2_id > bin1_id),
rw AS (SELECT bin_id, count(*) AS n, sum(count) AS s FROM (SELECT bin1_id AS bin_id, count FROM q UNION ALL SELECT bin2_id, count FROM q) GROUP BY 1),
rc AS (SELECT rw.*, chrom FROM rw JOIN bins USING (bin_id)), cm AS (SELECT chrom, median(s) AS m FROM rc GROUP BY 1),
rl AS (SELECT rc.*, ln(s / m) AS l FROM rc JOIN cm USING (chrom)), md AS (SELECT median(l) AS mid FROM rl), dv AS (SELECT rl.*, l - mid AS dev FROM rl, md),
ma AS (SELECT median(abs(dev)) AS mad FROM dv), ok AS (SELECT bin_id FROM dv, ma WHERE n >= 10 AND s >= 0 AND dev >= -5 * mad),
pp AS (SELECT q.* FROM q JOIN ok a ON a.bin_id = bin1_id JOIN ok b ON b.bin_id = bin2_id), b0 AS (SELECT bin_id, CAST(1 AS DOUBLE) AS bias FROM ok)"""
    for k in range(rounds):
        out += f""",
v{k} AS (SELECT bin1_id, bin2_id, count / (a.bias * b.bias) AS v FROM pp JOIN b{k} a ON a.bin_id = bin1_id JOIN b{k} b ON b.bin_id = bin2_id),
s{k} AS (SELECT bin_id, sum(v) AS s FROM (SELECT bin1_id AS bin_id, v FROM v{k} UNION ALL SELECT bin2_id, v FROM v{k}) GROUP BY 1),
m{k} AS (SELECT avg(s) AS mean FROM s{k} WHERE s <> 0),
b{k + 1} AS (SELECT bin_id, bias * s / mean AS bias FROM b{k} JOIN s{k} USING (bin_id), m{k} WHERE s <> 0)"""
    return out + f"\nSELECT bin_id, chrom, i, round(1 / (bias * sqrt(mean)), {PM.DIGITS}) AS weight FROM bins LEFT JOIN b{rounds} USING (bin_id), m{rounds - 1}"


def _norm_of(m: str) -> str:
    return f"""d0_{m} AS (SELECT region, i, v FROM {m} WHERE j = i + 1), dm_{m} AS (SELECT region, avg(v) AS mean FROM d0_{m} GROUP BY region),
d1_{m} AS (SELECT region, i, greatest(least(v, mean / 0.1), mean * 0.1) AS v FROM d0_{m} JOIN dm_{m} USING (region)),
n0_{m} AS (SELECT region, i, avg(v) AS nf FROM (SELECT * FROM d1_{m} UNION ALL SELECT region, i + 1, v FROM d1_{m}) GROUP BY ALL),
nf_{m} AS ({PM._smooth_sql('n0_' + m, 'nf', True)}),
q_{m} AS (SELECT x.region, x.i, x.j, v / nullif(sqrt(a.nf * b.nf), 0) AS v FROM {m} x LEFT JOIN nf_{m} a ON a.region = x.region AND a.i = x.i LEFT JOIN nf_{m} b ON b.region = x.region AND b.i = x.j),
mn_{m} AS (SELECT region, avg(v) AS mean FROM q_{m} WHERE j = i + 1 GROUP BY region),
o_{m} AS (SELECT q.region, i, j, round(CASE WHEN v / nullif(mean, 0) > 10 THEN 10 ELSE v / nullif(mean, 0) END, {PM.DIGITS}) AS v FROM q_{m} q LEFT JOIN mn_{m} USING (region))"""


def _neighbor_store() -> str:
    fine, coarse = _depth_sql("wf", "px", "bins"), _depth_sql("wc", "pc", "cb")

    def one(res: int, k: int, w: str) -> str:
        return f"""SELECT {res} AS resolution, {w}.bin_id, round({w}.weight, {PM.DIGITS}) AS weight, round({w}.weight / sqrt(nf), {PM.DIGITS}) AS weight_neighbor FROM {w}
LEFT JOIN (SELECT chrom, i, greatest(least(nf, mid * 10), mid / 10) AS nf FROM u{k}, (SELECT median(nf) AS mid FROM u{k})) c ON c.chrom = {w}.chrom AND c.i = {w}.i"""

    up = "u{0} AS (SELECT chrom, i, coalesce(nf, whole) AS nf FROM (SELECT chrom, i // {0} AS i, avg(nf) AS nf FROM nf GROUP BY ALL) JOIN wh USING (chrom))"
    return f"""{PM._PX}, {PM._bins_sql('cb', PM.RES * PM.ZOOM)}, {PM._px_sql('pc', bins='cb', res=PM.RES * PM.ZOOM)}, {fine}, {coarse},
dg AS (SELECT a.chrom, a.i, coalesce(count, 0) * a.weight * b.weight AS v FROM wf a JOIN wf b ON b.chrom = a.chrom AND b.i = a.i + 1 LEFT JOIN px ON px.bin1_id = a.bin_id AND px.bin2_id = b.bin_id),
{PM._SIDES}, nf AS (SELECT chrom, i, avg(v) AS nf FROM sd GROUP BY ALL), wh AS (SELECT chrom, avg(nf) AS whole FROM nf GROUP BY ALL), {up.format(1)}, {up.format(PM.ZOOM)}
{one(PM.RES, 1, 'wf')} UNION ALL {one(PM.RES * PM.ZOOM, PM.ZOOM, 'wc')}"""


def _statistics(rounds: int) -> str:
    base = PM._ice_sql(rounds)
    rows = " UNION ALL ".join(f"SELECT {k} AS round, round(avg(s), {PM.DIGITS}) AS mean, round(var_pop(s), {PM.DIGITS}) AS variance FROM s{k} WHERE s <> 0" for k in range(rounds))
    return base[: base.rindex("\nSELECT")] + "\n" + rows


ORACLE = {
    "pairs_text": f"SELECT {_DOT} FROM pairs",
    "pairs_lines": f"""SELECT {', '.join(f"f[{k + 1}] AS {c}" for k, c in enumerate(FIELDS))} FROM (SELECT string_split_regex(x, '\\s+') AS f
FROM (SELECT regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS x FROM pairs_raw) WHERE x <> '' AND NOT starts_with(x, '#'))""",
    "runs_united": f"SELECT {', '.join(SHOWN)} FROM pairs",
    "sizes_text": "SELECT chrom, size FROM chrom_sizes",
    "bed_text": f"SELECT chrom, start, \"end\" {_BED}",
    "bedgraph_text": f"SELECT 'x' || chrom AS chrom, start, \"end\", bed_id / 4.0 AS value {_BED}",
    "curves_text": PAIRS_SQL["base_ps"],
    "gtf_text": f"""SELECT chrom AS seqname, CASE WHEN track IN ('.', '', 'NA') THEN NULL ELSE track END AS source, CASE WHEN bed_id % 3 = 0 THEN 'transcript' ELSE 'gene' END AS feature,
 start + 1 AS start, "end", CAST(NULL AS VARCHAR) AS score, '+' AS strand, 'G' || bed_id AS gene_id, nullif(coalesce(name, ''), '') AS gene_name, 'flag' AS third {_BED}""",
    "genes_in_region": f"""WITH {_GENES}
SELECT label, greatest(start + 1, {_S}) AS start, least("end", {_E}) AS "end", '+' AS strand, label IN (SELECT name FROM h) AS highlight, upper(label[1]) || lower(label[2:]) AS shown
FROM g WHERE chrom = '{_C}' AND start + 1 <= {_E} AND "end" >= {_S}""",
    "wig_track": f"""SELECT chrom || ' ' || start || ' ' || "end" AS line {_BED} AND track IS NOT NULL
AND track = (SELECT max(track) FROM (SELECT DISTINCT track {_BED} AND track IS NOT NULL ORDER BY track LIMIT 2))""",
    "track_range": f"""WITH r AS ({PAIRS_SQL['coverage_runs']}), x AS (SELECT greatest(start, {_S}) AS start, least("end", {_E}) AS "end", CAST(depth AS DOUBLE) AS value FROM r
 WHERE chrom = '{_C}' AND "end" > {_S} AND start < {_E}),
y AS (SELECT *, coalesce(lag("end") OVER (ORDER BY start), {_S}) AS before FROM (SELECT * FROM x UNION ALL SELECT {_E}, {_E}, NULL))
SELECT * FROM x UNION ALL SELECT before, start, 0.0 FROM y WHERE before < start""",
    "track_range_unknown": f"SELECT CAST({_S} AS BIGINT) AS start, CAST({_E} AS BIGINT) AS \"end\", CAST(NULL AS DOUBLE) AS value FROM (SELECT count(*) FROM chrom_sizes WHERE chrom = 'none' HAVING count(*) = 0)",
    "bin_centers": f"{PM._B} SELECT *, start + {PM.RES} / 2.0 AS x FROM bins",
    "bins_differ": f"""{PM._B}, {PM._bins_sql('ob', PM.RES).replace('FROM chrom_sizes', "FROM (SELECT chrom1 AS chrom, max(pos1) AS size FROM pairs WHERE chrom1 <> '!' GROUP BY 1 HAVING max(pos1) IS NOT NULL)")},
a AS (SELECT bin_id, chrom, start, "end" FROM bins), b AS (SELECT bin_id, chrom, start, "end" FROM ob)
SELECT 'first' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'second', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "smoothing_width": """SELECT round(0.05 * pow(greatest(1, floor((pos2 - pos1) / 10000.0) - 2), 0.5), 6) AS width, count(*) AS n FROM pairs
WHERE chrom1 = chrom2 AND pos1 IS NOT NULL AND pos2 IS NOT NULL GROUP BY 1""",
    "store_region": f"{_REGION_SQL} SELECT '{_C}' AS region, i, j, round(n * wa * wb, {PM.DIGITS}) AS v FROM c",
    "store_region_alpha": f"""{_REGION_SQL} SELECT '{_C}' AS region, i, j, CASE WHEN coalesce(1 / wa >= {MIN_ALPHA}, TRUE) AND coalesce(1 / wb >= {MIN_ALPHA}, TRUE)
 THEN round(n * wa * wb, {PM.DIGITS}) END AS v FROM c""",
    "store_saved_map": f"{_REGION_SQL} SELECT '{_C}' AS chrom, i * {PM.RES} + {_S} AS x, j * {PM.RES} + {_S} AS y, CAST(n AS DOUBLE) AS v FROM c",
    "store_neighbor_weights": _neighbor_store(),
    "saved_maps": f"{PM._TWO}, {_norm_of('ma')}, {_norm_of('mb')} SELECT 'largest' AS condition, * FROM o_ma UNION ALL SELECT 'rest', * FROM o_mb",
    "batch_report": f"""{PM._TWO}{PM._FACTORS} SELECT region, coalesce(printf('%.3f', max(global_factor)), 'nan') AS global_factor, string_agg(coalesce(printf('%.3f', factor), 'nan'), ',' ORDER BY d) AS factors FROM bf GROUP BY region""",
    "ice_statistics": _statistics(3),
    "genome_weights": _weights_sql(3),
}
