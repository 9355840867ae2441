"""Queries of problem 4 and the text problems (p6 to p8), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import table
from .leaks import find_leaks
from .packing import containers, pack_documents
from .pieces import split_documents
from .quantiles import _offset, gamma, merge, percentiles, sketch

ALPHA = 0.01
PROBABILITIES = (0.01, 0.25, 0.5, 0.75, 0.99)
CAPACITY = 2048
CHARS = 12_000  # capacity of containers that are filled by characters
LIMIT, OVERLAP = 512, 64


def _metrics():
    """The two positions, their difference in all pairs that have both, and the separation: the difference within a chromosome."""
    difference = F.col("pos2") - F.col("pos1")
    separation = F.when(F.col("chrom1") == F.col("chrom2"), difference)
    return {"pos1": F.col("pos1"), "pos2": F.col("pos2"), "difference": difference, "separation": separation}


def p4_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partial sketches of single runs and days, as they would be kept to be combined later."""
    days = table(spark, sf_dir, "pairs").withColumn("day", F.date_format("loaded_at", "yyyy-MM-dd"))
    return sketch(days, ["run", "day", "chrom1", "strand1"], _metrics(), ALPHA)


def p4_day_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per run, day of loading, chromosome and strand, merged from one partial sketch per hour."""
    keys = ["run", "day", "chrom1", "strand1"]
    hours = table(spark, sf_dir, "pairs").withColumns({"day": F.date_format("loaded_at", "yyyy-MM-dd"), "hour": F.hour("loaded_at")})
    out = percentiles(merge(sketch(hours, [*keys, "hour"], _metrics(), ALPHA), keys), keys, PROBABILITIES, ALPHA)
    return out.withColumn("estimate", F.round("estimate", 3))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per (chrom1, strand1), merged from one partial sketch per run."""
    partial = sketch(table(spark, sf_dir, "pairs"), ["run", "chrom1", "strand1"], _metrics(), ALPHA)
    out = percentiles(merge(partial, ["chrom1", "strand1"]), ["chrom1", "strand1"], PROBABILITIES, ALPHA)
    return out.withColumn("estimate", F.round("estimate", 3))


def p4_run_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per run, merged from one partial sketch per day of loading."""
    days = table(spark, sf_dir, "pairs").withColumn("day", F.to_date("loaded_at"))
    out = percentiles(merge(sketch(days, ["run", "day"], _metrics(), ALPHA), ["run"]), ["run"], PROBABILITIES, ALPHA)
    return out.withColumn("estimate", F.round("estimate", 3))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(pack_documents(table(spark, sf_dir, "documents"), CAPACITY), CAPACITY)


def p6_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), CAPACITY)


def p6_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and characters of every document, packed by its number of characters."""
    placed = pack_documents(table(spark, sf_dir, "documents"), CHARS, size="n_chars")
    return placed.groupBy("doc_id").agg(
        F.count("container_id").alias("n_pieces"), F.sum("n_tokens").alias("n_chars"), F.max("n_tokens").alias("largest"), F.max("token_to").alias("upto"),
    )


def p6_chars_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same containers: how many hold more than they can, whether ids have gaps, and what they hold together."""
    held = containers(pack_documents(table(spark, sf_dir, "documents"), CHARS, size="n_chars"), CHARS)
    return held.agg(
        F.count_if(F.col("used") > CHARS).alias("too_full"), (F.max("container_id") + 1 - F.count("*")).alias("missing_ids"), F.sum("used").alias("n_chars"),
        F.sum("n_pieces").alias("n_pieces"), F.count_if(F.col("used") + F.col("free") != CHARS).alias("miscounted"),
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items that share 12 consecutive words: those whose best passage has no edit."""
    return p7_leaks(spark, sf_dir).where("edits = 0").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 12 words of an item with at most one word changed, inserted or deleted, or more words with an edit in five."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that share 12 consecutive words with another item."""
    items = table(spark, sf_dir, "eval_items")
    found = find_leaks(items, items.withColumnRenamed("item_id", "other_id"), doc_id="item_id", item_id="other_id")
    return found.where("edits = 0 AND item_id <> other_id").select("item_id", "other_id")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(table(spark, sf_dir, "documents"), LIMIT, OVERLAP)


def p8_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: characters covered by its pieces, places between pieces that none covers, pieces over the limit or not cut from their place, and wrong numbers."""
    text = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"))
    pieces = p8_pieces(spark, sf_dir).join(text, "doc_id")
    same = F.expr("substring(whole, int(start_char) + 1, int(end_char - start_char))") == F.col("piece")
    pieces = pieces.select("doc_id", "piece_no", "n_pieces", "start_char", "end_char", "n_tokens", same.alias("same"))
    order = Window.partitionBy("doc_id").orderBy("piece_no")
    apart = F.coalesce(F.col("start_char") > F.lag("end_char").over(order), F.col("start_char") != 0)
    stands = F.coalesce(F.col("start_char") <= F.lag("start_char").over(order), F.lit(False))
    wrong = (F.col("piece_no") != F.row_number().over(order) - 1) | (F.col("n_pieces") != F.count("*").over(Window.partitionBy("doc_id")))
    rows = pieces.withColumns({"apart": apart, "stands": stands, "wrong": wrong})
    return rows.groupBy("doc_id").agg(
        F.max("end_char").alias("covered"), F.count_if("apart").alias("gaps"), F.count_if(F.col("n_tokens") > LIMIT).alias("over_limit"), F.count_if(~F.col("same")).alias("not_the_text"),
        F.count_if(F.col("wrong") | F.col("stands")).alias("out_of_order"),
    )


QUERIES = {f.__name__: f for f in (p4_day_percentiles, p4_sketches, p4_percentiles, p4_run_percentiles, p6_containers, p6_placement, p6_chars, p6_chars_total, p7_found, p7_leaks, p7_items, p8_pieces, p8_cover)}


def _values(keys: str, source: str) -> str:
    return f"""SELECT {keys}, 'pos1' AS metric, CAST(pos1 AS DOUBLE) AS v FROM {source}
  UNION ALL SELECT {keys}, 'pos2', pos2 FROM {source}
  UNION ALL SELECT {keys}, 'difference', pos2 - pos1 FROM {source}
  UNION ALL SELECT {keys}, 'separation', CASE WHEN chrom1 = chrom2 THEN pos2 - pos1 END FROM {source}"""


def _p4(keys: str) -> str:
    g, lg = gamma(ALPHA), f"ln({gamma(ALPHA)!r})"
    qs = ", ".join(f"({q})" for q in PROBABILITIES)
    return f"""
WITH p AS (SELECT *, strftime(loaded_at, '%Y-%m-%d') AS day FROM pairs),
v AS ({_values(keys, 'p')}),
b AS (SELECT {keys}, metric, sign(v) AS sg, CASE WHEN v <> 0 THEN CAST(ceil(ln(abs(v)) / {lg}) AS BIGINT) END AS ex, count(*) AS n
      FROM v WHERE v IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, metric ORDER BY sg, sg * ex ROWS UNBOUNDED PRECEDING) AS upto,
             sum(n) OVER (PARTITION BY {keys}, metric) AS total FROM b),
q AS (SELECT * FROM c, (VALUES {qs}) AS p(q))
SELECT {keys}, metric, CAST(q AS DOUBLE) AS q, CAST(total AS BIGINT) AS n_values,
       round(CASE WHEN sg = 0 THEN 0.0 ELSE sg * pow({g!r}, ex) * {2 / (g + 1)!r} END, 3) AS estimate,
       CAST({ALPHA} AS DOUBLE) AS rel_error
FROM q WHERE floor(q * (total - 1)) < upto AND floor(q * (total - 1)) >= upto - n
"""


def _sketches() -> str:
    keys, lg = "run, day, chrom1, strand1", f"ln({gamma(ALPHA)!r})"
    return f"""
WITH p AS (SELECT *, strftime(loaded_at, '%Y-%m-%d') AS day FROM pairs),
v AS ({_values(keys, 'p')})
SELECT {keys}, metric,
       CASE WHEN v = 0 THEN 0 ELSE CAST(sign(v) AS BIGINT) * (CAST(ceil(ln(abs(v)) / {lg}) AS BIGINT) + {_offset(ALPHA)}) END AS bucket, count(*) AS n
FROM v WHERE v IS NOT NULL GROUP BY ALL"""


ORACLE = {
    "p4_sketches": _sketches(),
    "p4_day_percentiles": _p4("run, day, chrom1, strand1"),
    "p4_percentiles": _p4("chrom1, strand1"),
    "p4_run_percentiles": _p4("run"),
    "p6_chars": f"""
SELECT doc_id, CAST(ceil(coalesce(n_chars, 0) / {CHARS}.0) AS BIGINT) AS n_pieces, coalesce(n_chars, 0) AS n_chars, least(coalesce(n_chars, 0), {CHARS}) AS largest, coalesce(n_chars, 0) AS upto
FROM documents""",
    "p6_chars_total": f"""
SELECT CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS missing_ids, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(ceil(n_chars / {CHARS}.0)) AS BIGINT) AS n_pieces,
 CAST(0 AS BIGINT) AS miscounted FROM documents""",
    "p8_cover": """
SELECT doc_id, length(text) AS covered, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS not_the_text, CAST(0 AS BIGINT) AS out_of_order
FROM documents WHERE length(text) > 0""",
    "p7_items": r"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items),
r AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM w WHERE len(w) >= 12))
SELECT DISTINCT a.item_id, b.item_id AS other_id FROM r a JOIN r b USING (run) WHERE a.item_id <> b.item_id""",
}
