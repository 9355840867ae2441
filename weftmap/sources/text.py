"""Text formats: pairs, chromosome sizes, BED, bedGraph, GTF, WIG, tables; and the stored map."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types of the known pairs columns; others stay text.
PAIR_TYPES = {**{f"pos{k}": "long" for k in ("1", "2", "51", "31", "52", "32")}, "mapq1": "int", "mapq2": "int"}
GTF_FIELDS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame")


def parse_region(region: str) -> tuple[str, int, int]:
    """``chr8:84,900,000-85,800,000`` -> (chromosome, start, end)."""
    m = re.fullmatch(r"([^:]+):([\d,]+)-([\d,]+)", region)
    if not m:
        raise ValueError(f"not a region: {region}")
    return m[1], int(m[2].replace(",", "")), int(m[3].replace(",", ""))


PAIR_NAMES = {"readID": "read_id"}
_COLUMNS = "#columns:"


def pairs_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header of a pairs file, or of the first one of a folder, wherever Spark can read it.

    The header is the comment lines before the first record; no more than the file's beginning is read.
    """
    file = min(spark.read.text(path).inputFiles(), default=None)
    lines = spark.read.text(file).where(F.col("value").startswith(_COLUMNS) | ~F.col("value").startswith("#")) if file else None
    line = lines.first() if file else None
    if line is None:
        raise ValueError(f"{path} has no header and no records")
    if not line["value"].startswith(_COLUMNS):
        raise ValueError(f"the header of {path} names no columns")
    return line["value"][len(_COLUMNS) :].split()


def _place():
    """Where a line stands: its file, the block of the file, and its number in the task; together they sort as the lines do."""
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")


def read_pairs(spark: SparkSession, path: str, columns: Sequence[str] | None = None, typed: bool = True) -> DataFrame:
    """A pairs file (or a folder of them with the same columns), plain or compressed: fields are parted by any white space, header lines are skipped, ``.`` becomes NULL in typed
    columns, and fields that a short line lacks are NULL. ``columns`` are read from the header where they are not given; readID is called read_id.
    """
    return pairs_rows(spark.read.text(path), columns or pairs_columns(spark, path), typed)


def pairs_rows(lines: DataFrame, columns: Sequence[str], typed: bool = True) -> DataFrame:
    """Records of pairs lines (their only column) as :func:`read_pairs` has them."""
    columns = [PAIR_NAMES.get(c, c) for c in columns]
    line = F.regexp_replace(F.col(lines.columns[0]), r"^\s+|\s+$", "")
    rows = lines.select(line.alias("line")).where(~F.col("line").startswith("#") & (F.col("line") != "")).select(F.split("line", r"\s+").alias("f"))
    kind = {c: PAIR_TYPES[c] for c in columns if typed and c in PAIR_TYPES}
    field = [F.get("f", F.lit(k)) for k in range(len(columns))]
    return rows.select(*[(x.try_cast(kind[c]) if c in kind else x).alias(c) for c, x in zip(columns, field)])


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, size long")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """The first three columns of a BED file."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    return lines.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, value double")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header line; all columns are text, so that the file is read once."""
    return spark.read.csv(path, sep="\t", header=True)


def table_to_bedgraph(df: DataFrame, column: str) -> DataFrame:
    start, end, value = F.col("Start").cast("long"), F.col("End").cast("long"), F.col(column).cast("double")
    return df.select(F.col("Chromosome").alias("chrom"), start.alias("start"), end.alias("end"), value.alias("value"))


def _gtf_value(x):
    """Without quotes; a comma makes a list; '', '.' and 'NA' are NULL."""
    x = F.regexp_replace(x, "^[\"']+|[\"']+$", "")
    return F.when(x.isin("", ".", "NA"), None).otherwise(F.split(x, r"\s*,\s*"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF/GFF: eight typed columns and ``attrs``, a map from key to its values; an attribute without key is INFO and its number."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split(F.rtrim("value"), "\t").alias("f"))
    rows = rows.where(F.size("f") >= 9)
    infos = F.filter(F.split(F.col("f")[8], r"\s*;\s*"), lambda x: F.trim(x) != "")
    pattern = r"(?s)^([^\s=]*)(?:\s+|\s*=\s*)(.*)$"

    def entry(x, k):
        keyed = x.rlike(pattern)
        key = F.when(keyed, F.regexp_extract(x, pattern, 1)).otherwise(F.concat(F.lit("INFO"), (k + 1).cast("string")))
        return F.struct(key.alias("key"), F.when(keyed, F.regexp_extract(x, pattern, 2)).otherwise(x).alias("value"))

    entries = F.filter(F.transform(infos, entry), lambda e: e["value"] != "")
    # Of a repeated key the last value holds.
    last = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    attrs = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), _gtf_value(e["value"]).alias("value"))))
    one = {n: _gtf_value(F.col("f")[k]) for k, n in enumerate(GTF_FIELDS)}
    return rows.select(*[(F.array_join(v, ",").cast("long") if n in ("start", "end") else F.array_join(v, ",")).alias(n) for n, v in one.items()], attrs.alias("attrs"))


def select_wig_track(spark: SparkSession, path: str, track: str | None = None) -> DataFrame:
    """The lines of the first track whose ``track`` line contains ``track`` (of the first one, if None): ``line_no, line``.

    ``line_no`` sorts as the lines do, by file, block of the file and line, however Spark deals them to tasks.
    """
    lines = spark.read.text(path).select("value", *_place()).select("value", F.struct("file", "block", "n").alias("line_no"))
    heads = lines.where(F.col("value").startswith("track"))
    match = F.lit(True) if track is None else F.contains("value", F.lit(track))
    first = heads.where(match).agg(F.min("line_no").alias("first")).scalar()
    after = heads.where(F.col("line_no") > first).agg(F.min("line_no").alias("after")).scalar()
    inside = (F.col("line_no") > first) & F.coalesce(F.col("line_no") < after, F.lit(True))
    return lines.where(inside).select("line_no", F.trim("value").alias("line"))


def declared_columns(lines: DataFrame) -> DataFrame:
    """The columns that each run's header declares, from raw lines (run, line_no, line): ``run, position, column``."""
    first = Window.partitionBy("run").orderBy("line_no")
    heads = lines.where(F.col("line").startswith("#columns:")).withColumn("__k", F.row_number().over(first)).where("__k = 1")
    names = F.filter(F.split(F.substring("line", len("#columns:") + 1, 1 << 20), r"\s+"), lambda x: x != "")
    return heads.select("run", F.posexplode(names).alias("position", "column"))


def find_tracks(spark: SparkSession, folder: str, patterns: Sequence[str] = ("*.bedgraph", "*.bg")) -> dict[str, str]:
    """The track files of a folder by name, in order of their paths, wherever Spark can list it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(f.getPath().toString() for p in patterns for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, p)) or [])
    return {os.path.basename(p): p for p in found}


# ---------------------------------------------------------------- sinks


def write_pairs(df: DataFrame, path: str, header: Sequence[str] = ()) -> None:
    """A folder of tab-separated text files, NULL as ``.``: the first, ``part-00000``, is the header with the column names, so that the files in order are one pairs file."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in df.columns]
    names = _COLUMNS + " " + " ".join({v: k for k, v in PAIR_NAMES.items()}.get(c, c) for c in df.columns)
    head = df.sparkSession.createDataFrame([(line,) for line in [*header, names]], "value string").coalesce(1)
    head.union(df.select(F.concat_ws("\t", *cols))).write.text(path)  # a union's tasks come in its order


def write_bed(df: DataFrame, path: str, split_by: str | None = None) -> None:
    """Tab-separated without header, one folder per value of ``split_by``."""
    w = df.write.partitionBy(split_by) if split_by else df.write
    w.csv(path, sep="\t", header=False)


def write_curves(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.csv(path, header=True)


def write_map(m: DataFrame, path: str, metadata: dict, single: bool = True) -> None:
    """A dense map as Parquet (values as float unless ``single`` is off), its metadata as JSON beside it."""
    (m.withColumn("v", F.col("v").cast("float")) if single else m).write.parquet(f"{path}/cells")
    m.sparkSession.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def read_map(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{path}/metadata", wholetext=True).first()[0])
    return spark.read.parquet(f"{path}/cells").withColumn("v", F.col("v").cast("double")), meta


def write_maps(maps: DataFrame, path: str) -> None:
    """Dense maps of many conditions and regions (condition, region, i, j, v), a folder for each."""
    maps.write.partitionBy("condition", "region").parquet(path)


def read_maps(spark: SparkSession, path: str, conditions: Sequence[str] | None = None, regions: Sequence[str] | None = None) -> DataFrame:
    """The maps of :func:`write_maps`, of some conditions and regions if given; the other folders are not read."""
    df = spark.read.schema("i long, j long, v double, condition string, region string").parquet(path)
    for c, wanted in (("condition", conditions), ("region", regions)):
        df = df.where(F.col(c).isin(*wanted)) if wanted is not None else df
    return df.select("condition", "region", "i", "j", "v")


def write_store(df: DataFrame, path: str, resolution: int) -> None:
    """Bins or pixels of one resolution into a store partitioned by it; a resolution that is there is replaced, others stay."""
    out = df.withColumn("resolution", F.lit(resolution))
    out.write.partitionBy("resolution").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_store(spark: SparkSession, path: str, resolution: int) -> DataFrame:
    df = spark.read.parquet(path).where(F.col("resolution") == resolution).drop("resolution")
    return df


def resolutions(spark: SparkSession, path: str) -> list[int]:
    return sorted(r[0] for r in spark.read.parquet(path).select("resolution").distinct().collect())
