"""Helpers shared by the operators: names, staged tables, running totals."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores appended until no column of ``taken`` has it (case-insensitive)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors of this application, once, so that its tasks can import it wherever they start.

    As ``spark-submit --py-files`` would; the archive lies beside the driver only until Spark has taken it over.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        name = os.path.basename(root)
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{name}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.relpath(path, os.path.dirname(root)))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and the executors are this process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_CLEARED: set[str] = set()


def _staging_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _CLEARED:  # results read staged tables until the application ends
        _CLEARED.add(app)
        atexit.register(_drop_at_end, spark, app)
    return os.path.join(shared_dir(spark), "weftmap", spark.sparkContext.applicationId)


def _drop_at_end(spark: SparkSession, app: str) -> None:
    try:
        if spark.sparkContext.applicationId == app:
            drop_staged(spark)
    except Exception:  # the context is gone already, and its folder is the cluster's to clear
        pass


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, among what the application staged."""
    return os.path.join(_staging_folder(spark), uuid.uuid4().hex)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application staged, once no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_staging_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: later reads neither recompute the plan nor see floating-point
    sums in another order, and a lost executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of one staged table that nothing reads any more, such as a finished round's."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if f"/weftmap/{spark.sparkContext.applicationId}/" in folder + "/":
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_totals(df: DataFrame, keys: Sequence[str], value: str, totals: Mapping[str, str], cell: Column) -> DataFrame:
    """Add a column for each of ``totals`` (result -> weight): the sum of the weight over the rows of the same ``keys`` up to ``value``.

    ``df`` has one row per (keys, value) and ``cell`` never decreases with ``value``. Two levels:
    a window inside each (keys, cell) and one over the cells' sums, so that no task has to hold
    all the rows of a key. Rows with a NULL key are the caller's to remove.
    """
    k = [col(c) for c in keys]
    inside = Window.partitionBy(*k, "__cell").orderBy(col(value))
    rows = df.withColumn("__cell", cell).withColumns({out: F.sum(w).over(inside) for out, w in totals.items()})
    cells = df.groupBy(*k, cell.alias("__cell")).agg(*[F.sum(w).alias(f"__{out}") for out, w in totals.items()])
    before = Window.partitionBy(*k).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*k, "__cell", *[F.coalesce(F.sum(f"__{out}").over(before), F.lit(0)).alias(f"__{out}") for out in totals])
    joined = rows.join(cells, [*keys, "__cell"])
    return joined.withColumns({out: col(out) + F.col(f"__{out}") for out in totals}).drop("__cell", *[f"__{out}" for out in totals])
