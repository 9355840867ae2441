"""The stateless pair operators under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import pairs as P
from ..operators.pairs import valid_pairs


def stream_pairs(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of pairs as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def shifted_valid(stream: DataFrame, sizes: DataFrame, by: int = 65, **filters) -> DataFrame:
    """Shift and filter; row by row, so the same on a stream as on a table."""
    return valid_pairs(P.with_shift(stream, by), sizes, **filters)


def loads_per_window(stream: DataFrame, time: str = "loaded_at", late: str = "30 days", width: str = "1 day") -> DataFrame:
    """Pairs per run and window of loading time; rows later than ``late`` behind the newest are dropped with their state."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("window"), "run").agg(F.count("*").alias("n"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is, appended to a Parquet folder exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
