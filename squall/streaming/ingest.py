"""Exactly-once ingestion of raw tower CSV files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squall.sources.io import SENTINEL, TS_FORMAT


def tower_stream(spark: SparkSession, path: str, value_cols: Sequence[str], ts_col: str = "timestampUTC",
                 tower_pattern: str = r"([A-Z]{4})[^/]*\.csv$", max_files: int = 100) -> DataFrame:
    """S1 as a stream: new CSV files under ``path`` become cleaned rows
    (sentinel -> NULL, compact UTC time parsed, footer dropped, tower from
    the file name)."""
    schema = T.StructType([T.StructField(ts_col, T.StringType())] +
                          [T.StructField(c, T.DoubleType()) for c in value_cols])
    raw = (spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", max_files)
           .csv(path))
    ts = F.try_to_timestamp(F.col(ts_col), F.lit(TS_FORMAT))
    return (raw.select(F.regexp_extract(F.input_file_name(), tower_pattern, 1).alias("tower"), ts.alias("ts"),
                       *[F.when(F.col(c) == F.lit(SENTINEL), F.lit(None)).otherwise(F.col(c)).alias(c)
                         for c in value_cols])
            .filter(F.col("ts").isNotNull()))


def ingest(spark: SparkSession, src: str, dst: str, checkpoint: str, value_cols: Sequence[str],
           tower_pattern: str = r"([A-Z]{4})[^/]*\.csv$"):
    """Append every file not yet seen to ``dst`` (Parquet, partitioned by
    tower) and stop (``availableNow``).  The checkpoint (in the shared
    folder) records processed files, so reruns and executor loss neither
    drop nor duplicate rows."""
    q = (tower_stream(spark, src, value_cols, tower_pattern=tower_pattern)
         .writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint)
         .partitionBy("tower").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q
