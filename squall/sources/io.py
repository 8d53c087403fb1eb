"""Sources and sinks (S1-S12): raw tower CSVs, labelled tables, optional
side tables, nested station metadata, name-partitioned files, result sinks,
run configuration and run logs.  Everything is ``spark.read`` /
``df.write``; names taken from file paths use ``input_file_name()``."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS_FORMAT = "yyyyMMddHHmmss"   # compact UTC timestamp of the raw tower files
SENTINEL = -999.0               # missing reading in the raw tower files


def read_tower_csv(spark: SparkSession, path: str, value_cols: Sequence[str], ts_col: str = "timestampUTC",
                   tower_pattern: str | None = None) -> DataFrame:
    """Header row, explicit schema (no inference), sentinel -> NULL,
    compact timestamp parsed.  Lines whose time does not parse are no
    readings: the footer, and those that ``read_tower_rejects`` returns.
    ``tower_pattern`` extracts the tower from the file path."""
    df, ts = _tower_lines(spark, path, value_cols, ts_col)
    out = df.select(ts.alias("ts"), *[F.when(F.col(c) == F.lit(SENTINEL), F.lit(None)).otherwise(F.col(c)).alias(c)
                                      for c in value_cols],
                    *([F.regexp_extract(F.input_file_name(), tower_pattern, 1).alias("tower")] if tower_pattern else []))
    return out.filter(F.col("ts").isNotNull())


def _tower_lines(spark: SparkSession, path: str, value_cols: Sequence[str], ts_col: str):
    schema = T.StructType([T.StructField(ts_col, T.StringType())] +
                          [T.StructField(c, T.DoubleType()) for c in value_cols])
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df, F.try_to_timestamp(F.col(ts_col), F.lit(TS_FORMAT))


def read_tower_rejects(spark: SparkSession, path: str, value_cols: Sequence[str], ts_col: str = "timestampUTC",
                       tower_pattern: str | None = None) -> DataFrame:
    """The lines that ``read_tower_csv`` leaves out without being a footer (a
    time text without any digit): their time text and values, to be counted."""
    df, ts = _tower_lines(spark, path, value_cols, ts_col)
    text = F.col(ts_col)
    bad = ts.isNull() & (text.isNull() | text.rlike("[0-9]"))
    return df.where(bad).select(text.alias("time_text"), *value_cols,
                                *([F.regexp_extract(F.input_file_name(), tower_pattern, 1).alias("tower")]
                                  if tower_pattern else []))


def write_tower_csv(df: DataFrame, path: str, ts: str, value_cols: Sequence[str], by: str) -> None:
    """Writer of the raw tower layout (used to round-trip S1): one folder
    per ``by`` value, compact time text, NULL -> sentinel, one footer line."""
    body = df.select(by, F.date_format(ts, TS_FORMAT).alias("timestampUTC"),
                     *[F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)).alias(c) for c in value_cols])
    footer = df.select(by).distinct().select(by, F.lit("END OF DATA").alias("timestampUTC"),
                                             *[F.lit(None).cast("double").alias(c) for c in value_cols])
    body.unionByName(footer).write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def read_labeled(spark: SparkSession, path: str, keys: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Labelled table in, key columns first."""
    df = spark.read.format(fmt).option("header", True).load(path)
    return df.select(*keys, *[c for c in df.columns if c not in keys])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Hadoop-FS existence check (works for any cluster file system)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_auxiliary(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """S3: optional side table; an absent path means 'continue without'."""
    return spark.read.format(fmt).load(path) if path_exists(spark, path) else None


# --- fixed values: fields of the station documents ------------------------------------------------
STATION_FIELDS = T.StructType([T.StructField(n, T.DoubleType()) for n in
                               ("lat", "lon", "easting", "northing", "elevation_m", "elevation_msl_m", "height_m", "slope_deg",
                                "aspect_deg", "canopy_cover_pct", "dist_to_ridge_m")] +
                              [T.StructField(n, T.StringType()) for n in ("name", "terrain_type", "soil_type", "land_use", "color", "region")])
REGION_FIELDS = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "state", "terrain", "climate", "prevailing_wind")] +
                             [T.StructField(n, T.DoubleType()) for n in ("center_lat", "center_lon", "avg_annual_temp_c", "avg_annual_precip_mm")])
# --- end of fixed values --------------------------------------------------------------------------


def _documents(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    schema = T.StructType([T.StructField("tower_coordinates", T.MapType(T.StringType(), STATION_FIELDS)),
                           T.StructField("region_info", REGION_FIELDS)])
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_station_metadata(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Documents ``{"tower_coordinates": {id: {...}}, "region_info": {...}}`` -> one row per
    station (explode of the map)."""
    return _documents(spark, path, multi_line).select(F.explode("tower_coordinates").alias("tower", "m")).select("tower", "m.*")


def read_region_info(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per region (every document of a region repeats it)."""
    return _documents(spark, path, multi_line).where("region_info is not null").select("region_info.*").distinct()


def write_station_metadata(stations: DataFrame, path: str, by: str = "region", regions: DataFrame | None = None,
                           per_document: int = 1000) -> None:
    """Nested metadata documents of at most ``per_document`` stations of one ``by`` group each: a group's
    stations are dealt to documents by a hash of their name and numbered in each share, so a group of
    any size is many small documents and no task holds a whole one. ``regions`` (with REGION_FIELDS,
    ``name`` being the group) goes into every document of its group."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in STATION_FIELDS.fields if f.name in stations.columns]
    sizes = stations.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count(F.lit(1)) / per_document).alias("_shares"))
    d = stations.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_share", F.pmod(F.xxhash64("tower"), F.col("_shares")))
    place = F.row_number().over(Window.partitionBy("_by", "_share").orderBy("tower")) - 1
    docs = d.withColumn("_part", F.floor(place / per_document)).groupBy("_by", "_share", "_part").agg(
        F.map_from_entries(F.collect_list(F.struct("tower", F.struct(*cols)))).alias("tower_coordinates"))
    if regions is not None:
        info = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REGION_FIELDS.fields if f.name in regions.columns])
        docs = docs.join(regions.select(F.col("name").alias("_name"), info.alias("region_info")), F.col("_by").eqNullSafe(F.col("_name")), "left")
        docs = docs.select("tower_coordinates", "region_info")
    else:
        docs = docs.select("tower_coordinates")
    docs.write.mode("overwrite").json(path)


def read_partitioned_by_name(spark: SparkSession, path: str, pattern: str, names: Sequence[str],
                             schema: T.StructType | None = None, fmt: str = "csv") -> DataFrame:
    """Many files in one read; ``names`` come from regex groups of the
    file path (e.g. ``importance_(\\w+)_event_(\\w+)\\.csv``)."""
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    df = r.format(fmt).load(path)
    f = F.input_file_name()
    return df.select("*", *[F.regexp_extract(f, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Result sink (partitioned when asked)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def read_run_config(spark: SparkSession, path: str) -> DataFrame:
    """The settings of written run configurations, one row (file, setting, value) for each; lists
    and nested values as JSON text."""
    docs = spark.read.option("singleVariantColumn", "doc").json(path).select(F.col("_metadata.file_path").alias("file"), "doc")
    rows = docs.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    return rows.select("file", F.col("key").alias("setting"), F.try_variant_get("value", "$", "string").alias("value"))


def write_run_config(spark: SparkSession, config: dict, path: str) -> None:
    """Run settings as one JSON document."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string") \
        .coalesce(1).write.mode("overwrite").text(path)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """S11 source: (file, line_no, line), lines numbered from 0 in each file. A long file is read as
    many splits: a line's number is the lines of the file's earlier splits (one row a split, added up
    by file) plus its place in its own."""
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                     F.col("_metadata.file_block_start").alias("_split"),
                                     F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = d.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_split", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return d.join(splits, ["file", "_split"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "line")


def write_log_lines(lines: DataFrame, path: str, by: str) -> None:
    """Log lines (``by``, line_no, line) as text files, one folder per ``by``, in order."""
    lines.select(by, "line_no", "line").repartition(by).sortWithinPartitions(by, "line_no") \
        .select(by, F.col("line").alias("value")).write.partitionBy(by).text(path)
