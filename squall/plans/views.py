"""Canonical views over the driver's tables (FIXTURES.md §2).

Each view maps a driver table onto the data model the operators expect:
``obs`` (many independent series), ``grid`` (a tower timeline), ``wide`` (the
pooled wide table), ``segments``, ``scored`` (validation rows), ``results``
(score table), ``importance``, ``station``, ``raster``, ``logs``, ``aux``.
All are lazy; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.functions.rules import GRID_RULES
from squall.functions.timecols import exact_mean
from squall.session import ensure_utc

SERIES = ["click", "error", "purchase", "signup", "view"]

# Fixed order of forecast horizons (reference order).
HORIZONS = ["1hr", "3hr", "6hr", "12hr", "24hr", "48hr", "96hr"]
MODELS = {"F": "lightgbm", "O": "xgboost"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long readings: one series per user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("series"), "ts", F.col("event_type").alias("var"), "value")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly tower-like timeline per event type: mean (rounded to 6 places,
    computed exactly so it does not depend on summation order), peak, count."""
    e = table(spark, sf_dir, "events")
    return (e.groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("ts"))
            .agg(exact_mean("value").alias("temp"), F.max("value").alias("peak"),
                 F.count(F.lit(1)).alias("n")))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``grid`` pivoted to one row per hour: ``{series}_temp``, ``{series}_peak``.
    A series outside ``SERIES`` fails the job instead of vanishing."""
    from squall.operators.reshape import pivot_wide
    name = F.col("series")
    other = F.raise_error(F.concat(F.lit("series outside the pivot list: "), F.coalesce(name, F.lit("null"))))
    g = grid(spark, sf_dir).withColumn("series", F.when(name.isin(SERIES), name).otherwise(other))
    return pivot_wide(g, "ts", "series", ["temp", "peak"], SERIES)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from squall.operators.events import event_segments
    return event_segments(grid(spark, sf_dir), ["series"], "ts", GRID_RULES,
                          cols={"temp": F.col("temp"), "peak": F.col("peak")})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows: label, score, model and a unique time order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_returnflag") == "R").alias("label"),
        (F.col("l_discount") * F.lit(10.0)).alias("score"),
        F.col("l_linestatus").alias("model"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


SCORED_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def result_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion cells per (horizon, event, model, split) from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    truth = F.col("l_quantity") > F.lit(25.0)
    pred = F.col("l_extendedprice") > F.lit(40000.0)
    horizon = F.try_element_at(F.array(*[F.lit(h) for h in HORIZONS]), F.col("l_linenumber"))
    model = F.when(F.col("l_linestatus") == "F", F.lit(MODELS["F"])).otherwise(F.lit(MODELS["O"]))
    split = F.when(F.pmod(F.col("l_orderkey"), F.lit(2)) == 0, F.lit("cv")).otherwise(F.lit("test"))
    return (li.groupBy(horizon.alias("horizon"), F.concat(F.lit("event_"), F.col("l_returnflag")).alias("event"),
                       model.alias("model"), split.alias("split"))
            .agg(F.sum((truth & pred).cast("long")).alias("tp"),
                 F.sum((~truth & pred).cast("long")).alias("fp"),
                 F.sum((truth & ~pred).cast("long")).alias("fn"),
                 F.sum((~truth & ~pred).cast("long")).alias("tn")))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score table: cells plus the ten metrics, one row per
    (horizon, event, model, split)."""
    from squall.operators.evaluate import metrics_from_cells
    return metrics_from_cells(result_cells(spark, sf_dir))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-importance rows: feature, tower, event, importance.

    feature = part name + size + a suffix chosen by ``p_partkey % 3``
    (none, ``_lagN``, ``_rollN_mean``)."""
    p = table(spark, sf_dir, "part")
    k = F.pmod("p_partkey", F.lit(3))
    n = (F.pmod("p_size", F.lit(24)) + 1).cast("string")
    suffix = (F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("_lag"), n))
              .otherwise(F.concat(F.lit("_roll"), n, F.lit("_mean"))))
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"),
                    F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("m"), suffix)
    return p.select(name.alias("feature"), F.col("p_brand").alias("tower"), F.col("p_type").alias("event"),
                    F.col("p_retailprice").alias("importance"))


def station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension from supplier: UTM easting/northing, ground
    elevation and mast height; ``tower`` = 'Brand#<suppkey>' so stations
    meet the importance rows of the same number."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.concat(F.lit("Brand#"), F.col("s_suppkey").cast("string")).alias("tower"),
                    (F.lit(740000.0) + F.lit(100.0) * F.col("s_suppkey")).alias("easting"),
                    (F.lit(3978000.0) + F.lit(300.0) * F.col("s_nationkey")).alias("northing"),
                    (F.lit(250.0) + (F.col("s_acctbal") + F.lit(1000.0)) / F.lit(100.0)).alias("elevation_m"),
                    (F.lit(10.0) * (F.pmod("s_nationkey", F.lit(4)) + 1)).alias("height_m"),
                    F.col("r_name").alias("region")))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation grid cells (x, y, z) from the embedding vectors."""
    e = table(spark, sf_dir, "embeddings")
    return (e.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
            .select(F.col("pos").cast("long").alias("x"), F.col("vec_id").alias("y"),
                    (F.lit(100.0) * F.col("v").cast("double")).alias("z")))


def aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly side table: mean of the JSON field k per hour."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")      # unparsable -> NULL (ANSI-safe)
    return (e.select(F.date_trunc("hour", "ts").alias("ts"), k.alias("k"))
            .groupBy("ts").agg(exact_mean("k").alias("aux_k")))





def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log lines (file, line_no, line) written from the score table in
    the writer's layout: headers, confusion matrix and importance lines
    before '<MODEL> Results:', CV and test lines after it."""
    from squall.operators.logs import fixed6
    from squall.operators.report import horizon_table, with_rates
    r = with_rates(results(spark, sf_dir))
    ht = horizon_table(results(spark, sf_dir), "horizon", "event", "model", "split")
    cells = r.filter(F.col("split") == "test").select("horizon", "event", "model", "tn", "fp", "fn", "tp", "kappa")
    b = ht.join(cells, ["horizon", "event", "model"], "inner")
    lines = F.array(
        F.concat(F.lit("FORECAST HORIZON: "), F.col("horizon")),
        F.concat(F.lit("EVENT: "), F.col("event")),
        F.lit("Confusion Matrix:"),
        F.format_string("  TN= %,d | FP= %,d", F.col("tn"), F.col("fp")),
        F.format_string("  FN= %,d | TP= %,d", F.col("fn"), F.col("tp")),
        F.lit("Top 20 Most Important Features (SHAP):"),
        F.concat(F.lit("  1. f1 : "), fixed6(F.col("test_f1"))),
        F.concat(F.lit("  2. mcc : "), fixed6(F.col("test_mcc"))),
        F.concat(F.lit("  3. kappa : "), fixed6(F.col("kappa"))),
        F.concat(F.upper(F.col("model")), F.lit(" Results:")),
        F.concat(F.lit("  CV: AUC="), fixed6(F.col("cv_auc")), F.lit(", F1="), fixed6(F.col("cv_f1")),
                 F.lit(", MCC="), fixed6(F.col("cv_mcc"))),
        F.concat(F.lit("  Test: AUC="), fixed6(F.col("test_auc")), F.lit(", F1="), fixed6(F.col("test_f1")),
                 F.lit(", MCC="), fixed6(F.col("test_mcc"))))
    order = F.array_position(F.array(*[F.lit(h) for h in HORIZONS]), F.col("horizon"))
    from pyspark.sql import Window
    blk = F.row_number().over(Window.orderBy(order, "event", "model"))   # one row per experiment
    b = b.select(blk.alias("_b"), lines.alias("_lines"))
    return b.select("_b", F.lit("run.log").alias("file"), F.posexplode("_lines").alias("_p", "line")).select(
        "file", (F.col("_b") * 100 + F.col("_p")).cast("long").alias("line_no"), "line")
