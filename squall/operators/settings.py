"""Tuned-settings handling.

Search runs write documents ``{key: {"params": {...}, "mcc": x}}`` into
run folders.  Reading them back is a JSON parse + map explode; the newest
run per model is an aggregate; lookups are a left join with field-by-field
defaults; the shared best-settings file becomes an append-only table whose
latest row per key wins (no locks, no read-modify-write).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_FOLDER = r"([A-Za-z_]+_results_([A-Za-z]+)_\d{8}_\d{6})"

# --- fixed values: settings fields of a search run, and what a found document lacks ---------------
FEATURE_FIELDS = {"lag_config": ("string", "long"), "use_rolling": ("boolean", True)}
MODEL_FIELDS = {
    "lightgbm": {"num_leaves": ("int", 31), "max_depth": ("int", -1), "min_child_samples": ("int", 20),
                 "min_child_weight": ("double", 0.001), "reg_alpha": ("double", 0.0), "reg_lambda": ("double", 0.0),
                 "min_split_gain": ("double", 0.0), "feature_fraction": ("double", 0.9), "bagging_fraction": ("double", 0.8),
                 "bagging_freq": ("int", 5), "learning_rate": ("double", 0.05), "n_estimators": ("int", 1000)},
    "xgboost": {"max_depth": ("int", 6), "min_child_weight": ("double", 1.0), "max_delta_step": ("int", 0),
                "reg_alpha": ("double", 0.0), "reg_lambda": ("double", 1.0), "gamma": ("double", 0.0),
                "subsample": ("double", 0.8), "colsample_bytree": ("double", 0.9), "colsample_bylevel": ("double", 1.0),
                "colsample_bynode": ("double", 1.0), "learning_rate": ("double", 0.05), "n_estimators": ("int", 1000)},
}
# --- end of fixed values --------------------------------------------------------------------------

PARAMS_SCHEMA = ("map<string, struct<params: struct<max_depth: int, learning_rate: double, "
                 "rolling_windows: string>, mcc: double>>")


def parse_settings(docs: DataFrame, doc: str = "doc", schema: str = PARAMS_SCHEMA) -> DataFrame:
    """(model, run_folder, doc) -> one row per key with typed params;
    list-valued params stored as text (``"[4, 12]"``) are parsed, not
    evaluated."""
    d = docs.select("model", "run_folder", F.explode(F.from_json(doc, schema)).alias("key", "v"))
    return d.select("model", "run_folder", "key", F.col("v.params.max_depth").alias("max_depth"),
                    F.col("v.params.learning_rate").alias("learning_rate"),
                    F.from_json(F.col("v.params.rolling_windows"), "array<int>").alias("rolling_windows"),
                    F.col("v.mcc").alias("mcc"))


def all_fields() -> dict[str, str]:
    """Every settings field of any model, with its type."""
    made = {name: kind for name, (kind, _) in FEATURE_FIELDS.items()}
    for fields in MODEL_FIELDS.values():
        made |= {name: kind for name, (kind, _) in fields.items()}
    return made


def read_run_settings(spark: SparkSession, path: str, folder: str = RUN_FOLDER) -> DataFrame:
    """One row per key of the documents under ``path``: (model, run_folder, key, the fields of
    ``all_fields``, rolling_windows, mcc, metrics). Documents are read as they are (VARIANT), so nested
    ones ``{key: {params: {...}, mcc, metrics}}`` and flat ones ``{key: {...}}`` may stand side by side.
    Model and run come from the folder's name; a field that is absent or of another type is null; list
    values may be text."""
    docs = spark.read.option("singleVariantColumn", "doc").json(path).select(
        F.regexp_extract("_metadata.file_path", folder, 1).alias("run_folder"),
        F.regexp_extract("_metadata.file_path", folder, 2).alias("model"), "doc")
    rows = docs.where("run_folder <> ''").lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    nested = F.try_variant_get("value", "$.params", "variant").isNotNull()

    def get(name: str, kind: str) -> Column:
        return F.when(nested, F.try_variant_get("value", f"$.params.{name}", kind)) \
            .otherwise(F.try_variant_get("value", f"$.{name}", kind))

    return rows.select("model", "run_folder", "key", *[get(n, kind).alias(n) for n, kind in all_fields().items()],
                       F.from_json(get("rolling_windows", "string"), "array<int>").alias("rolling_windows"),
                       F.try_variant_get("value", "$.mcc", "double").alias("mcc"),
                       F.try_variant_get("value", "$.metrics", "map<string,double>").alias("metrics"))


def with_defaults(experiments: DataFrame, settings: DataFrame, on: Sequence[str], rolling_windows: Sequence[int]) -> DataFrame:
    """Every experiment with its model's settings, field by field the found value, else the model's
    default (fields of other models stay null); ``tuned`` tells which experiments were found."""
    j = experiments.join(settings, list(on), "left")
    out = []
    for name, kind in all_fields().items():
        value = F.col(name)
        if name in FEATURE_FIELDS:
            value = F.coalesce(value, F.lit(FEATURE_FIELDS[name][1]))
        else:
            chosen = None
            for model, fields in MODEL_FIELDS.items():
                if name in fields:
                    own = F.coalesce(value, F.lit(fields[name][1]).cast(kind))
                    chosen = F.when(F.col("model") == model, own) if chosen is None else chosen.when(F.col("model") == model, own)
            value = chosen
        out.append(value.alias(name))
    windows = F.coalesce("rolling_windows", F.array(*[F.lit(w) for w in rolling_windows]))
    return j.select(*experiments.columns, *out, windows.alias("rolling_windows"), "mcc", "metrics",
                    F.col("run_folder").isNotNull().alias("tuned"))


def newest_run(settings: DataFrame) -> DataFrame:
    """Keep the rows of the newest run folder (by name) per model."""
    newest = settings.groupBy("model").agg(F.max("run_folder").alias("run_folder"))
    return settings.join(newest, ["model", "run_folder"], "left_semi")


def lookup(experiments: DataFrame, settings: DataFrame, on: Sequence[str],
           defaults: Mapping[str, Column]) -> DataFrame:
    """Tuned value where present, else the default, field by field;
    ``tuned`` tells which experiments had settings."""
    j = experiments.join(settings, list(on), "left")
    return j.select(*experiments.columns, *[F.coalesce(F.col(k), v).alias(k) for k, v in defaults.items()],
                    F.col("run_folder").isNotNull().alias("tuned"))


def latest_per_key(history: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Append-only history; the row with the largest version per key."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return history.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
