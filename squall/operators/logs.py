"""Run-log extraction (S11, S12): section headers are carried over the
following lines, metric lines are parsed with regular expressions, and the
rows of one section are folded into one result row.

Lines arrive as (file, line_no, line).  Carries run over blocks of line
numbers (``carry_fill``), so even a very long log is never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squall.operators.blocks import carry_fill

# --- fixed values: patterns of the run log (numbers may be negative) -------
RE_HORIZON = r"FORECAST HORIZON: (\w+)"
RE_EVENT = r"EVENT: ([\w_]+)"
RE_MODEL = r"(LIGHTGBM|XGBOOST) Results:"
RE_CV = r"CV: AUC=(-?[\d.]+), F1=(-?[\d.]+), MCC=(-?[\d.]+)"
RE_TEST = r"Test: AUC=(-?[\d.]+), F1=(-?[\d.]+), MCC=(-?[\d.]+)"
RE_TN_FP = r"TN=\s*([\d,]+).*FP=\s*([\d,]+)"
RE_FN_TP = r"FN=\s*([\d,]+).*TP=\s*([\d,]+)"
RE_IMPORTANCE = r"\d+\.\s+([\w_]+)\s*:\s+(-?[\d.]+)"
# --- end of fixed values ------------------------------------------------------

LINE_BLOCK = 100_000


def _x(pattern: str, idx: int):
    v = F.regexp_extract("line", pattern, idx)
    return F.when(F.col("line").rlike(pattern) & (v != ""), v)


def _count(pattern: str, idx: int):
    return F.regexp_replace(_x(pattern, idx), ",", "").cast("long")


def tag_sections(lines: DataFrame) -> DataFrame:
    """Horizon and event carried forward; the model taken from the next
    '<MODEL> Results:' line for lines printed before it (matrix, importance)
    and from the previous one for lines after it (CV, Test).  The number of
    that results line tells apart sections that occur twice in a file."""
    d = lines.select("file", "line_no", "line", _x(RE_HORIZON, 1).alias("horizon"), _x(RE_EVENT, 1).alias("event"),
                     F.lower(_x(RE_MODEL, 1)).alias("model_prev"))
    d = d.withColumn("section_prev", F.when(F.col("model_prev").isNotNull(), F.col("line_no")))
    d = d.withColumn("model_next", F.col("model_prev")).withColumn("section_next", F.col("section_prev"))
    blk = F.floor(F.col("line_no") / F.lit(LINE_BLOCK))
    return carry_fill(d, ["file"], "line_no", blk, ["horizon", "event", "model_prev", "section_prev"], forward=True,
                      backward_cols=["model_next", "section_next"])


def run_log_metrics(lines: DataFrame) -> DataFrame:
    """One row per section (a '<MODEL> Results:' line, ``section`` being
    its line number) with its horizon, event, model, CV and test AUC/F1/MCC, confusion cells and the derived precision, recall,
    specificity, FPR and FNR (0 when undefined)."""
    d = tag_sections(lines)
    is_after = F.col("line").rlike(RE_CV) | F.col("line").rlike(RE_TEST)
    model = F.when(is_after, F.col("model_prev")).otherwise(F.col("model_next"))
    section = F.when(is_after, F.col("section_prev")).otherwise(F.col("section_next"))
    d = d.select("file", section.alias("section"), "horizon", "event", model.alias("model"),
                 *[_x(RE_CV, i).cast("double").alias(n) for i, n in ((1, "cv_auc"), (2, "cv_f1"), (3, "cv_mcc"))],
                 *[_x(RE_TEST, i).cast("double").alias(n) for i, n in ((1, "test_auc"), (2, "test_f1"), (3, "test_mcc"))],
                 _count(RE_TN_FP, 1).alias("tn"), _count(RE_TN_FP, 2).alias("fp"),
                 _count(RE_FN_TP, 1).alias("fn"), _count(RE_FN_TP, 2).alias("tp"))
    d = d.filter(F.col("horizon").isNotNull() & F.col("event").isNotNull() & F.col("model").isNotNull())
    g = d.groupBy("file", "section", "horizon", "event", "model").agg(
        *[F.max(c).alias(c) for c in ("cv_auc", "cv_f1", "cv_mcc", "test_auc", "test_f1", "test_mcc",
                                      "tn", "fp", "fn", "tp")])
    g = g.filter(F.col("test_auc").isNotNull())
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def r(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return g.select("*", r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"),
                    r(tn, tn + fp).alias("specificity"), r(fp, fp + tn).alias("fpr"), r(fn, fn + tp).alias("fnr"))


def run_log_importance(lines: DataFrame) -> DataFrame:
    """S12: 'rank. feature : value' lines with their section (the number of
    the results line that ends it)."""
    d = tag_sections(lines)
    return (d.filter(F.col("line").rlike(RE_IMPORTANCE) & F.col("horizon").isNotNull()
                     & F.col("event").isNotNull() & F.col("model_next").isNotNull())
            .select("file", F.col("section_next").alias("section"), "horizon", "event", F.col("model_next").alias("model"),
                    F.regexp_extract("line", RE_IMPORTANCE, 1).alias("feature"),
                    F.regexp_extract("line", RE_IMPORTANCE, 2).cast("double").alias("importance")))


def fixed6(x) -> F.Column:
    """Tie-free text form with 6 decimals: integer micro-units, so every
    engine prints the same digits (no half-way rounding)."""
    a = F.abs(x)
    k = F.floor(a * F.lit(1e6) + F.lit(0.5)).cast("long")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), (k / 1000000).cast("long").cast("string"),
                    F.lit("."), F.lpad(F.pmod(k, F.lit(1000000)).cast("string"), 6, "0"))
