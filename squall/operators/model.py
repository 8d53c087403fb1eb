"""Boosted-tree jobs on Spark ML.

The feature table is built once (one window pass), cut from its lineage
with a reliable checkpoint in the shared checkpoint folder, and then every
fold, trial and permutation is an ordinary Spark job on it.  The driver only
loops over a handful of folds/trials and collects metric rows — never
readings.  Scores are evaluated with the exact aggregations of
``squall.operators.evaluate``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squall.operators import evaluate as evl
from squall.session import cut_lineage


@dataclass(frozen=True)
class TreeSettings:
    max_iter: int = 10
    max_depth: int = 3
    step_size: float = 0.1
    subsampling_rate: float = 1.0
    seed: int = 42


def gbt(settings: TreeSettings, features: str = "features", validation: str | None = None) -> GBTClassifier:
    """M3: binary boosted trees with instance weights; with a validation
    indicator column Spark stops adding trees when the validation error no
    longer improves (early stopping)."""
    g = GBTClassifier(featuresCol=features, labelCol="label", weightCol="weight", maxIter=settings.max_iter,
                      maxDepth=settings.max_depth, stepSize=settings.step_size,
                      subsamplingRate=settings.subsampling_rate, seed=settings.seed)
    if validation:
        g = g.setValidationIndicatorCol(validation)
    return g


def assemble(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="skip").transform(df)


def prepare(df: DataFrame, feature_cols: Sequence[str], label: str, order: Sequence[str], ts: str,
            k: int) -> DataFrame:
    """Drop incomplete rows, add time folds, assemble and checkpoint."""
    d = df.na.drop(subset=[*feature_cols, label]).withColumn("label", F.col(label).cast("double"))
    d = evl.assign_folds(d, order, ts, k)
    d = assemble(d, feature_cols)
    return cut_lineage(d.select(*order, "_pos", "n_rows", "test_fold", "label", "features", *feature_cols))


def weighted_train(d: DataFrame, train_end, val_frac: float = 0.1) -> DataFrame:
    """Training rows (position < train_end) with M1 balanced class weights
    and the last ``val_frac`` of them flagged for early stopping."""
    tr = d.filter(F.col("_pos") < train_end)
    c = tr.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    wp, wn = evl.class_weight_balanced(F.col("n"), F.col("p"))
    c = c.select(wp.alias("_wp"), wn.alias("_wn"), F.lit(1).alias("_one"))
    tr = tr.withColumn("_one", F.lit(1)).join(F.broadcast(c), "_one")      # one row
    val_start = train_end - F.floor((train_end) * F.lit(val_frac))
    return tr.select("*", F.when(F.col("label") > 0, F.col("_wp")).otherwise(F.col("_wn")).alias("weight"),
                     (F.col("_pos") >= val_start).alias("is_val")).drop("_one", "_wp", "_wn")


def score(model, rows: DataFrame) -> DataFrame:
    """Scored rows — truth and probability of the positive class."""
    p = model.transform(rows)
    return p.select("*", vector_to_array("probability").getItem(1).alias("prob"))


def fold_metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUC, AP, best-F1 threshold and the ten metrics there, per group."""
    st = evl.score_table(scored, keys, "prob", "label")
    auc = evl.roc_auc(st, keys)
    ap = evl.average_precision(st, keys)
    best = evl.best_threshold_f1(st, keys).withColumnRenamed("f1", "threshold_f1")
    m = evl.metrics_from_cells(best)
    out = m.join(auc, keys).join(ap, keys)
    return out


def cross_validate(d: DataFrame, k: int, settings: TreeSettings, features: str = "features") -> DataFrame:
    """M4: expanding-window CV — fit on every position before fold j's test
    block, score that block.  Returns one metric row per fold (long)."""
    rows = []
    n_rows = F.col("n_rows")
    for j in range(1, k + 1):
        lo, _hi = evl.fold_bounds(n_rows, k, j)
        tr = weighted_train(d, lo)
        model = gbt(settings, features, "is_val").fit(tr)
        te = d.filter(F.col("test_fold") == j)
        s = score(model, te).withColumn("fold", F.lit(j))
        rows.append(fold_metrics(s, ["fold"]))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def tree_importance(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Gain importance by feature name (zero for unused features)."""
    imp = model.featureImportances.toArray()
    return [(n, float(imp[i]) if i < len(imp) else 0.0) for i, n in enumerate(names)]


def permutation_importance(model, test: DataFrame, names: Sequence[str], seed: int = 7919) -> DataFrame:
    """M12 (re-aimed): drop in ROC AUC when one feature's column is permuted
    across the test rows.  The permutation is a bijection of test positions
    (multiplication modulo n by a number that has no factor in common with n), applied by an equi-join on the
    permuted position — no row sampling, one join for all features.  All
    permuted copies are scored in one pass and the AUC is grouped by feature."""
    base = fold_metrics(score(model, test).withColumn("g", F.lit(1)), ["g"]).select("roc_auc").first()[0]
    lo, n = test.agg(F.min("_pos"), F.count(F.lit(1))).first()       # two scalars
    if not n:
        return test.sparkSession.createDataFrame([], "feature string, base_auc double, permuted_auc double, "
                                                     "auc_drop double")
    t = test.withColumn("_tp", F.col("_pos") - F.lit(lo))
    mult = seed
    while math.gcd(mult, n) > 1:
        mult += 1
    # one join brings the row at the permuted position; each copy takes one column from it
    src = t.select(((F.col("_tp") * F.lit(mult) + F.lit(13)) % F.lit(n)).alias("_tp"),
                   *[F.col(c).alias(f"_perm_{c}") for c in names])
    copies = F.explode(F.array(*[F.lit(c) for c in names])).alias("feature")
    both = t.drop("features").join(src, "_tp", "inner").select("label", *names, *[f"_perm_{c}" for c in names], copies)
    allv = both.select("label", *[F.when(F.col("feature") == c, F.col(f"_perm_{c}")).otherwise(F.col(c)).alias(c)
                                  for c in names], "feature")
    allv = VectorAssembler(inputCols=list(names), outputCol="features").transform(allv)
    aucs = fold_metrics(score(model, allv), ["feature"]).select("feature", F.col("roc_auc").alias("permuted_auc"))
    return aucs.select("feature", F.lit(base).cast("double").alias("base_auc"), "permuted_auc",
                       (F.lit(base).cast("double") - F.col("permuted_auc")).alias("auc_drop"))
