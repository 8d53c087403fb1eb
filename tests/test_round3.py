"""Pooled forecast job, rules as tables, gaps, and files of a run."""
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL
from squall.functions.rules import FIRST_LABELER_TERMS, TOWER_COLUMNS
from squall.operators import pooled
from squall.operators import rule_table as rt
from squall.operators import settings as so
from squall.operators import stats as st
from squall.plans import queries as Q
from squall.sources import io as sio


def _wide(spark):
    return Q._union_masks(spark, SF_SMALL).select("ts", *Q.WIDE_COLS, *[f"event_{r.name}" for r in Q.GRID_RULES])


def _vectors(df):
    return {(r["event"], r["ts"]): ([None if x is None else round(x, 9) for x in r["features"]], [tuple(t) for t in r["targets"]])
            for r in df.collect()}


def test_pooled_blocks_do_not_show(spark):
    d = _wide(spark)
    whole = _vectors(pooled.pooled_features(d, "ts", Q.WIDE_COLS, Q.GRID_GROUPS, Q.GRID_SETTINGS))
    small = _vectors(pooled.pooled_features(d, "ts", Q.WIDE_COLS, Q.GRID_GROUPS, Q.GRID_SETTINGS, block_rows=13))
    assert len(whole) > 1000
    assert whole == small


def test_one_buffer_window_for_every_feature(spark):
    """The plan has the same windows for one lag as for many: features are array expressions."""
    def windows(lags):
        s = (pooled.EventSettings("hot", 3600, lags, (2,), {"1hr": 1}, "temp", 60.0, "60"),)
        plan = pooled.pooled_features(_wide(spark), "ts", Q.WIDE_COLS, Q.GRID_GROUPS, s)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Window ["), plan.count("collect_list")
    assert windows((1,)) == windows(tuple(range(1, 49)))


def test_reference_settings_by_event():
    groups = {"TempC_030m": ["A_TempC_030m", "B_TempC_030m"], "PkWSpdMph_030m": ["A_PkWSpdMph_030m"]}
    cols = [c for g in groups.values() for c in g]
    e3, e4, _ = pooled.POOLED_SETTINGS
    names = pooled.feature_names(e3, cols, groups)
    assert len(names) == len(set(names)) == 3 * (24 + 16 + 2) + (3 + 2) + 6 + 2
    assert names[-1] == "B_TempC_030m_dist_to_3C"
    assert pooled.feature_names(e4, cols, groups)[-1] == "A_PkWSpdMph_030m_dist_to_20mph"


def test_scored_rows_give_plan_and_metrics_back(spark):
    """Every fit of the plan has its test rows, and metrics follow from the scored rows alone."""
    rows = Q._groups(spark, SF_SMALL).where("event = 'calm'")
    scored, plan = pooled.score_grid(rows, ["event", "horizon"], "ts", 2, Q.ml.TreeSettings(max_iter=2, max_depth=2))
    plan = {(r["event"], r["horizon"], r["fold"]): r for r in plan.collect()}
    metrics = {(r["event"], r["horizon"], r["fold"]): r for r in pooled.grid_metrics(scored, ["event", "horizon"]).collect()}
    got = {}
    for r in scored.collect():
        got.setdefault((r["event"], r["horizon"], r["fold"]), []).append(r)
    assert set(got) == set(metrics) == {k for k, r in plan.items() if r["skipped"] is None} != set()
    assert {k[2] for k in plan} == {0, 1, 2}
    for k, own in got.items():
        assert len(own) == plan[k]["test_rows"]
        assert sum(r["label"] for r in own) == plan[k]["test_positives"]
        assert all(r["predicted"] == (r["prob"] >= r["threshold"]) for r in own)
        tp = sum(r["label"] == 1 and r["predicted"] == 1 for r in own)
        fp = sum(r["label"] == 0 and r["predicted"] == 1 for r in own)
        pos = [r["prob"] for r in own if r["label"] == 1]
        neg = [r["prob"] for r in own if r["label"] == 0]
        assert (metrics[k]["tp"], metrics[k]["fp"]) == (tp, fp)
        if pos and neg:
            auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
            assert math.isclose(metrics[k]["roc_auc"], auc, abs_tol=1e-9)
        weight = ((plan[k]["train_rows"] - plan[k]["train_positives"]) / plan[k]["train_positives"]) ** 0.75
        assert math.isclose(plan[k]["pos_weight"], weight)


def test_groups_that_cannot_be_fitted(spark):
    """Few rows, few positives and no rows are skipped with their reason, not failed."""
    def group(name, n, hits):
        return [(name, "1hr", i, float(i < hits), [float(i), 1.0]) for i in range(n)]
    rows = spark.createDataFrame(group("few", 50, 20) + group("rare", 200, 3) + group("late", 200, 0),
                                 "event string, horizon string, s long, label double, features array<double>") \
        .withColumn("ts", F.timestamp_seconds(F.col("s") * 3600)).drop("s")
    scored, plan = pooled.score_grid(rows, ["event", "horizon"], "ts", 2, Q.ml.TreeSettings(max_iter=1))
    assert {(r["event"], r["skipped"]) for r in plan.collect()} == {
        ("few", "insufficient data"), ("rare", "too few positive events"), ("late", "too few positive events")}
    assert scored.collect() == []


def test_a_series_without_a_column_is_skipped(spark):
    terms, colmap = rt.terms_table(spark, FIRST_LABELER_TERMS), rt.column_map_table(spark, TOWER_COLUMNS)
    present = ["TempC_030m", "PkWSpdMph_030m", "AbsHum_015m", "TempC_035m"]
    got = {(r["series"], r["event"]): (r["available"], r["lacking"]) for r in rt.availability(terms, colmap, present).collect()}
    assert len(got) == 6 * 9
    assert got["TOWA", "E1_TempMoistHaz"] == (True, "")
    assert got["TOWB", "E1_TempMoistHaz"] == (False, "AbsHum")
    assert got["TOWD", "E2_WindChill"] == (False, "PkWSpdMph")
    assert got["TOWF", "E3_LowTemp_lt0"] == (False, "TempC")


def test_nine_rules_on_raw_readings(spark):
    """Rules of the first labeler by hand: limits are strict or not as given, nulls and NaN never hold."""
    h = 3600
    rows = [("TOWA", i * h, t, w, a) for i, (t, w, a) in enumerate(
        [(25.0, 1.0, 21.0)] * 3 + [(24.0, 3.0, 21.0)] + [(4.8, 3.0, None)] * 3 + [(float("nan"), 30.0, 1.0)] * 2 + [(None, 26.0, 1.0)])]
    rows += [("TOWB", i * h, -11.0, 0.4, 30.0) for i in range(5)]
    d = spark.createDataFrame(rows, "tower string, s long, TempC_030m double, PkWSpdMph_030m double, AbsHum_015m double") \
        .withColumn("ts", F.timestamp_seconds("s")).drop("s")
    terms, colmap = rt.terms_table(spark, FIRST_LABELER_TERMS), rt.column_map_table(spark, TOWER_COLUMNS)
    got = {(r["series"], r["event"], r["duration_minutes"]) for r in rt.segments(d, "tower", "ts", terms, colmap).collect()}
    assert got == {("TOWA", "E1_TempMoistHaz", 180.0), ("TOWA", "E5_LowWind_lt2", 180.0), ("TOWA", "E2_WindChill", 180.0),
                   ("TOWA", "E4_HighWind_Peak_gt25", 120.0),
                   *(("TOWB", e, 240.0) for e in ("E2_WindChill", "E3_LowTemp_lt0", "E3_LowTemp_lt-5", "E3_LowTemp_lt-10",
                                                  "E5_LowWind_lt2", "E5_LowWind_lt1", "E5_LowWind_lt0_5") if e != "E2_WindChill")}


@pytest.mark.parametrize("block", [600, 7200, 10 ** 9])
def test_gaps_at_block_borders(spark, block):
    r = random.Random(4)
    rows, want = [], {}
    for key in ("a", "b", None):
        t, n = 0, 0
        for _ in range(120):
            step = r.choice([300, 600, 600, 3600, 3601, 9000])
            if rows and rows[-1][0] == key and step > 3600:
                n += 1
            t += step
            rows.append((key, t))
            want[key, t] = n
    d = spark.createDataFrame(rows, "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {(x["k"], x["t"]): x["gap_group"] for x in rt.gap_groups(d, ["k"], "ts", 60.0, block).collect()}
    assert got == want


def test_a_log_of_many_splits(spark, tmp_path):
    """One file read as many splits has the same numbered lines."""
    lines = {"a.log": [f"line {i} " + "x" * (i % 50) for i in range(3000)], "b.log": [""], "c.log": ["one", "", "three"]}
    for name, text in lines.items():
        (tmp_path / name).write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        d = sio.read_log_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {(r["file"].rsplit("/", 1)[1], r["line_no"]): r["line"] for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, i): line for name, text in lines.items() for i, line in enumerate(text)}


def test_settings_of_mixed_layouts(spark, tmp_path):
    """Nested and flat documents, lists as text, absent fields, fields of a wrong type, other folders."""
    def write(folder, doc):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "best_params.json").write_text(json.dumps(doc))
    write("study_results_lightgbm_20250101_000000", {"A_x": {"params": {"max_depth": 1}, "mcc": 0.1}})
    write("study_results_lightgbm_20250301_000000", {
        "A_x": {"params": {"max_depth": 9, "rolling_windows": "[4, 12]", "reg_alpha": "high"}, "mcc": 0.5, "metrics": {"f1": 0.25}},
        "B_x": {"max_depth": 4, "rolling_windows": [2], "use_rolling": False}})
    write("study_results_xgboost_20250201_000000", {"A_x": {"max_depth": 3, "gamma": 0.5, "unknown": {"a": 1}}})
    write("notes", {"A_x": {"max_depth": 99}})
    found = so.newest_run(so.read_run_settings(spark, str(tmp_path / "*")))
    got = {(r["model"], r["key"]): r for r in found.collect()}
    assert set(got) == {("lightgbm", "A_x"), ("lightgbm", "B_x"), ("xgboost", "A_x")}
    a, b = got["lightgbm", "A_x"], got["lightgbm", "B_x"]
    assert (a["max_depth"], a["rolling_windows"], a["reg_alpha"], a["mcc"], a["metrics"]) == (9, [4, 12], None, 0.5, {"f1": 0.25})
    assert (b["max_depth"], b["rolling_windows"], b["use_rolling"], b["mcc"]) == (4, [2], False, None)
    exps = spark.createDataFrame([(m, k) for m in ("lightgbm", "xgboost") for k in ("A_x", "C_x")], "model string, key string")
    full = {(r["model"], r["key"]): r for r in so.with_defaults(exps, found, ["model", "key"], [4, 96]).collect()}
    assert (full["lightgbm", "A_x"]["reg_alpha"], full["lightgbm", "C_x"]["max_depth"], full["lightgbm", "A_x"]["gamma"]) == (0.0, -1, None)
    assert (full["xgboost", "A_x"]["gamma"], full["xgboost", "C_x"]["max_depth"], full["xgboost", "C_x"]["tuned"]) == (0.5, 6, False)
    assert full["xgboost", "C_x"]["rolling_windows"] == [4, 96]


@pytest.mark.parametrize("block", [1, 7, 100, 10 ** 6])
def test_running_sums_by_size(spark, block):
    """Blocks of any size give the sums of plain Python; a large group, one far value, a null group."""
    r = random.Random(6)
    table = {("g", float(v)): r.randint(1, 5) for v in range(150)} | {("g", 1e15): 3, ("h", 0.5): 2, (None, 1.0): 1, (None, 2.0): 4}
    d = spark.createDataFrame([(k, v, c, -c) for (k, v), c in table.items()], "k string, v double, c long, d long")
    got = {(x["k"], x["v"]): (x["c_before"], x["c_all"], x["d_before"], x["d_all"])
           for x in st.running_sums(d, ["k"], "v", ["c", "d"], block).collect()}
    for (k, v), found in got.items():
        before = sum(c for (g, w), c in table.items() if g == k and w < v)
        whole = sum(c for (g, _), c in table.items() if g == k)
        assert found == (before, whole, -before, -whole)
    assert set(got) == set(table)


def test_no_task_holds_more_than_a_block(spark):
    """However the values lie, a window of the running sums holds at most the given number of them."""
    d = spark.range(5000).select((F.col("id") % 4999).cast("double").alias("v")).unionByName(
        spark.createDataFrame([(1e18,), (-1e18,)], "v double"))
    seen = []
    original = st.carry_join

    def spy(df, *rest):
        seen.append(df.groupBy(st.BLK).count().agg(F.max("count")).first()[0])
        return original(df, *rest)
    st.carry_join = spy
    try:
        got = st.exact_quantiles(d, [], "v", [0.5]).first()[0], st.quantiles_of(
            st.cumulative_value_counts(d, [], "v", 300), [], "v", [0.5]).first()[0]
    finally:
        st.carry_join = original
    assert got[0] == got[1]
    assert seen == [300]


def test_spearman_of_pairs(spark):
    rows = [("a", 1.0, 3.0, 1.0), ("a", 2.0, 1.0, 1.0), ("a", 3.0, 2.0, 5.0), ("a", 3.0, None, 9.0), ("b", 1.0, 1.0, 2.0)]
    d = spark.createDataFrame(rows, "e string, x double, y double, z double")
    got = {(r["e"], r["x"], r["y"]): (r["n"], r["r"]) for r in st.rank_pairs(d, ["e"], [("x", "z"), ("x", "x")]).collect()}
    assert got["a", "x", "x"] == (4, pytest.approx(1.0))
    assert got["a", "x", "z"] == (4, pytest.approx(8 / 9))
    assert got["b", "x", "z"] == (1, None)


def test_station_documents_of_bounded_size(spark, tmp_path):
    """Many stations of one region are many documents of bounded size; every field comes back."""
    rows = [(f"T{i}", "big" if i < 2000 else "small" if i < 2300 else None, 35.0 + i / 1000, float(i), f"Site {i}") for i in range(2400)]
    d = spark.createDataFrame(rows, "tower string, region string, lat double, elevation_msl_m double, name string")
    regions = spark.createDataFrame([("big", "TN", 14.5), ("small", None, 1.0)], "name string, state string, avg_annual_temp_c double")
    sio.write_station_metadata(d, str(tmp_path / "m"), regions=regions, per_document=100)
    docs = [json.loads(line) for f in (tmp_path / "m").glob("*.json") for line in f.read_text().splitlines()]
    assert max(len(x["tower_coordinates"]) for x in docs) <= 100
    assert len(docs) >= 24
    back = sio.read_station_metadata(spark, str(tmp_path / "m")).select("tower", "region", "lat", "elevation_msl_m", "name")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    got = {(r["name"], r["state"], r["avg_annual_temp_c"]) for r in sio.read_region_info(spark, str(tmp_path / "m")).collect()}
    assert got == {("big", "TN", 14.5), ("small", None, 1.0)}


def test_run_config_round_trip(spark, tmp_path):
    sio.write_run_config(spark, {"lags": [1, 2], "device": "cpu", "nested": {"a": 1.5}, "n": 7, "off": None}, str(tmp_path / "c"))
    got = {r["setting"]: r["value"] for r in sio.read_run_config(spark, str(tmp_path / "c")).collect()}
    assert got == {"lags": "[1,2]", "device": "cpu", "nested": '{"a":1.5}', "n": "7", "off": None}


def test_trials_use_their_own_features():
    names = ["a_b_lag1", "a_b_lag12", "a_b_roll2_mean", "a_b_roll12_std", "a_b_diff1", "lag1_x", "hour_sin"]
    trees = Q.ml.TreeSettings()
    assert [names[i] for i in pooled.trial_places(names, pooled.Trial((1,), (), trees))] == ["a_b_lag1", "a_b_diff1", "lag1_x", "hour_sin"]
    assert [names[i] for i in pooled.trial_places(names, pooled.Trial((12,), (2, 12), trees))] == names[1:]


def test_search_stops_poor_trials_and_needs_rows(spark):
    r = random.Random(8)
    rows = []
    for i in range(900):
        x = r.random()
        rows.append((i * 3600, float(x > 0.6), [x, r.random(), 1.0]))
    d = spark.createDataFrame(rows, "s long, label double, features array<double>").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    names = ["v_lag1", "v_lag2", "hour_sin"]
    trials = [pooled.Trial((1,), (), Q.ml.TreeSettings(max_iter=2, max_depth=2)), pooled.Trial((2,), (), Q.ml.TreeSettings(max_iter=2, max_depth=2))]
    got = {x["trial"]: x for x in pooled.search(d, names, "ts", trials, folds=2).collect()}
    assert (got[0]["status"], got[0]["n_folds"], got[1]["status"], got[1]["n_folds"]) == ("best", 2, "stopped early", 1)
    assert got[0]["mean_mcc"] > 0.9 and got[0]["test_mcc"] > 0.9 and got[1]["mean_mcc"] < 0.3
    few = pooled.search(d.limit(499), names, "ts", trials, folds=2).collect()
    assert [(x["mean_mcc"], x["status"]) for x in few] == [(-1.0, "insufficient data")] * 2


def test_boosted_trees_find_the_feature(spark):
    """M3 + M11 + M12: the one informative feature has nearly all gain and the whole drop in AUC."""
    r = random.Random(9)
    rows = [(i, float(a > 0.5), [a, r.random(), 1.0], a) for i, a in enumerate(r.random() for _ in range(600))]
    d = spark.createDataFrame(rows, "_pos long, label double, f array<double>, a double").withColumn("b", F.col("f")[1]).withColumn("c", F.col("f")[2])
    d = Q.ml.assemble(d, ["a", "b", "c"]).withColumn("weight", F.lit(1.0))
    model = Q.ml.gbt(Q.ml.TreeSettings(max_iter=3, max_depth=2)).fit(d.where("_pos < 400"))
    gain = dict(Q.ml.tree_importance(model, ["a", "b", "c"]))
    assert math.isclose(sum(gain.values()), 1.0) and gain["a"] > 0.9 and gain["c"] == 0.0
    got = {x["feature"]: x for x in Q.ml.permutation_importance(model, d.where("_pos >= 400"), ["a", "b", "c"]).collect()}
    assert got["a"]["base_auc"] > 0.95 and got["a"]["auc_drop"] > 0.3
    assert abs(got["b"]["auc_drop"]) < 0.1 and got["c"]["auc_drop"] == 0.0


def test_a_null_horizon_is_a_horizon(spark):
    """Levels of a grouping-sets report are told apart by the grouping, not by nulls."""
    from squall.operators import report
    d = spark.createDataFrame([(None, "m", *[float(i)] * 6) for i in range(3)],
                              "horizon string, model string, cv_auc double, test_auc double, cv_f1 double, test_f1 double, cv_mcc double, test_mcc double")
    assert sorted((x["level"], x["model"]) for x in report.overfit_gap(d).collect()) == [("horizon", None), ("model", "m")]
