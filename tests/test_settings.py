"""Tuned-settings parsing, newest run, defaults and latest-per-key."""
import json

from pyspark.sql import functions as F

from squall.operators import settings as so


def test_settings_flow(spark):
    docs = [("xgboost", "runs_20251201", json.dumps({"TOWA_event_E3": {"params": {"max_depth": 4, "learning_rate": 0.1,
                                                                                 "rolling_windows": "[4, 12]"}, "mcc": 0.7}})),
            ("xgboost", "runs_20251203", json.dumps({"TOWA_event_E3": {"params": {"max_depth": 6, "learning_rate": 0.05,
                                                                                 "rolling_windows": "[4, 12, 24]"}, "mcc": 0.72}})),
            ("lightgbm", "runs_20251202", json.dumps({"TOWB_event_E4": {"params": {"max_depth": 3, "learning_rate": 0.2,
                                                                                  "rolling_windows": "[96]"}, "mcc": 0.3}}))]
    d = spark.createDataFrame(docs, "model string, run_folder string, doc string")
    parsed = so.parse_settings(d)
    assert parsed.filter(F.col("run_folder") == "runs_20251203").first().rolling_windows == [4, 12, 24]
    newest = so.newest_run(parsed)
    assert sorted(r.run_folder for r in newest.collect()) == ["runs_20251202", "runs_20251203"]
    exps = spark.createDataFrame([("xgboost", "TOWA_event_E3"), ("xgboost", "TOWB_event_E4")], "model string, key string")
    got = {r.key: r for r in so.lookup(exps, newest, ["model", "key"],
                                      {"max_depth": F.lit(6), "learning_rate": F.lit(0.05)}).collect()}
    assert got["TOWA_event_E3"].max_depth == 6 and got["TOWA_event_E3"].tuned
    assert got["TOWB_event_E4"].max_depth == 6 and not got["TOWB_event_E4"].tuned     # default, not tuned
    latest = so.latest_per_key(parsed, ["model", "key"], "run_folder").collect()
    assert {(r.model, r.key, r.mcc) for r in latest} == {("xgboost", "TOWA_event_E3", 0.72), ("lightgbm", "TOWB_event_E4", 0.3)}
