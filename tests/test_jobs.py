"""End-to-end jobs on small raw tower files written by the test."""
import datetime as dt
import os

from pyspark.sql import functions as F

from squall.functions.rules import POOLED_RULES
from squall.plans.jobs import label_tower_files, pooled_event_flags, union_towers
from squall.session import shared_dir
from squall.sources import io as sio

COLS = ["TempC_030m", "PkWSpdMph_030m", "TempC_035m", "PkWSpdMph_035m"]
T0 = dt.datetime(2021, 1, 1)
TEMP_A = [5, -1, -2, -3, -4, -5, -6, -7, -8, -9, 3, 2]
WIND_A = [30, 30, 30, 30, 30, 10, 1, 1, 1, 1, 1, 1]
TEMP_D = [9, 8, 7, 2, 2, 2, 2, 2, 2, 2, 2, 9]
WIND_D = [3, 3, 3, 3, 20, 20, 20, 3, 3, 3, 3, 3]


def _write(base, tower, temp, wind, cols):
    base = base[len("file:"):] if base.startswith("file:") else base
    os.makedirs(base, exist_ok=True)
    with open(os.path.join(base, f"{tower}_2021.csv"), "w") as f:
        f.write("timestampUTC," + ",".join(COLS) + "\n")
        for i, (t, w) in enumerate(zip(temp, wind)):
            vals = {c: -999 for c in COLS}
            vals[cols[0]], vals[cols[1]] = t, w
            ts = (T0 + dt.timedelta(minutes=15 * i)).strftime("%Y%m%d%H%M%S")
            f.write(ts + "," + ",".join(str(vals[c]) for c in COLS) + "\n")
        f.write("end of file,,,,\n")


def _files(spark):
    base = shared_dir(spark, "towers")
    _write(base, "TOWA", TEMP_A, WIND_A, ["TempC_030m", "PkWSpdMph_030m"])
    _write(base, "TOWD", TEMP_D, WIND_D, ["TempC_035m", "PkWSpdMph_035m"])
    return base


def test_label_and_union(spark):
    base = _files(spark)
    out = shared_dir(spark, "labelled_out")
    segs, lab = label_tower_files(spark, base, COLS, out=out)
    got = sorted((r.tower, r.event, r.start.strftime("%H:%M"), r.duration_minutes, r.meets_min_duration)
                 for r in segs.collect())
    assert ("TOWA", "E3_LowTemp_lt0", "00:15", 135.0, True) in got        # -1..-9, closed by 3 at 02:30
    assert ("TOWA", "E4_HighWind_Peak_gt25", "00:00", 75.0, True) in got   # 30 x5, closed at 01:15
    assert ("TOWA", "E5_LowWind_lt2", "01:30", 75.0, False) in got         # open run to the last reading
    assert not [g for g in got if g[0] == "TOWD" and g[1] != "E5_LowWind_lt2"]
    rows = {(r.tower, r.ts.strftime("%H:%M")): r for r in lab.collect()}
    assert rows[("TOWA", "02:30")].event_E3_LowTemp_lt0                    # closing reading labelled (Q1)
    assert rows[("TOWA", "00:15")].active_events == "E3_LowTemp_lt0,E4_HighWind_Peak_gt25"
    assert spark.read.parquet(f"{out}/labelled").count() == 24
    merged, monthly = union_towers(segs)
    assert merged.filter(F.col("event") == "E3_LowTemp_lt0").count() == 1
    assert monthly.filter(F.col("event") == "E3_LowTemp_lt0").first().union_total_minutes == 135.0


def _brute_duration(mask, k):
    return [i >= k - 1 and all(mask[i - k + 1:i + 1]) for i in range(len(mask))]


def test_pooled_flags(spark):
    base = _files(spark)
    readings = sio.read_tower_csv(spark, base, COLS, tower_pattern=r"([A-Z]{4})[^/]*\.csv$")
    wide = pooled_event_flags(readings, ["TOWA", "TOWD"], COLS, block_rows=7).orderBy("ts").collect()
    rules = {r.name: r for r in POOLED_RULES}
    e3 = [a or d for a, d in zip(_brute_duration([t < 3 for t in TEMP_A], 8), _brute_duration([t < 3 for t in TEMP_D], 8))]
    e4 = [a or d for a, d in zip(_brute_duration([w > 19 for w in WIND_A], 2), _brute_duration([w > 19 for w in WIND_D], 2))]
    e5 = [a or d for a, d in zip(_brute_duration([w < 4 for w in WIND_A], 4), _brute_duration([w < 4 for w in WIND_D], 4))]
    assert rules["E3_LowTemp_lt0"].min_hours == 2.0
    assert [r.event_E3_LowTemp_lt0 for r in wide] == e3
    assert [r.event_E4_HighWind_Peak_gt25 for r in wide] == e4
    assert [r.event_E5_LowWind_lt2 for r in wide] == e5
    assert "TOWA_TempC_030m" in wide[0].asDict() and "TOWD_PkWSpdMph_035m" in wide[0].asDict()
