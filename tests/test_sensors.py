"""Made sensor logs through all parsers to long features."""

from __future__ import annotations

import collections
import datetime
import math
import random

import numpy as np

from vesper.functions.constants import WINDOWS
from vesper.operators import places, stats
from vesper.plans import features
from vesper.sources import tables


def logs(spark, folder):
    at = lambda h, d=1: datetime.datetime(2024, 6, d, h)
    made = {
        "mLight": (spark.createDataFrame([("a", at(0), 1.0), ("a", at(22), float("nan")), ("b", at(9), 3.0)], "subject_id string, timestamp timestamp_ntz, m_light double")),
        "wPedo": (spark.createDataFrame([("a", at(7), 10, 1.0), ("a", at(23), 5, 0.5)], "subject_id string, timestamp timestamp_ntz, step int, burned_calories double")),
        "wHr": (spark.createDataFrame([("a", at(3), [60, 70]), ("a", at(4), []), ("a", at(5), None)], "subject_id string, timestamp timestamp_ntz, heart_rate array<int>")),
        "mAmbience": (spark.createDataFrame([("a", at(10), [["Speech", "0.7"]])], "subject_id string, timestamp timestamp_ntz, m_ambience array<array<string>>")),
        "mUsageStats": (spark.createDataFrame([("a", at(1), [("YouTube", 5.0)])], "subject_id string, timestamp timestamp_ntz, m_usage_stats array<struct<app_name:string,total_time:double>>")),
        "mGps": (spark.createDataFrame([("a", at(2), [(1.0, 2.0, 0.0, 0.0)]), ("a", at(12), [(4.0, 6.0, 0.0, 1.0)])], "subject_id string, timestamp timestamp_ntz, m_gps array<struct<latitude:double,longitude:double,altitude:double,speed:double>>")),
        "mWifi": (spark.createDataFrame([("a", at(2, d), [("x", -50.0), ("y", -80.0)] if d == 1 else [("x", -60.0)]) for d in range(1, 22)], "subject_id string, timestamp timestamp_ntz, m_wifi array<struct<bssid:string,rssi:double>>")),
        "mBle": (spark.createDataFrame([("a", at(19), [("z", -50.0)])], "subject_id string, timestamp timestamp_ntz, m_ble array<struct<address:string,rssi:double>>")),
    }
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{folder}/ch2025_{name}.parquet")
    return tables.sensors(spark, str(folder))


def test_sensor_features(spark, tmp_path):
    found = logs(spark, tmp_path)
    assert sorted(found) == ["mAmbience", "mBle", "mGps", "mLight", "mUsageStats", "mWifi", "wHr", "wPedo"]
    got = {(r["subject_id"], str(r["lifelog_date"]), r["feature"]): r["value"] for r in features.sensor_features(found).collect()}
    f = lambda name, s="a", d="2024-06-01": got.get((s, d, name))
    assert f("mLight_m_light_count") == 1 and f("mLight_m_light_sum") == 1 and f("mLight_prebed_21_24_m_light_sum") == 0
    assert f("mLight_row_count") == 2 and f("mLight_row_count_day") == 0
    assert f("wHr_deep_03_06_heart_rate_mean_mean") == 65 and f("wHr_heart_rate_len_sum") == 2
    assert f("mGps_day_09_18_gps_home_distance_mean") == 5.0
    assert f("mAmbience_day_09_18_ambience_speech_score_mean") == 0.7 and f("semantic_social_day_speech") == 0.7
    assert f("wPedo_prebed_21_24_to_sleep_21_09_step_sum_diff") == 10
    assert abs(f("mWifi_wifi_familiar_ratio_mean") - 0.5) < 1e-5
    assert f("semantic_app_late_social_time") == 0 and f("mUsageStats_late_00_03_usage_media_time_sum") == 5


def test_ratio_gate_and_zero_fill(spark):
    rows = [("a", f"2024-06-{1 + i % 2:02d}", "few", float(i % 3)) for i in range(12)] + [("a", "2024-06-01", "many", float(i)) for i in range(13)] + [("b", "2024-06-01", "few", None)]
    df = spark.createDataFrame(rows, "subject_id string, lifelog_date string, column string, value double")
    got = stats.value_proportions(df, []).collect()
    assert {r["column"] for r in got} == {"few"} and {r["subject_id"] for r in got} == {"a"}
    assert abs(sum(r["ratio"] for r in got) - 2) < 1e-9


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "subject_id string, timestamp timestamp_ntz, x double")
    assert stats.table_features(stats.keyed(empty), "t").count() == 0


def test_window_statistics_by_counts(spark):
    """Against plain Python: ties, nulls, NaN, infinities, single values and windows that hold nulls alone."""
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), -0.0, 0.0, 1e12]
    rows = [(s, datetime.datetime(2024, 6, 1 + rng.randrange(2), rng.randrange(24), rng.randrange(60)), rng.choice([rng.gauss(0, 1), float(rng.randrange(4))])) for s in "ab" for _ in range(300)]
    rows += [("c", datetime.datetime(2024, 6, 1, h), odd[h % 6]) for h in (0, 1, 2, 6, 7, 12, 18)] + [("d", datetime.datetime(2024, 6, 1, 4), None)]
    df = stats.keyed(spark.createDataFrame(rows, "subject_id string, timestamp timestamp_ntz, x double"))
    got = {(r["subject_id"], r["lifelog_date"], r["window"]): r for r in stats.window_stats(df, ["x"]).collect()}
    groups = {}
    for s, at, x in rows:
        for w, hours in WINDOWS.items():
            if at.hour in hours:
                groups.setdefault((s, at.date(), w), []).append(x)
    assert got.keys() == groups.keys()
    same = lambda a, b: a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)))
    for key, values in groups.items():
        x = np.sort(np.array([v for v in values if v is not None], dtype=float))  # NaN last, as in Spark
        with np.errstate(invalid="ignore"):
            low, high = (x[(len(x) - 1) // 2], x[len(x) // 2]) if len(x) else (None, None)
            want = {
                "mean": x.mean() if len(x) else None, "std": x.std(ddof=1) if len(x) > 1 else None, "min": x[0] if len(x) else None, "max": x[-1] if len(x) else None,
                "median": low if low == high else (low + high) / 2, "sum": x.sum() if len(x) else 0.0, "count": float(len(x)), "nunique": float(len(np.unique(x))),
            }
        for name, v in want.items():
            assert same(got[key][name], v), (key, name, got[key][name], v)


def test_familiar_ids_by_join(spark):
    """Scans that repeat an id, null ids and subjects, empty and null scans, and a subject with half of all scans."""
    rng = random.Random(6)
    scans = [(rng.choice(["hot", "hot", "a", "b", None]), i, None if i % 17 == 0 else [(rng.choice([None, *map(str, range(30))]), -60.0) for _ in range(i % 5)]) for i in range(900)]
    df = spark.createDataFrame(scans, "subject_id string, i int, m_wifi array<struct<bssid:string,rssi:double>>")
    got = {r["i"]: r for r in places.network_features(df, "m_wifi", "bssid", "wifi", 20).collect()}
    seen = collections.Counter((s, x) for s, _, cell in scans if s for x, _ in cell or [] if x)
    assert len(got) == len(scans) and len({n >= 20 for n in seen.values()}) == 2
    for s, i, cell in scans:
        own = {x for x, _ in cell or [] if x}
        ratio = sum(seen[s, x] >= 20 for x in own) / (len(own) + 1e-6)
        assert abs(got[i]["wifi_familiar_ratio"] - ratio) < 1e-12 and got[i]["wifi_unique_count"] == len(own)
