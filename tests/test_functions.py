"""Edges of the array parsers and scalar functions on small fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vesper.functions import arrays, scalars
from vesper.functions.constants import WINDOWS
from vesper.plans import modes
from vesper.sources import tables


def one(spark, cell, kind, parser):
    return spark.createDataFrame([(1, cell)], f"i int, c {kind}").select(parser(F.col("c")).alias("s")).first()["s"]


@pytest.mark.parametrize("cell", [None, [], [float("nan")], [None, float("inf")]])
def test_list_without_values(spark, cell):
    got = one(spark, cell, "array<double>", arrays.list_stats).asDict()
    assert got.pop("len") == 0 and set(got.values()) == {None}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=12))
def test_list_stats_like_numpy(spark, cell):
    got = one(spark, cell, "array<double>", arrays.list_stats)
    x = np.array(cell)
    p10, median, p90 = np.percentile(x, [10, 50, 90])
    want = [len(x), x.mean(), x.std(), x.min(), x.max(), median, p10, p90, x.max() - x.min(), p90 - median, median - x.min()]
    assert np.allclose(list(got), want, rtol=1e-9, atol=1e-6)


def test_ambience_ties_and_substrings(spark):
    kind = "array<array<string>>"
    got = one(spark, [["carnival", "0.5"], ["Speech", "0.5"], ["Dog", "0.5"], ["x", "no"], ["y"]], kind, arrays.ambience)
    assert got["label_count"] == 3 and got["vehicle_score"] == 0.5 and got["top_is_speech"] == 1 and got["top_is_vehicle"] == 0
    got = one(spark, [["Dog", "0.9"], ["Speech", "0.5"]], kind, arrays.ambience)
    assert got["top_score"] == 0.9 and all(got[f"top_is_{g}"] == 0 for g in ("speech", "silence", "music"))
    assert one(spark, None, kind, arrays.ambience)["label_count"] == 0


def test_app_category(spark):
    names = {"X": "social", "matrix": "other", "  YouTube ": "media", "Naver": "browser_search", "": "other"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", arrays.app_category(F.col("n")).alias("c")).collect()
    assert {r["n"]: r["c"] for r in got} == names


def test_gps_and_network_edges(spark):
    point = "struct<latitude:double,longitude:double,altitude:double,speed:double>"
    none = one(spark, None, f"array<{point}>", arrays.gps)
    assert none["point_count"] == 0 and none["latitude_mean"] is None
    single = one(spark, [(1.0, 2.0, 3.0, None)], f"array<{point}>", arrays.gps)
    assert single["latitude_range"] == 0 and single["latitude_std"] == 0 and single["speed_mean"] is None
    scan = "array<struct<bssid:string,rssi:double>>"
    empty = one(spark, None, scan, lambda c: arrays.network(c, "bssid", F.lit(None).cast("array<string>")))
    assert empty["familiar_ratio"] == 0 and empty["novel_ratio"] == 1 and empty["detected_count"] == 0


def test_windows_and_periods(spark):
    got = spark.range(24).select("id", scalars.windows_of_hour(F.col("id").cast("int")).alias("w")).collect()
    assert {r["id"]: sorted(r["w"]) for r in got} == {h: sorted(w for w, hours in WINDOWS.items() if h in hours) for h in range(24)}
    stamps = ["2024-01-01 00:00:00", "2024-01-01 05:59:00", "2024-01-01 06:00:00", "2024-01-01 23:59:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    got = df.select(scalars.time_period("t").alias("p"), scalars.shifted_date("t").cast("string").alias("d")).collect()
    assert [(r["p"], r["d"]) for r in got] == [("night", "2023-12-31"), ("night", "2023-12-31"), ("morning", "2024-01-01"), ("evening", "2024-01-01")]


def test_names_and_errors(spark, tmp_path):
    assert scalars.file_safe_name("--a b/c__") == "a_b_c"
    with pytest.raises(Exception, match="unknown strategy"):
        spark.range(1).select(scalars.strategy_model(F.lit("what"))).collect()
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, "none", str(tmp_path))
    with pytest.raises(NotImplementedError):
        modes.run(spark, "x", "y", "raw-cnn")
    with pytest.raises(ValueError):
        modes.run(spark, "x", "y", "other")
