"""Every registered query of the engine against its SQL, and the contract of the driver's entry."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from vesper.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shown(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return round(float(v), 5) if isinstance(v, int) else v


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def _deepest(df, word: str) -> int:
    return max((i for i, line in enumerate(_plan(df)) if word in line), default=-1)


def test_predictions_are_grouped_by_row_alone(spark):
    assert not any("pivotfirst" in line.lower() for line in _plan(entry.queries()["predictions_frame"](spark, SF)))


def test_cross_inputs_are_summed_before_they_are_named(spark):
    df = entry.queries()["cross_features"](spark, SF)
    assert _deepest(df, "Generate explode") < _deepest(df, "Aggregate [")


def test_window_statistics_keep_no_wide_rows(spark):
    plan = entry.queries()["window_stats"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" in plan and "REPARTITION_BY_NUM" in plan
