"""Scans by blocks against windows by subject, with one subject that has half of all rows, and the sparse model matrix."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesper.operators import blocks, history, rules
from vesper.plans import features

SCHEMA = "row_id int, subject_id string, lifelog_date date, target string, y double"


@pytest.fixture(scope="module")
def labels(spark):
    r, day = random.Random(4), datetime.date(2024, 1, 1)
    rows = []
    for i in range(600):
        subject = "hot" if i % 2 else r.choice(["a", "b", "c", None])
        # long runs of one label, longer than a block, then changes
        y = 1.0 if subject == "hot" and i < 420 else r.choice([0.0, 1.0, 1.0, None])
        rows.append((i, subject, day + datetime.timedelta(days=i // 3 + r.randint(0, 2)), r.choice(["Q1", "S1"]) if subject != "hot" else "Q1", y))
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).persist()


def said(df):
    return sorted((tuple(round(v, 12) if isinstance(v, float) else v for v in row) for row in df.collect()), key=str)


@pytest.mark.parametrize("partitions", [2, 9, 40])
def test_history_by_blocks_is_that_by_windows(labels, partitions):
    known = labels.where("subject_id is not null")
    assert said(history.label_history(labels)) == said(history.label_history(labels, 1, partitions))
    template = known.where("row_id % 5 = 0").select("row_id", "subject_id", "lifelog_date")
    assert said(history.template_history(known, template)) == said(history.template_history(known, template, 1, partitions))


def test_blocks_cut_a_hot_group(labels):
    cut = blocks.blocked(labels, history.OWN, ["lifelog_date", "row_id"], 9)
    sizes = {r["_block"]: r["count"] for r in cut.where("subject_id = 'hot'").groupBy("_block").count().collect()}
    assert len(sizes) >= 4 and max(sizes.values()) < 200
    spans = cut.where("subject_id = 'hot'").groupBy("_block").agg(F.min("lifelog_date").alias("a"), F.max("lifelog_date").alias("b")).orderBy("_block").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:]))


def test_places_by_blocks(labels):
    for partitions in (None, 7):
        got = blocks.places(labels, history.OWN, ["row_id"], "place", partitions).select("subject_id", "target", "row_id", "place").collect()
        groups = {}
        for r in sorted(got, key=lambda r: r["row_id"]):
            groups.setdefault((r["subject_id"], r["target"]), []).append(r["place"])
        assert len(got) == 600 and all(g == list(range(len(g))) for g in groups.values())


def test_rules_by_blocks(labels):
    known = labels.where("subject_id is not null and y is not null")
    fit, ahead = known.where("row_id < 450"), known.where("row_id >= 450")
    assert said(rules.rule_labels(fit, ahead)) == said(rules.rule_labels(fit, ahead, most=1))


def test_the_sparse_matrix_is_the_dense_one(spark, tmp_path):
    from vesper.sources import tables

    head = "subject_id,sleep_date,lifelog_date,Q1,Q2,Q3,S1,S2,S3,S4\n"
    day = lambda i: (datetime.date(2024, 6, 1) + datetime.timedelta(days=i)).isoformat()
    for name, subjects, days in (("train", "ab", range(12)), ("template", "bc", range(20, 23))):
        lines = [f"{s},{day(i + 1)},{day(i)}," + ",".join(str((i * k + ord(s)) % 2) for k in range(1, 8)) for s in subjects for i in days]
        (tmp_path / f"{name}.csv").write_text(head + "\n".join(lines) + "\n")
    train, template = (tables.labels(spark, str(tmp_path / f"{n}.csv")) for n in ("train", "template"))
    sensor = spark.createDataFrame([("a", datetime.date(2024, 6, 3), "light", 2.0), ("a", datetime.date(2024, 6, 4), "light", float("inf")), ("b", datetime.date(2024, 6, 4), "light", 5.0), ("b", datetime.date(2024, 6, 4), "steps", None), ("c", datetime.date(2024, 6, 21), "unseen", 1.0)], "subject_id string, lifelog_date date, feature string, value double")
    for given in (None, sensor):
        want = {(r["row_id"], r["is_train"]): r["x"] for r in features.model_rows(features.model_features(train, template, given)).collect()}
        matrix = features.model_matrix(train, template, given)
        got = {(r["row_id"], r["is_train"]): r["x"] for r in matrix.collect()}
        assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
        assert "CartesianProduct" not in matrix._jdf.queryExecution().toString() and "NestedLoop" not in matrix._jdf.queryExecution().toString()
