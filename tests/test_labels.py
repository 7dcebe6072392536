"""The label pipeline on made label files: fold sizes, histories, rules, models and the entry modes."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vesper.functions.constants import TARGETS
from vesper.operators import chained, folds, history, models, rules
from vesper.plans import features, modes
from vesper.sources import tables

HEAD = "subject_id,sleep_date,lifelog_date," + ",".join(TARGETS)


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(3)

    def write(name, first, counts, zero):
        lines = [HEAD]
        for subject, n in counts.items():
            for i in range(n):
                day = datetime.date(2024, 6, first) + datetime.timedelta(days=i)
                y = [0] * 7 if zero else [int(v) for v in rng.integers(0, 2, 7)]
                lines.append(",".join([subject, str(day + datetime.timedelta(days=1)), str(day), *map(str, y)]))
        (folder / name).write_text("\n".join(lines) + "\n")

    write("ch2026_metrics_train.csv", 1, {"id01": 16, "id02": 12, "id03": 1}, False)
    write("ch2026_submission_sample.csv", 25, {"id01": 4, "id02": 3, "id09": 2}, True)
    return str(folder)


@pytest.fixture(scope="module")
def frames(spark, data):
    return tables.labels(spark, f"{data}/ch2026_metrics_train.csv"), tables.labels(spark, f"{data}/ch2026_submission_sample.csv")


def test_labels_keep_file_order(frames):
    train, _ = frames
    got = train.orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(29)) and [r["subject_id"] for r in got][:17] == ["id01"] * 16 + ["id02"]


def test_hole_folds_cover_once(frames):
    got = folds.hole_folds(frames[0], 5).collect()
    assert len(got) == 29 and {r["fold"] for r in got} <= set(range(5))
    sizes = [sum(r["subject_id"] == "id01" and r["block"] == b for r in got) for b in range(10)]
    assert sizes == [len(x) for x in np.array_split(np.arange(16), 10)]


def test_history_ignores_own_label(spark, frames):
    y = history.long_labels(frames[0], TARGETS).where("target = 'Q1' and subject_id = 'id01'")
    flipped = y.withColumn("y", F.when(F.col("row_id") == 7, 1 - F.col("y")).otherwise(F.col("y")))
    at = lambda df: {r["row_id"]: [r[c] for c in history.COLUMNS] for r in history.label_history(df).collect()}
    a, b = at(y), at(flipped)
    assert all(a[i] == b[i] for i in range(8)) and a[8] != b[8]


def test_streak_and_change_like_a_loop(frames):
    y = history.long_labels(frames[0], TARGETS).where("target = 'S2' and subject_id = 'id02'")
    got = sorted(history.label_history(y).collect(), key=lambda r: r["lifelog_date"])
    seen = []
    for r in got:
        streak = 0
        for v in reversed(seen):
            if v != seen[-1]:
                break
            streak += 1 if v == 1 else -1
        assert r["streak"] == streak and r["history_count"] == len(seen)
        assert r["change_rate"] == (pytest.approx(np.abs(np.diff(seen)).mean()) if len(seen) > 1 else None)
        seen.append(r["y"])


def test_rules_for_unseen_subjects(spark, frames):
    y = history.long_labels(frames[0], TARGETS)
    ahead = frames[1].select("row_id", "subject_id", "lifelog_date").crossJoin(y.select("target").distinct())
    got = rules.rule_labels(y, ahead).where("subject_id = 'id09'")
    assert got.where("label <> 1").count() == 0 and got.select("rule").distinct().count() == len(rules.RULES) == 29
    assert rules.tuned_predictions(y, ahead).count() == 9 * 7
    with pytest.raises(ValueError):
        rules.known_rule("no such rule")


def test_logistic_separates_and_is_constant_for_one_class():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.1 * rng.normal(size=200) > 0).astype(float)
    p = models.predict_logistic(models.fit_logistic(x, y, 300), x)
    assert ((p >= 0.5) == y).mean() > 0.95
    assert set(models.predict_logistic(models.fit_logistic(x, np.ones(200)), x)) == {1.0}


def test_model_matrix_is_dense_and_finite(spark, frames):
    long = features.model_features(*frames, None)
    rows = features.model_rows(long).collect()
    assert len(rows) == 38 and len({len(r["x"]) for r in rows}) == 1 and len(rows[0]["x"]) == 5 + 63 + 4
    assert all(np.isfinite(r["x"]).all() for r in rows)


def test_chained_models(spark, frames):
    train, template = frames
    base = features.model_rows(features.model_features(train, template, None).where("feature like '%dow%' or feature = 'dayofweek'")).persist()
    rows = base.where("is_train").join(folds.hole_folds(train, 2).select("row_id", "fold"), "row_id").select("row_id", "x", "fold")
    held, test, losses = chained.out_of_fold(rows.join(train.select("row_id", "S1", "S2"), "row_id"), base.where("not is_train").select("row_id", "x"), ("S1", "S2"), 2, "extra_trees", 1, 3)
    assert held.count() == 2 * 29 and test.count() == 2 * 9 and losses.count() == 2 * 2
    assert models.weighted_pair("blend", boosted=False) == [("lightgbm", 0.7), ("extra_trees", 0.3)]


EIGHT = {"submission", "submission_f1_best", "submission_f1_aggressive", "submission_f1_generalized", "submission_logloss_best", "submission_logloss_generalized", "submission_logloss_cv", "submission_legacy"}


@pytest.mark.parametrize("mode,models", [("accuracy", None), ("registry-ensembles", ["logistic_regression"]), ("f1", ["logistic_regression"])])
def test_modes(spark, data, tmp_path, mode, models, monkeypatch):
    if mode == "registry-ensembles":
        monkeypatch.setattr(modes, "FOLDS", modes.FOLDS[:1])
    out = modes.run(spark, data, str(tmp_path), mode, models=models)
    assert all(df.count() > 0 for df in out.values())
    assert all((tmp_path / name).exists() for name in out)
    for name in (n for n in out if n.startswith("submission")):
        rows = out[name].collect()
        assert len(rows) == 9 and all(r[t] is not None for r in rows for t in TARGETS)
        whole = all(float(r[t]) in (0.0, 1.0) for r in rows for t in TARGETS)
        assert whole or all(1e-4 <= r[t] <= 1 - 1e-4 for r in rows for t in TARGETS)
    if mode == "accuracy":
        assert set(out) == {"cv_scores", "cv_summary", "submission", "strategy_scores", "selected_strategies"}
        assert {r["strategy"] for r in out["strategy_scores"].collect()} == set(modes.LEGACY)
    elif mode == "f1":
        assert EIGHT <= set(out)
        names = {r[0] for r in out["model_scores"].select("submission_strategy").distinct().collect()}
        assert names == set(modes.strategies(models))
        losses = out["logloss_scores"]
        assert losses.where("submission_strategy = 'history_blend'").select("shrink_alpha").distinct().collect()[0][0] == 1.0
        assert {r[0] for r in losses.select("fold").distinct().collect()} == set(modes.FOLDS)
    else:
        assert {r["source"] for r in out["registry_candidate_scores"].collect()} >= {"registry_history_blend", "registry_rule_subject_strategy_tuned", "registry_blend_logistic_regression_rule_0_25"}


def test_a_model_on_the_rule_and_a_failing_model(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values = dict(enumerate(rng.normal(size=40))) | {100: -2.0, 101: 2.0}
    x = spark.createDataFrame([(i, [float(v), 1.0]) for i, v in values.items()], "row_id int, x array<double>")
    fit = spark.createDataFrame([("f", "t", i, float(v > 0), None if i % 5 else 1.0, 0.5) for i, v in values.items() if i < 100], "fold string, target string, row_id int, y double, last_value double, prior double")
    ahead = spark.createDataFrame([("f", "t", 100 + i, float(i % 2)) for i in range(2)], "fold string, target string, row_id int, rule double")
    asked = ["meta_rule_logistic_regression", "blend_logistic_regression_rule_0.25", "model_nothing_such", "meta_rule_lightgbm", modes.RULE]
    with pytest.warns(UserWarning, match="skipped nothing_such"):
        got = modes._probabilities(x, fit, ahead, {("f", "t"): asked}).collect()
    rows = {(r["submission_strategy"], r["row_id"]): r["p"] for r in got}
    assert len(rows) == 8 and rows["meta_rule_logistic_regression", 100] < 0.5 < rows["meta_rule_logistic_regression", 101]
    assert rows["meta_rule_lightgbm", 100] < 0.5 < rows["meta_rule_lightgbm", 101] and rows[modes.RULE, 101] == 1


def test_candidates_are_in_the_order_in_which_they_are_made():
    names = modes.strategies(models.model_names())
    assert len(names) == 1 + 4 * len(models.model_names()) + 4 and names[:3] == ["rule_subject_strategy_tuned", "model_logistic_regression", "blend_logistic_regression_rule_0.25"]


def test_variants_of_the_two_stages(spark, data, tmp_path, frames, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("ch2026_metrics_train.csv", "ch2026_submission_sample.csv"):
        (folder / name).write_text(open(f"{data}/{name}").read())
    days = [datetime.datetime(2024, 6, d, h) for d in range(1, 29) for h in (3, 10, 21)]
    made = spark.createDataFrame([(s, t, float((t.day * 7 + t.hour + k) % 5)) for k, s in enumerate(("id01", "id02", "id03")) for t in days], "subject_id string, timestamp timestamp_ntz, m_activity double")
    made.write.parquet(str(folder / "ch2025_data_items" / "ch2025_mActivity.parquet"))
    monkeypatch.setattr(modes, "VARIANTS", {"one": (2, "xgb", "xgb"), "two": (2, "blend", "lgbm_xgb_30_70")})
    out = modes.run(spark, str(folder), str(tmp_path / "out"), "xgb-variants", rounds=2)
    assert set(out) == {"submission_one", "one_scores", "submission_two", "two_scores", "variant_scores"}
    assert out["submission_two"].count() == 9 and out["variant_scores"].count() == 14
    got = {(r["target"], r["stage"], r["model_blend"]) for r in out["two_scores"].collect()}
    assert ("S1", "S", "lightgbm+xgboost") in got and ("Q3", "Q", "lightgbm+xgboost") in got and len(got) == 7
    train, template = frames
    every = features.label_rows(train, template)
    rows = chained.chained_rows(every.select("row_id", "is_train", "subject_id", "lifelog_date"), chained.dual_features(tables.sensors(spark, f"{folder}/ch2025_data_items")))
    shapes = {(len(r["x"]), len(r["x2"])) for r in rows.collect()}
    assert shapes == {(2 + 2, 4 + 2)} and rows.count() == 38 and all(np.isfinite(r["x2"]).all() for r in rows.collect())


def test_leaderboard_breaks_ties_by_accuracy_and_positive_rate(spark):
    scores = spark.createDataFrame([("Q1", "a", 0.5, 0.6, 0.9), ("Q1", "b", 0.5, 0.6, 0.2), ("Q1", "c", 0.9, 0.1, 0.5), ("Q1", "d", 0.5, 0.7, 0.5), ("S1", "e", 0.1, 0.1, 0.1)], "target string, strategy string, f1 double, accuracy double, positive_rate double")
    assert [(r["target"], r["rank"], r["strategy"]) for r in modes.leaderboard(scores).collect()] == [("Q1", 1, "c"), ("Q1", 2, "d"), ("Q1", 3, "b"), ("S1", 1, "e")]


def test_labels_of_sums_that_waver(spark, monkeypatch):
    """Sums that are made again may differ in their last bits; a day's own sum must not be over the median that it is."""
    from vesper.plans import catalog

    waver = F.udf(lambda v: v * (1 + int(np.random.default_rng().integers(0, 9)) * 2.0**-50), "double").asNondeterministic()
    events = spark.range(40 * 5).select((F.col("id") % 40).alias("user_id"), F.timestamp_seconds(1_704_067_200 + 86_400 * F.floor(F.col("id") / 40)).alias("ts"), (F.col("id") * 37 % 101 + 0.1).alias("value"))
    monkeypatch.setattr(catalog, "_t", lambda *_: events.withColumn("value", waver("value")))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # partial sums that are fetched twice are added twice, in any order
    try:
        got = catalog._labels(spark, "").groupBy("subject_id").agg(F.sum("y").alias("n"), F.count("y").alias("of")).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(got) == 40 and all((r["n"], r["of"]) == (2, 5) for r in got)


def test_labels_of_days_with_equal_sums(spark, monkeypatch):
    """Two days that are both the median by their decimal sums: which one is over it follows the events' time, however rows are dealt."""
    from vesper.plans import catalog

    values = [(0, [0.5]), (1, [0.1, 0.2, 0.3]), (2, [0.3, 0.2, 0.1])]  # 0.6000000000000001 and 0.6
    rows = [(user, 86_400 * day + 60 * i, v) for user in range(200) for day, many in values for i, v in enumerate(many)]
    events = spark.createDataFrame(rows, "user_id long, at long, value double").select("user_id", F.timestamp_seconds(F.col("at") + 1_704_067_200).alias("ts"), "value")
    monkeypatch.setattr(catalog, "_t", lambda *_: events.repartition(16, F.xxhash64("user_id", "ts", "value")))
    got = {(r["row_id"] // 1000, r["row_id"] % 1000): r["y"] for r in catalog._labels(spark, "").collect()}
    assert got == {(user, day): float(day == 1) for user in range(200) for day in range(3)}
