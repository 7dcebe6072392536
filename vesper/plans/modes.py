"""Entry modes: cross-validation and selection, f1 and log-loss experiments, chained variants, and what is not available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ROLLING_MASKS, TARGETS
from ..functions.scalars import aggressive, file_safe_name, history_probability, label_at, shrink, strategy_model
from ..operators.chained import VARIANTS, chained_rows, dual_features, two_stages
from ..operators.folded import logistic
from ..operators.folds import rolling_masks, temporal_mask
from ..operators.history import label_history, long_labels, template_history
from ..operators.models import dependencies, model_names
from ..operators.priors import prior_predictions, prior_probabilities, rolling_majorities, vote_blends
from ..operators.registry import fit_all
from ..operators.rules import optimistic_predictions, tuned_predictions, validation_predictions
from ..operators.scores import binary_scores, cv_summary, logloss_summary
from ..operators.selection import best_thresholds, registry, select_by_accuracy, select_by_f1, select_generalized, select_logloss, shrink_grid
from ..sources import sinks, tables
from .features import label_rows, model_matrix, sensor_features

MODES = ("f1", "accuracy", "xgb-variants", "registry-ensembles", "lstm", "sequence-variants", "lstm-targetwise", "anchor-stack", "conservative-blend", "feature-diagnosis", "raw-cnn", "new-models", "oof-ensemble")
AVAILABLE = ("f1", "accuracy", "xgb-variants", "registry-ensembles")

# Shares of a model in its blends with the rule, models with the rule as a feature, and the order of legacy predictors.
BLENDS = (0.25, 0.5, 0.75)
META_MODELS = ("extra_trees", "lightgbm", "catboost", "hist_gradient_boosting")
RULE, HISTORY = "rule_subject_strategy_tuned", "history_blend"
FOLDS = tuple(ROLLING_MASKS)
LEGACY = ("logistic", "global_majority", "subject_majority", "subject_dow_majority", "global_dow_majority", *[f"blend_subject_global_{a:g}" for a in BLENDS], *[f"rolling_last_{n}" for n in (1, 3, 5, 7, 14)], "subject_strategy_tuned")


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def strategies(models: tuple[str, ...] | list[str]) -> list[str]:
    """All candidates in the order in which they are made: the rule, each model with its blends, the models on the rule."""
    each = [s for m in models for s in (f"model_{m}", *[f"blend_{m}_rule_{a:g}" for a in BLENDS])]
    return [RULE, *each, *[f"meta_rule_{m}" for m in META_MODELS if m in models]]


# ---- legacy: thirteen simple predictors and the logistic model


#: Held-out subjects of one table of roles: a row has a number for each of them and target.
SUBJECTS = 100


def cross_validation(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """(fold, strategy, target, accuracy, f1, positive_rate) of the logistic model, each subject and the last quarter held out.

    A fold is a role of each row, so that no row is copied for it; subjects are taken by the hundred.
    """
    masked = temporal_mask(labels.select("row_id", "subject_id", "lifelog_date", *TARGETS)).withColumnRenamed("is_valid", "late")
    masked = sinks.materialised(masked.join(rows.select("row_id", "x"), "row_id"))
    subjects = sorted(r[0] for r in labels.select("subject_id").distinct().collect())  # the label file's subjects
    folds = [(s, "leave_subject_out", F.col("subject_id") == s) for s in subjects] + [(FOLDS[0], "temporal", F.col("late"))]
    parts = []
    for at in range(0, len(folds), SUBJECTS):
        sets = [(*fold, t) for fold in folds[at : at + SUBJECTS] for t in TARGETS]
        roles = F.array(*[F.when(held, 2).otherwise(F.coalesce(F.col(t).cast("int"), F.lit(3))) for _, _, held, t in sets])
        names = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(s).alias("strategy"), F.lit(t).alias("target")) for f, s, _, t in sets])
        parts.append(logistic(masked.select("row_id", "x", roles.alias("roles"))).select("row_id", "p", F.get(names, F.col("fit")).alias("_n")).select("row_id", "p", "_n.*"))
    scored = _stacked(parts).join(long_labels(labels, TARGETS).select("row_id", "target", "y"), ["row_id", "target"]).withColumn("label", label_at("p", 0.5))
    return scored.groupBy("fold", "strategy", "target").agg(*binary_scores("y", "label"))


def baseline_scores(labels: DataFrame, cv: DataFrame | None = None) -> DataFrame:
    """(target, strategy, accuracy, f1, positive_rate, candidate_ord) of the simple predictors on the last quarter, and of
    the logistic model where its cross-validation is given; the order is that in which candidates are made."""
    y = long_labels(labels, TARGETS)
    split = temporal_mask(y)
    fit, valid = split.where("not is_valid").select(*y.columns), split.where("is_valid").select(*y.columns)
    p = prior_probabilities(fit, valid)
    every = prior_predictions(p).where("strategy not like 'blend%'").unionByName(vote_blends(p)).unionByName(rolling_majorities(fit, valid))
    tuned = optimistic_predictions(fit, valid).select(*valid.columns, F.lit("subject_strategy_tuned").alias("strategy"), "label")
    out = every.unionByName(tuned).groupBy("target", "strategy").agg(*binary_scores("y", "label"))
    if cv is not None:
        out = out.unionByName(cv.where("strategy = 'temporal'").select("target", F.lit("logistic").alias("strategy"), "accuracy", "f1", "positive_rate"))
    return out.withColumn("candidate_ord", F.array_position(F.array(*map(F.lit, LEGACY)), F.col("strategy")))


def legacy_predictions(train: DataFrame, template: DataFrame, rows: DataFrame, selected: DataFrame) -> DataFrame:
    """(row_id, target, value): the template's labels by each target's selected predictor, fitted on all of train.

    All fourteen sets of predictions are one long table; the join with the selection leaves those that are asked for.
    """
    y = long_labels(train, TARGETS)
    every = label_rows(train, template)
    wanted = every.where("not is_train").select("row_id", "subject_id", "lifelog_date").join(F.broadcast(y.select("target").distinct()))  # seven targets
    keep = ["row_id", "target", "strategy", "label"]
    sets = prior_predictions(prior_probabilities(y, wanted)).select(*keep).unionByName(rolling_majorities(y, wanted).select(*keep))
    sets = sets.unionByName(tuned_predictions(y, wanted).withColumn("strategy", F.lit("subject_strategy_tuned")).select(*keep))
    sets = sets.unionByName(_logistic(every, rows).select("row_id", "target", F.lit("logistic").alias("strategy"), label_at("p", 0.5).alias("label")))
    return sets.join(selected.select("target", "strategy"), ["target", "strategy"]).select("row_id", "target", F.col("label").alias("value"))


def _logistic(every: DataFrame, rows: DataFrame) -> DataFrame:
    roles = F.array(*[F.when(F.col("is_train"), F.coalesce(F.col(t).cast("int"), F.lit(3))).otherwise(2) for t in TARGETS])
    p = logistic(every.select("row_id", roles.alias("roles")).join(rows.select("row_id", "x"), "row_id"))
    return p.select("row_id", F.get(F.array(*map(F.lit, TARGETS)), F.col("fit")).alias("target"), "p")


# ---- candidates: the rule, registry models, their blends, and models on the rule


def _model(strategy: str) -> tuple[str, bool, float]:
    """(model, whether it has the rule as a feature, its share) of a strategy other than the rule and the history."""
    if strategy.startswith("meta_rule_"):
        return strategy.removeprefix("meta_rule_"), True, 1.0
    if strategy.startswith("blend_"):
        model, share = strategy.removeprefix("blend_").split("_rule_")
        return model, False, float(share)
    return strategy.removeprefix("model_"), False, 1.0


def _probabilities(x: DataFrame, fit: DataFrame, ahead: DataFrame, asked: dict[tuple[str, str], list[str]]) -> DataFrame:
    """(fold, target, row_id, submission_strategy, p) of each (fold, target)'s asked strategies, all fitted as one set of fits.

    ``x`` has row_id and x, ``fit`` and ``ahead`` are long by fold and target, with y, last_value and prior, and with the rule. A pair of
    fold and target is a label set of one wide table, in which it has a feature of its own for its rule: the last label where
    it trains, the rule where it is asked. Each model is fitted once for all of its blends.
    """
    pairs = sorted(asked)
    mine = [(F.col("fold") == f) & (F.col("target") == t) for f, t in pairs]
    trains = fit.groupBy("row_id").agg(*[F.max(F.when(c, F.col("y").cast("int"))).alias(f"y{k}") for k, c in enumerate(mine)], *[F.max(F.when(c, F.coalesce("last_value", "prior"))).cast("double").alias(f"l{k}") for k, c in enumerate(mine)])
    asks = ahead.groupBy("row_id").agg(*[F.max(F.when(c, 2)).alias(f"a{k}") for k, c in enumerate(mine)], *[F.max(F.when(c, F.col("rule"))).alias(f"r{k}") for k, c in enumerate(mine)])
    first = x.select(F.size("x")).first()
    width, own = first[0] if first else 0, range(len(pairs))
    rows = x.join(trains, "row_id", "left").join(asks, "row_id", "left").select(
        "row_id", F.array(*[F.coalesce(f"y{k}", f"a{k}", F.lit(3)) for k in own]).alias("roles"), F.concat("x", F.array(*[F.coalesce(f"l{k}", f"r{k}", F.lit(0.0)) for k in own])).alias("x")
    )
    fits: dict[tuple[int, str, tuple[int, ...]], int] = {}
    names: list[tuple] = []
    for k, pair in enumerate(pairs):
        for strategy in asked[pair]:
            if strategy not in (RULE, HISTORY):
                model, meta, share = _model(strategy)
                columns = (*range(width), *([width + k] if meta else []))
                names.append((fits.setdefault((k, model, columns), len(fits)), *pair, strategy, share))
    rule = ahead.select("fold", "target", "row_id", F.lit(RULE).alias("submission_strategy"), F.col("rule").alias("p"))
    out = rule.where(F.concat_ws("/", "fold", "target").isin(["/".join(pair) for pair in pairs if RULE in asked[pair]]))
    if not names:
        return out
    named = x.sparkSession.createDataFrame(names, "fit int, fold string, target string, submission_strategy string, share double")
    p = fit_all(rows, len(pairs), list(fits)).join(F.broadcast(named), "fit").join(ahead.select("fold", "target", "row_id", "rule"), ["fold", "target", "row_id"])
    mixed = F.when(F.col("share") == 1, F.col("p")).otherwise(F.col("share") * F.col("p") + (1 - F.col("share")) * F.col("rule"))
    return out.unionByName(p.select("fold", "target", "row_id", "submission_strategy", mixed.alias("p")))


def _history(ahead: DataFrame) -> DataFrame:
    value = history_probability(F.col("last_7_mean"), F.col("last_3_mean"), F.col("dow_mean"), F.col("prior"))
    return ahead.select("fold", "target", "row_id", F.lit(HISTORY).alias("submission_strategy"), value.alias("p"))


def candidate_probabilities(labels: DataFrame, rows: DataFrame, models: list[str] | None = None) -> DataFrame:
    """(fold, target, submission_strategy, model_name, candidate_ord, row_id, y, prior, p) on the three rolling folds, from one set of fits."""
    asked = strategies(model_names() if models is None else models)
    y = long_labels(labels, TARGETS)
    past = sinks.materialised(label_history(y).select("row_id", "target", "last_value", "last_7_mean", "last_3_mean", "dow_mean"))
    fits, aheads = [], []
    for fold in FOLDS:
        masked = rolling_masks(y).where(F.col("fold") == fold)
        fit, valid = masked.where("not is_valid").select(*y.columns), masked.where("is_valid").select(*y.columns)
        prior = fit.groupBy("target").agg(F.avg("y").alias("prior"))
        rule = validation_predictions(fit, valid).select("row_id", "target", "y", F.col("label").cast("double").alias("rule"))
        fits.append(fit.select(F.lit(fold).alias("fold"), "row_id", "target", "y").join(past, ["row_id", "target"]).join(prior, "target"))
        aheads.append(rule.withColumn("fold", F.lit(fold)).join(past, ["row_id", "target"]).join(prior, "target"))
    fit, ahead = sinks.materialised(_stacked(fits)), sinks.materialised(_stacked(aheads))
    found = _probabilities(rows.select("row_id", "x"), fit, ahead, {(f, t): asked for f in FOLDS for t in TARGETS})
    out = found.unionByName(_history(ahead)).join(ahead.select("fold", "target", "row_id", "y", "prior"), ["fold", "target", "row_id"])
    order = F.array_position(F.array(*map(F.lit, [*asked, HISTORY])), F.col("submission_strategy"))
    return out.withColumn("model_name", strategy_model("submission_strategy")).withColumn("candidate_ord", order)


def f1_scores(candidates: DataFrame) -> DataFrame:
    scored = candidates.where(F.col("submission_strategy") != HISTORY)
    return best_thresholds(scored, ["fold", "target", "submission_strategy", "model_name", "candidate_ord"])


def logloss_scores(candidates: DataFrame) -> DataFrame:
    """Losses of all shrinkage factors; of the subject history, which leans on the prior by itself, of the factor 1 alone."""
    out = shrink_grid(candidates, ["fold", "target", "submission_strategy", "model_name"])
    return out.where((F.col("submission_strategy") != HISTORY) | (F.col("shrink_alpha") == 1.0))


def final_probabilities(train: DataFrame, template: DataFrame, rows: DataFrame, asked: dict[str, list[str]]) -> DataFrame:
    """(row_id, target, submission_strategy, p, prior) of the template's rows, of each target's asked strategies fitted on all of train."""
    y = long_labels(train, TARGETS)
    every = label_rows(train, template)
    ahead = every.where("not is_train")
    wanted = ahead.select("row_id", "subject_id", "lifelog_date").join(F.broadcast(y.select("target").distinct()))  # seven targets
    rule = tuned_predictions(y, wanted).select("row_id", "target", F.col("label").cast("double").alias("rule"))
    prior, all_ = y.groupBy("target").agg(F.avg("y").alias("prior")), F.lit("all").alias("fold")
    past = label_history(y).select("row_id", "target", "last_value")
    fit = sinks.materialised(y.select(all_, "row_id", "target", "y").join(past, ["row_id", "target"]).join(prior, "target"))
    later = template_history(y, ahead).select("row_id", "target", "last_7_mean", "last_3_mean", "dow_mean")
    two = sinks.materialised(rule.select(all_, "*").join(later, ["row_id", "target"]).join(prior, "target"))
    wanted = {("all", target): list(dict.fromkeys(names)) for target, names in sorted(asked.items())}
    found = _probabilities(rows.select("row_id", "x"), fit, two, wanted)
    past_ones = [target for target, names in asked.items() if HISTORY in names]
    found = found.unionByName(_history(two.where(F.col("target").isin(past_ones))))
    return found.join(prior, "target").select("row_id", "target", "submission_strategy", "p", "prior")


def _asked(*chosen: DataFrame) -> dict[str, list[str]]:
    """The strategies that selections name, by target: as many as targets times selections."""
    out: dict[str, list[str]] = {}
    for df in chosen:
        for r in df.select("target", "submission_strategy").distinct().collect():
            out.setdefault(r["target"], []).append(r["submission_strategy"])
    return out


# ---- outputs


def f1_outputs(train: DataFrame, template: DataFrame, rows: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """Scores and selections, and the submissions of the best, the stable and the calibrated choices."""
    scored, losses = sinks.materialised(f1_scores(candidates)), sinks.materialised(logloss_scores(candidates))
    quarter = scored.where(F.col("fold") == FOLDS[0])
    chosen, stable, calm = (sinks.materialised(x) for x in (select_by_f1(quarter), select_generalized(scored), select_logloss(losses)))
    final = sinks.materialised(final_probabilities(train, template, rows, _asked(chosen, stable, calm)))
    ahead = label_rows(train, template).where("not is_train")
    of = lambda df, *more: final.join(df.select("target", "submission_strategy", *more), ["target", "submission_strategy"])

    def frame(df: DataFrame, value, as_int: bool = True) -> DataFrame:
        return sinks.predictions_frame(ahead, df.select("row_id", "target", value.alias("value")), as_int=as_int)

    best, safe = of(chosen, "threshold"), of(stable, "threshold")
    first = frame(best, label_at("p", F.col("threshold")))
    return {
        "submission": first, "submission_f1_best": first,
        "submission_f1_aggressive": frame(best, label_at("p", aggressive("threshold"))),
        "submission_f1_generalized": frame(safe, label_at("p", F.col("threshold"))),
        "submission_logloss_best": frame(best, F.col("p"), False),
        "submission_logloss_generalized": frame(safe, F.col("p"), False),
        "submission_logloss_cv": frame(of(calm, "shrink_alpha"), shrink("p", "prior", F.col("shrink_alpha")), False),
        "model_scores": scored, "generalization_scores": scored, "strategy_scores": quarter, "selected_strategies": chosen, "generalized_strategies": stable,
        "logloss_scores": losses, "logloss_summary": logloss_summary(losses), "logloss_selected_strategies": calm,
    }


def registry_outputs(train: DataFrame, template: DataFrame, rows: DataFrame, losses: DataFrame, output_dir: str) -> dict[str, DataFrame]:
    """The best factor of each target and strategy, and the probabilities of all strategies, clipped; a target without a
    candidate has its prior. Probabilities are one table partitioned by source, and a submission for each source is a slice of it."""
    best = sinks.materialised(registry(losses))
    final = final_probabilities(train, template, rows, _asked(best))
    found = final.join(best.select("target", "submission_strategy", "source", "shrink_alpha"), ["target", "submission_strategy"])
    found = sinks.materialised(found.select("row_id", "target", F.concat(F.lit("registry_"), "source").alias("strategy"), shrink("p", "prior", F.col("shrink_alpha")).alias("value")))
    prior = long_labels(train, TARGETS).groupBy("target").agg(F.avg("y").alias("prior"))
    ahead = label_rows(train, template).where("not is_train")
    every = ahead.select("row_id").join(F.broadcast(found.select("strategy").distinct())).join(F.broadcast(prior))  # strategies and targets: a few dozen rows
    filled = every.join(found, ["row_id", "target", "strategy"], "left").select("row_id", "target", "strategy", F.coalesce("value", "prior").alias("value"))
    filled = sinks.materialised(filled)
    sinks.write_registry(filled, output_dir)
    manifest = best.select("target", F.concat(F.lit("registry_"), "source").alias("source"), F.concat(F.lit("submission_registry_"), "source").alias("submission"), "mean_logloss", "std_logloss", "max_logloss", "shrink_alpha", "selection_score")
    out = {"registry_logloss_scores": losses, "registry_candidate_scores": manifest}
    for name in sorted(r[0] for r in filled.select("strategy").distinct().collect()):
        out[f"submission_{file_safe_name(name)}"] = sinks.predictions_frame(ahead, filled.where(F.col("strategy") == name).select("row_id", "target", "value"), as_int=False)
    return out


def chained_outputs(train: DataFrame, template: DataFrame, logs: dict[str, DataFrame], variants: dict[str, tuple[int, str, str]], rounds: int = 150, clip: float = 1e-4) -> dict[str, DataFrame]:
    """Of each variant the clipped submission and the scores, and the scores of all as one table."""
    if not logs:
        raise ValueError("the two-stage pipeline needs sensor logs")
    every = label_rows(train, template)
    rows = sinks.materialised(chained_rows(every.select("row_id", "is_train", "subject_id", "lifelog_date"), dual_features(logs)))
    ahead, out, scores = every.where("not is_train"), {}, []
    for name, (n_folds, s_mode, q_mode) in variants.items():
        values, losses = two_stages(rows, train, n_folds, s_mode, q_mode, rounds=rounds)
        out[f"submission_{name}"] = sinks.predictions_frame(ahead, values, as_int=False, clip=clip)
        out[f"{name}_scores"] = sinks.materialised(losses)
        scores.append(out[f"{name}_scores"].withColumn("variant", F.lit(name)))
    out["variant_scores"] = _stacked(scores)
    return out


def run(spark: SparkSession, data_dir: str, output_dir: str, mode: str = "f1", train_csv: str = "ch2026_metrics_train.csv", template_csv: str = "ch2026_submission_sample.csv", items: str = "ch2025_data_items", models: list[str] | None = None, rounds: int = 150) -> dict[str, DataFrame]:
    """Run a mode and write its CSV files; the frames by name. Modes whose models have no public definition raise NotImplementedError.

    ``models`` are the registry models to try (all by default), ``rounds`` those of the chained boosting.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; known are {', '.join(MODES)}")
    if mode not in AVAILABLE:
        raise NotImplementedError(f"mode {mode} is not available")
    train, template = tables.labels(spark, f"{data_dir}/{train_csv}"), tables.labels(spark, f"{data_dir}/{template_csv}")
    logs = tables.sensors(spark, f"{data_dir}/{items}")
    if mode == "xgb-variants":
        out = chained_outputs(train, template, logs, VARIANTS, rounds)
    else:
        rows = sinks.materialised(model_matrix(train, template, sensor_features(logs) if logs else None))
        ahead = label_rows(train, template).where("not is_train")
    if mode == "registry-ensembles":
        losses = sinks.materialised(logloss_scores(candidate_probabilities(train, rows, models)))
        out = registry_outputs(train, template, rows, losses, output_dir)
    elif mode in ("accuracy", "f1"):
        cv = sinks.materialised(cross_validation(train, rows))
        scores = sinks.materialised(baseline_scores(train, cv))
        selected = select_by_accuracy(scores)
        legacy = sinks.predictions_frame(ahead, legacy_predictions(train, template, rows, selected))
        out = {"cv_scores": cv, "cv_summary": cv_summary(cv)}
        if mode == "accuracy":
            out |= {"submission": legacy, "strategy_scores": scores, "selected_strategies": selected}
        else:
            out |= f1_outputs(train, template, rows, sinks.materialised(candidate_probabilities(train, rows, models)))
            out["submission_legacy"] = legacy
            if logs:
                chained = chained_outputs(train, template, logs, {"chained": (5, "blend", "blend")}, rounds)
                out |= {"submission_chained": chained["submission_chained"], "chained_scores": chained["chained_scores"]}
    for name, df in out.items():
        sinks.write_csv(df, f"{output_dir}/{name}")
    return out


def leaderboard(scores: DataFrame, n: int = 3) -> DataFrame:
    """The best ``n`` candidates of each target by f1, accuracy and the lower positive rate, with their rank."""
    return sinks.top_rows(scores, [F.desc("f1"), F.desc("accuracy"), F.asc("positive_rate")], ["target"], n).orderBy("target", "rank")


def install_check() -> dict[str, bool]:
    return dependencies()
