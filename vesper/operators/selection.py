"""Threshold tuning, shrinkage grids and the selection orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import SHRINK
from ..functions.scalars import file_safe, shrink
from .scores import binary_scores, generalization_summary, log_loss, logloss_summary

THRESHOLDS = tuple(i * 5 / 100 for i in range(1, 20))


def best(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in an order that must tell all rows apart."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def threshold_scores(predictions: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """(keys, threshold, accuracy, f1, positive_rate, prior_gap) of the 19 thresholds, in one aggregation.

    Rows are not multiplied: every threshold is an expression over the group's rows.
    """
    aggregates = [F.struct(F.lit(t).alias("threshold"), *binary_scores(y, (F.col(p) >= t).cast("int"))).alias(f"t{i}") for i, t in enumerate(THRESHOLDS)]
    prior = F.avg(F.col(y).cast("double")).alias("_prior")
    wide = predictions.groupBy(*keys).agg(prior, *aggregates)
    out = wide.select(*keys, "_prior", F.explode(F.array(*[f"t{i}" for i in range(len(THRESHOLDS))])).alias("_t")).select(*keys, "_prior", "_t.*")
    return out.withColumn("prior_gap", F.abs(F.col("positive_rate") - F.col("_prior"))).drop("_prior")


def best_thresholds(predictions: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Per group the threshold of best f1, then accuracy, then nearness to the prior; the lowest of equals."""
    return best(threshold_scores(predictions, keys, y, p), keys, F.col("f1").desc(), F.col("accuracy").desc(), "prior_gap", "threshold")


def shrink_grid(predictions: DataFrame, keys: list[str], alphas: tuple[float, ...] = SHRINK, y: str = "y", p: str = "p", prior: str = "prior") -> DataFrame:
    """(keys, shrink_alpha, logloss) of probabilities drawn to the prior by each alpha."""
    aggregates = [F.struct(F.lit(a).alias("shrink_alpha"), log_loss(y, shrink(p, prior, a))).alias(f"a{i}") for i, a in enumerate(alphas)]
    wide = predictions.groupBy(*keys).agg(*aggregates)
    return wide.select(*keys, F.explode(F.array(*[f"a{i}" for i in range(len(alphas))])).alias("_a")).select(*keys, "_a.*")


def select_by_f1(scores: DataFrame) -> DataFrame:
    return best(scores, ["target"], F.col("f1").desc(), F.col("accuracy").desc(), "prior_gap", "candidate_ord")


def select_by_accuracy(scores: DataFrame) -> DataFrame:
    return best(scores, ["target"], F.col("accuracy").desc(), F.col("f1").desc(), "candidate_ord")


def select_generalized(scores: DataFrame) -> DataFrame:
    """The most stable candidate of each target; its threshold is the median over folds."""
    order = [F.col(c).desc() for c in ("generalization_score", "mean_f1", "min_f1", "mean_accuracy")]
    out = best(generalization_summary(scores), ["target"], *order, "mean_prior_gap", "submission_strategy", "model_name")
    return out.withColumn("threshold", F.col("median_threshold"))


def select_logloss(scores: DataFrame) -> DataFrame:
    return best(logloss_summary(scores), ["target"], "selection_score", "mean_logloss", "max_logloss", "submission_strategy", "model_name", "shrink_alpha")


def registry(scores: DataFrame) -> DataFrame:
    """The best alpha of each target and strategy, with the file-safe source name."""
    out = best(logloss_summary(scores), ["target", "submission_strategy"], "selection_score", "mean_logloss", "max_logloss", "model_name", "shrink_alpha")
    return out.withColumn("source", file_safe("submission_strategy"))
