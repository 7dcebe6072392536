"""Scores of binary predictions, their summaries over folds, and z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import ZSCORE_EPSILON
from ..functions.scalars import _c, clipped_probability


def binary_scores(y: Column | str, label: Column | str) -> list[Column]:
    """Aggregates accuracy, f1 and positive_rate; precision and recall of nothing are 0."""
    y, p = _c(y), _c(label)
    hits = F.count_if((y == 1) & (p == 1)).cast("double")
    precision = hits / F.greatest(F.count_if(p == 1).cast("double"), F.lit(1.0))
    recall = hits / F.greatest(F.count_if(y == 1).cast("double"), F.lit(1.0))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    return [F.avg((y == p).cast("double")).alias("accuracy"), f1.alias("f1"), F.avg(p.cast("double")).alias("positive_rate")]


def log_loss(y: Column | str, p: Column | str) -> Column:
    y, q = _c(y).cast("double"), clipped_probability(p)
    return (-F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("logloss")


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("strategy", "target").agg(*[F.avg(c).alias(c) for c in ("accuracy", "f1", "positive_rate")])


def logloss_summary(scores: DataFrame) -> DataFrame:
    """Per (target, strategy, model, alpha): mean, std, max over folds, and the selection score."""
    out = scores.groupBy("target", "submission_strategy", "model_name", "shrink_alpha").agg(
        F.avg("logloss").alias("mean_logloss"), F.coalesce(F.stddev_samp("logloss"), F.lit(0.0)).alias("std_logloss"), F.max("logloss").alias("max_logloss"), F.count_distinct("fold").alias("folds")
    )
    return out.withColumn("selection_score", F.col("mean_logloss") + 0.25 * F.col("std_logloss") + 0.05 * F.col("max_logloss"))


def generalization_summary(scores: DataFrame) -> DataFrame:
    """Per (target, strategy, model): f1 over folds and the generalization score."""
    out = scores.groupBy("target", "submission_strategy", "model_name").agg(
        F.avg("f1").alias("mean_f1"), F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("std_f1"), F.min("f1").alias("min_f1"), F.avg("accuracy").alias("mean_accuracy"),
        F.avg("prior_gap").alias("mean_prior_gap"), F.median("threshold").alias("median_threshold"), F.count_distinct("fold").alias("folds"),
    )
    return out.withColumn("generalization_score", F.col("mean_f1") - 0.5 * F.col("std_f1") + 0.1 * F.col("min_f1"))


def mean_by(scores: DataFrame, *keys: str, value: str = "logloss", limit: int | None = None) -> DataFrame:
    """Leaderboards: the mean of a score by variant, source, model type or fold, best first; all or the first ``limit``."""
    out = scores.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}")).orderBy(f"mean_{value}", *keys)
    return out if limit is None else out.limit(limit)


def fold_mean(scores: DataFrame, *keys: str, value: str = "logloss") -> DataFrame:
    """Unweighted mean over folds, whatever their sizes."""
    return scores.groupBy(*keys).agg(F.avg(value).alias(value), F.count_distinct("fold").alias("folds"))


def zscored(df: DataFrame, columns: list[str], subject: str = "subject_id") -> DataFrame:
    """Add ``{column}_zscore``: the distance from the subject's mean in sample standard deviations."""
    own = Window.partitionBy(subject)
    return df.withColumns({f"{c}_zscore": (F.col(c) - F.avg(c).over(own)) / (F.stddev_samp(c).over(own) + ZSCORE_EPSILON) for c in columns})
