"""Calendar features and the model boundary: imputation, one-hot and label codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import finite, weekday


def calendar_features(df: DataFrame, date: str = "lifelog_date", later: str = "sleep_date", subject: str = "subject_id") -> DataFrame:
    """Add dayofweek (Monday 0), month, day, sleep_gap_days and days_since_start over all rows given."""
    first = df.groupBy(subject).agg(F.min(date).alias("_first"))
    out = df.join(first, subject)
    return out.withColumns({"dayofweek": weekday(date), "month": F.month(date), "day": F.dayofmonth(date), "sleep_gap_days": F.date_diff(later, date), "days_since_start": F.date_diff(date, F.col("_first"))}).drop("_first")


def imputed(df: DataFrame, train: DataFrame, key: str = "feature", value: str = "value") -> DataFrame:
    """Long features with missing and infinite values replaced by the training median of their feature, else 0.

    The median is of the values before infinite ones are taken out; an infinite median counts as 0.
    """
    medians = train.groupBy(key).agg(F.median(F.nanvl(F.col(value), F.lit(None))).alias("_median"))
    filled = F.coalesce(finite(F.col(value)), finite(F.col("_median")), F.lit(0.0))
    return df.join(medians, key, "left").withColumn(value, filled).drop("_median")


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Add ``{column}_{value}`` as 0.0 or 1.0 for the sorted values, last."""
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)).alias(f"{column}_{v}") for v in sorted(values)])


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): codes of the distinct values in their order, from 0."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)
