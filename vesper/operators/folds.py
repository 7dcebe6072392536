"""Validation folds as rows: temporal masks, rolling masks and subject holes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import ROLLING_MASKS


def temporal_mask(df: DataFrame, q: float = 0.75, subject: str = "subject_id", date: str = "lifelog_date") -> DataFrame:
    """Add is_valid: dates from the subject's linear ``q`` quantile on."""
    cutoff = df.groupBy(subject).agg(F.percentile(F.unix_date(date), F.lit(q)).alias("_cutoff"))
    return df.join(cutoff, subject).withColumn("is_valid", F.unix_date(date) >= F.col("_cutoff")).drop("_cutoff")


def rolling_masks(df: DataFrame, masks: dict[str, float] = ROLLING_MASKS, subject: str = "subject_id", date: str = "lifelog_date") -> DataFrame:
    """(fold, all columns, is_valid): the rows once for each named mask; one aggregation gives all cutoffs."""
    days = F.unix_date(date)
    cutoffs = df.groupBy(subject).agg(F.array(*[F.struct(F.lit(name).alias("fold"), F.percentile(days, F.lit(float(q))).alias("cutoff")) for name, q in masks.items()]).alias("_c"))
    out = df.join(cutoffs, subject).withColumn("_m", F.explode("_c"))
    return out.select(F.col("_m.fold").alias("fold"), *df.columns, (days >= F.col("_m.cutoff")).alias("is_valid"))


def hole_folds(df: DataFrame, n: int = 5, subject: str = "subject_id", order: tuple[str, ...] = ("sleep_date", "row_id")) -> DataFrame:
    """Add block and fold: a subject's rows in order, cut into max(2n, 4) nearly equal blocks; fold f validates blocks f and f + n."""
    own = Window.partitionBy(subject).orderBy(*order)
    out = df.withColumn("block", F.ntile(max(2 * n, 4)).over(own) - 1)
    return out.withColumn("fold", F.col("block") % n)


def complement(df: DataFrame, fold: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that the fold does not validate."""
    return df.join(fold.select(key), key, "left_anti")


def subject_folds(df: DataFrame, subject: str = "subject_id") -> DataFrame:
    """(fold, all columns, is_valid): each subject held out once, and the last quarter of every subject as the fold of that name."""
    subjects = df.select(F.col(subject).alias("_held")).distinct()
    # rows times subjects: the definition of leaving each one out; the list of subjects is a column of the label file
    out = df.join(subjects).withColumn("is_valid", F.col(subject) == F.col("_held"))
    one = out.select(F.col("_held").alias("fold"), *df.columns, "is_valid")
    return one.unionByName(temporal_mask(df).select(F.lit("last_quarter_by_subject").alias("fold"), *df.columns, "is_valid"))
