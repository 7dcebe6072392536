"""Sinks: predictions in template order, score tables, and a registry by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import KEYS, PROBABILITY_CLIP, TARGETS
from ..functions.scalars import clipped_probability, file_safe
from .cluster import set_checkpoint_dir


def materialised(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder, so that what is used twice is made once."""
    set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def predictions_frame(template: DataFrame, predictions: DataFrame, as_int: bool = True, clip: float = PROBABILITY_CLIP) -> DataFrame:
    """Keys and targets in the template's order; labels as integers, or clipped probabilities.

    ``predictions`` has row_id, target and value; the template has row_id and the keys.
    """
    # one aggregation by row: a pivot would first group by row and target, seven times the groups
    wide = predictions.groupBy("row_id").agg(*[F.first(F.when(F.col("target") == t, F.col("value")), ignorenulls=True).alias(t) for t in TARGETS])
    value = lambda t: F.col(t).cast("int") if as_int else clipped_probability(t, clip)
    dates = [F.date_format(k, "yyyy-MM-dd").alias(k) if k != "subject_id" else F.col(k) for k in KEYS]
    return template.select("row_id", *KEYS).join(wide, "row_id", "left").orderBy("row_id").select(*dates, *[value(t).alias(t) for t in TARGETS])


def write_csv(df: DataFrame, path: str) -> None:
    """One headed CSV part: for tables of a row per prediction or score, in the frame's order."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_registry(df: DataFrame, folder: str) -> DataFrame:
    """Probabilities of many strategies (column ``strategy``) partitioned by a file-safe source name; returns the manifest."""
    named = df.withColumn("source", file_safe("strategy"))
    named.write.mode("overwrite").partitionBy("source").parquet(f"{folder}/registry")
    manifest = named.groupBy("source", "strategy").agg(F.count("*").alias("n_rows"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return df.sparkSession.read.parquet(f"{folder}/manifest")


def top_rows(scores: DataFrame, by: list, keys: list[str], n: int = 3) -> DataFrame:
    """The best ``n`` rows of each group in the order ``by``, with their rank."""
    from pyspark.sql.window import Window

    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= n)
