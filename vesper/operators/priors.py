"""Prior predictors: majorities of the whole, of a subject, of a weekday and of both, and blends of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import weekday

ALPHAS = (0.25, 0.5, 0.75)
ROLLING = (1, 3, 5, 7, 14)


def group_priors(fit: DataFrame) -> DataFrame:
    """Means of y by (target), (target, subject), (target, dow) and (target, subject, dow) in one pass; ``level`` tells which."""
    rows = fit.withColumn("dow", weekday("lifelog_date"))
    sets = F.grouping_id()
    out = rows.groupingSets([["target"], ["target", "subject_id"], ["target", "dow"], ["target", "subject_id", "dow"]], "target", "subject_id", "dow").agg(F.avg("y").alias("p"), F.count("y").alias("n"), sets.alias("_g"))
    level = F.when(F.col("_g") == 3, "global").when(F.col("_g") == 1, "subject").when(F.col("_g") == 2, "dow").otherwise("subject_dow")
    return out.withColumn("level", level).drop("_g")


def prior_probabilities(fit: DataFrame, predict: DataFrame) -> DataFrame:
    """``predict`` (row_id, subject_id, lifelog_date, target) with p_global, p_subject, p_dow and p_subject_dow, each falling back to the coarser one."""
    priors = group_priors(fit)
    level = lambda name, *keys: priors.where(F.col("level") == name).select(*keys, F.col("p").alias(f"_{name}"))
    out = predict.withColumn("dow", weekday("lifelog_date")).join(level("global", "target"), "target", "left")
    out = out.join(level("subject", "target", "subject_id"), ["target", "subject_id"], "left").join(level("dow", "target", "dow"), ["target", "dow"], "left").join(level("subject_dow", "target", "subject_id", "dow"), ["target", "subject_id", "dow"], "left")
    return out.select(
        *predict.columns, F.col("_global").alias("p_global"), F.coalesce("_subject", "_global").alias("p_subject"), F.coalesce("_dow", "_global").alias("p_dow"), F.coalesce("_subject_dow", "_subject", "_global").alias("p_subject_dow")
    )


def vote(p: Column | str) -> Column:
    return ((F.col(p) if isinstance(p, str) else p) >= 0.5).cast("int")


def prior_predictions(probabilities: DataFrame) -> DataFrame:
    """(predict columns, strategy, label) of all prior predictors. Blends are of probabilities here."""
    p = F.col
    named = {"global_majority": vote("p_global"), "subject_majority": vote("p_subject"), "subject_dow_majority": vote("p_subject_dow"), "global_dow_majority": vote("p_dow")}
    named |= {f"blend_subject_global_{a:g}": vote(a * p("p_subject") + (1 - a) * p("p_global")) for a in ALPHAS}
    return _long(probabilities, named)


def vote_blends(probabilities: DataFrame) -> DataFrame:
    """The blends as validation scores them: of hard votes instead of probabilities."""
    named = {f"blend_subject_global_{a:g}": vote(a * vote("p_subject") + (1 - a) * vote("p_global")) for a in ALPHAS}
    return _long(probabilities, named)


def _long(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    keep = [c for c in df.columns if not c.startswith("p_")]
    each = F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("label")) for n, c in named.items()])
    return df.select(*keep, F.explode(each).alias("_s")).select(*keep, "_s.*")


def rolling_majorities(fit: DataFrame, predict: DataFrame, sizes: tuple[int, ...] = ROLLING) -> DataFrame:
    """(predict columns, strategy, label): majority of a subject's last n labels, else the global one."""
    back = Window.partitionBy("subject_id", "target").orderBy(F.col("lifelog_date").desc(), F.col("row_id").desc())
    tails = fit.withColumn("_back", F.row_number().over(back)).groupBy("subject_id", "target").agg(*[F.avg(F.when(F.col("_back") <= n, F.col("y"))).alias(f"_{n}") for n in sizes])
    whole = fit.groupBy("target").agg(F.avg("y").alias("_global"))
    out = predict.join(tails, ["subject_id", "target"], "left").join(whole, "target", "left")
    each = F.array(*[F.struct(F.lit(f"rolling_last_{n}").alias("strategy"), vote(F.coalesce(f"_{n}", "_global")).alias("label")) for n in sizes])
    return out.select(*predict.columns, F.explode(each).alias("_s")).select(*predict.columns, "_s.*")
