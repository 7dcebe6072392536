"""Per-subject rules and their tuning: 29 candidates evaluated at once for every subject, target and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import weekday
from .blocks import places
from .folds import temporal_mask
from .history import MOST
from .scores import binary_scores

# Rule sizes, in candidate order.
ROLLING = (1, 2, 3, 5, 7, 10, 14, 21, 28)
CYCLES = (3, 5, 7, 10, 14, 21, 28)
LAGS = tuple(range(1, 10))
RULES = ("all_0", "all_1", "subject_dow_majority", "last_same_dow", *[f"rolling_last_{n}" for n in ROLLING], *[f"cycle_last_{n}" for n in CYCLES], *[f"repeat_lag_{n}" for n in LAGS])
FALLBACK = "rolling_last_14"
_KEEP = max(*ROLLING, *CYCLES, *LAGS)
_ID = ["subject_id", "target"]


def known_rule(name: str) -> str:
    if name not in RULES:
        raise ValueError(f"unknown rule: {name}")
    return name


def _placed(predict: DataFrame, most: int) -> DataFrame:
    """Add ``_pos``, a row's place among its subject's in the frame's order: by a window, or by blocks where a subject has more rows than that."""
    if predict.groupBy(*_ID).count().where(F.col("count") > most).isEmpty():
        return predict.withColumn("_pos", F.row_number().over(Window.partitionBy(*_ID).orderBy("row_id")) - 1)
    return places(predict, _ID, ["row_id"], "_pos")


def rule_labels(fit: DataFrame, predict: DataFrame, most: int = MOST) -> DataFrame:
    """(predict columns, rule, ord, label) of every rule.

    A subject's state is bounded: its last 28 labels, its mean, and per weekday mean and last label.
    Subjects without labels get 1 from every rule but ``all_0``.
    """
    back = Window.partitionBy(*_ID).orderBy(F.col("lifelog_date").desc(), F.col("row_id").desc())
    rows = fit.withColumn("_dow", weekday("lifelog_date"))
    # only a subject's last rows are ranked: Spark keeps as many of each task before they are dealt out
    tails = fit.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= _KEEP)
    tails = tails.groupBy(*_ID).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("o"), "y"))), lambda x: x["y"]).alias("_tail"))
    state = rows.groupBy(*_ID).agg(F.avg("y").alias("_mean")).join(tails, _ID)
    dows = rows.groupBy(*_ID, "_dow").agg(F.avg("y").alias("_dow_mean"), F.max_by("y", F.struct("lifelog_date", "row_id")).alias("_dow_last"))
    out = _placed(predict, most).withColumn("_dow", weekday("lifelog_date"))
    out = out.join(state, _ID, "left").join(dows, [*_ID, "_dow"], "left")
    size = F.size("_tail")
    last = F.element_at("_tail", -1)
    tail_of = lambda n: F.slice("_tail", F.greatest(size - n, F.lit(0)) + 1, n)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def cycle(n: int) -> Column:
        return F.get(tail_of(n), F.col("_pos") % F.least(size, F.lit(n)))

    values = [F.lit(0.0), F.lit(1.0), (F.coalesce("_dow_mean", "_mean") >= 0.5).cast("double"), F.coalesce("_dow_last", last)]
    values += [(mean(tail_of(n)) >= 0.5).cast("double") for n in ROLLING] + [cycle(n) for n in CYCLES]
    values += [F.coalesce(F.get("_tail", size - n), last) for n in LAGS]
    unseen = F.col("_tail").isNull() | (size == 0)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("ord"), F.when(unseen, F.lit(1)).otherwise(v.cast("int")).alias("label")) for i, (r, v) in enumerate(zip(RULES, values))])
    return out.select(*predict.columns, F.explode(each).alias("_r")).select(*predict.columns, "_r.*")


def tuned_rules(labels: DataFrame, first: str = "accuracy", second: str = "f1", q: float = 0.75) -> DataFrame:
    """(subject_id, target, rule): the rule that does best on the subject's last quarter after a fit on the rest.

    ``first`` and ``second`` are the scores that count, ties go to the earlier candidate; a subject whose
    inner split has an empty side gets ``rolling_last_14``.
    """
    split = temporal_mask(labels, q)
    fit, valid = split.where("not is_valid"), split.where("is_valid")
    tried = rule_labels(fit.select(*labels.columns), valid.select(*labels.columns))
    seen = fit.select(*_ID).distinct()
    scored = tried.join(seen, _ID, "left_semi").groupBy(*_ID, "rule", "ord").agg(*binary_scores("y", "label"))
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy(*_ID).orderBy(F.col(first).desc(), F.col(second).desc(), "ord"))).where("_r = 1")
    return labels.select(*_ID).distinct().join(best.select(*_ID, "rule"), _ID, "left").withColumn("rule", F.coalesce("rule", F.lit(FALLBACK)))


def tuned_predictions(labels: DataFrame, predict: DataFrame, first: str = "accuracy", second: str = "f1") -> DataFrame:
    """(predict columns, label): each subject's tuned rule refitted on all its labels; unseen subjects get 1."""
    rules = tuned_rules(labels, first, second)
    every = rule_labels(labels, predict)
    chosen = every.join(rules.withColumnRenamed("rule", "_rule"), _ID, "left").where(F.col("rule") == F.coalesce("_rule", F.lit("all_1")))
    return chosen.select(*predict.columns, "label")


def validation_predictions(fit: DataFrame, valid: DataFrame) -> DataFrame:
    """(valid columns, label) of rules tuned on the fit rows alone, f1 first; unseen subjects get the global majority."""
    rules = tuned_rules(fit, "f1", "accuracy")
    whole = fit.groupBy("target").agg((F.avg("y") >= 0.5).cast("int").alias("_all"))
    every = rule_labels(fit, valid).join(rules.withColumnRenamed("rule", "_rule"), _ID, "left").join(whole, "target", "left")
    chosen = every.where(F.col("rule") == F.coalesce("_rule", F.lit("all_1")))
    return chosen.select(*valid.columns, F.when(F.col("_rule").isNull(), F.col("_all")).otherwise(F.col("label")).alias("label"))


def optimistic_predictions(fit: DataFrame, valid: DataFrame) -> DataFrame:
    """(valid columns, label) of rules picked on the very rows they are then scored on: a bound, not an estimate."""
    every = rule_labels(fit, valid)
    scored = every.groupBy(*_ID, "rule", "ord").agg(*binary_scores("y", "label"))
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy(*_ID).orderBy(F.col("accuracy").desc(), F.col("f1").desc(), "ord"))).where("_r = 1").select(*_ID, "rule")
    return every.join(best, [*_ID, "rule"]).select(*valid.columns, "label")
