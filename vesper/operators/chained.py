"""The two-stage pipeline's features: shifted days, day and night sums, per-subject z-scores, and its fold loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import heart_rate
from ..functions.scalars import shifted_date, weekday
from ..sources.sinks import materialised
from .calendar import label_codes
from .folds import hole_folds
from .models import chained_ensembles, weighted_pair
from .registry import fit_all
from .scores import log_loss, zscored

DAY_HOURS = (6, 19)
PRESLEEP = (20, 23)
SLEEP = (0, 6)
KEY = ("subject_id", "date")


def hours(first: int, last: int, ts: str = "timestamp") -> Column:
    return F.hour(ts).between(first, last)


def shifted(df: DataFrame) -> DataFrame:
    """Rows under the date that begins at six; hours stay those of the clock."""
    return df.withColumn("date", shifted_date("timestamp"))


def split_sum(condition: Column, value: Column) -> Column:
    """The sum of the rows that match: 0 where those have no value, null where no row matches."""
    matched = F.count_if(condition) > 0
    return F.when(matched, F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0)))


def dual_features(sensors: dict[str, DataFrame]) -> DataFrame:
    """(subject_id, date, eight absolute features, their z-scores, dayofweek); each table is aggregated once."""
    parts: list[DataFrame] = []

    def add(name: str, *aggregates: Column) -> None:
        if name in sensors:
            parts.append(shifted(sensors[name]).groupBy(*KEY).agg(*aggregates))

    day = hours(*DAY_HOURS)
    add("mActivity", split_sum(day, F.col("m_activity").cast("double")).alias("day_activity"), split_sum(~day, F.col("m_activity").cast("double")).alias("night_activity"))
    add("wPedo", F.coalesce(F.sum(F.col("step").cast("double")), F.lit(0.0)).alias("daily_steps"), F.coalesce(F.sum(F.col("burned_calories").cast("double")), F.lit(0.0)).alias("daily_calories"))
    add("mScreenStatus", F.avg(F.when(hours(*PRESLEEP), F.col("m_screen_use"))).alias("presleep_screen"), F.avg(F.when(hours(*SLEEP), F.col("m_screen_use"))).alias("sleep_screen"))
    if "wHr" in sensors:
        kind = dict(sensors["wHr"].dtypes)["heart_rate"]
        rate = heart_rate(F.col("heart_rate"), encoded=kind == "string")
        parts.append(shifted(sensors["wHr"]).withColumn("_hr", rate).where(hours(*SLEEP)).groupBy(*KEY).agg(F.avg("_hr").alias("sleep_hr")))
    add("mLight", F.avg(F.col("m_light").cast("double")).alias("daily_light"))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(KEY), "full")
    names = [c for c in out.columns if c not in KEY]
    return zscored(out, names).withColumn("dayofweek", weekday("date"))


ABSOLUTE = ("day_activity", "night_activity", "daily_steps", "daily_calories", "presleep_screen", "sleep_screen", "sleep_hr", "daily_light")


def chained_rows(labels: DataFrame, features: DataFrame) -> DataFrame:
    """(row_id, is_train, x, x2) of all label rows: the arrays of stage S (absolute features, weekday, subject code) and of
    stage Q (z-scores besides). A day without logs, and a feature without a value, has the training median, else 0.

    ``labels`` has row_id, is_train, subject_id and lifelog_date; ``features`` is the dual feature space, keyed by date.
    """
    absolute = [c for c in ABSOLUTE if c in features.columns]
    scaled = [f"{c}_zscore" for c in absolute]
    names = [*absolute, *scaled, "dayofweek"]
    rows = labels.join(features.withColumnRenamed("date", "lifelog_date"), ["subject_id", "lifelog_date"], "left")
    medians = rows.where("is_train").agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"_{c}") for c in names])  # one row
    filled = rows.join(F.broadcast(medians)).join(F.broadcast(label_codes(labels, "subject_id")), "subject_id")  # a row for each subject of the label files
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}"))
    own = [F.col("code").cast("double")]
    return filled.select("row_id", "is_train", F.array(*[value(c) for c in [*absolute, "dayofweek"]], *own).alias("x"), F.array(*[value(c) for c in names], *own).alias("x2"))


def out_of_fold(rows: DataFrame, template: DataFrame, targets: tuple[str, ...], n_folds: int, mode: str, seed: int, rounds: int = 150) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Held-out probabilities (row_id, target, y, p, fold), the template's means (row_id, target, p), and losses (target, fold, logloss).

    ``rows`` has row_id, fold, x and a column for each target. Every target and fold is a label set of one table, so that all of
    their models grow in the same passes; row_id tells rows and template apart.
    """
    sets = [(t, f) for t in targets for f in range(n_folds)]
    role = [F.when(F.col("fold") == f, 2).otherwise(F.col(t).cast("int")) for t, f in sets]
    every = rows.select("row_id", "x", F.array(*role).alias("roles")).unionByName(template.select("row_id", "x", F.array(*[F.lit(2)] * len(sets)).alias("roles")))
    pair = weighted_pair(mode)
    asked = [(k, model, None) for k in range(len(sets)) for model, _ in pair]
    found = fit_all(every, len(sets), asked, seed, chained_ensembles(rounds))
    named = F.array(*[F.struct(F.lit(sets[k][0]).alias("target"), F.lit(sets[k][1]).alias("fold"), F.lit(w).alias("w")) for k in range(len(sets)) for _, w in pair])
    p = found.withColumn("_s", F.get(named, F.col("fit"))).groupBy("row_id", "_s.target", "_s.fold").agg(F.sum(F.col("p") * F.col("_s.w")).alias("p"))
    p = materialised(p)
    y = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in targets])).alias("_y")
    held = materialised(p.join(rows.select("row_id", "fold", y).select("row_id", "fold", "_y.*"), ["row_id", "target", "fold"]))
    tests = p.join(template.select("row_id"), "row_id").groupBy("row_id", "target").agg(F.avg("p").alias("p"))
    return held, materialised(tests), held.groupBy("target", "fold").agg(log_loss("y", "p"))


S_TARGETS, Q_TARGETS = ("S1", "S2", "S3", "S4"), ("Q1", "Q2", "Q3")

# The variants, by name: how many folds, and the model pairs of both stages.
VARIANTS = {
    "xgb_only": (5, "xgb", "xgb"),
    "lgbm_xgb_50_50": (5, "lgbm_xgb_50_50", "lgbm_xgb_50_50"),
    "lgbm_xgb_30_70": (5, "lgbm_xgb_30_70", "lgbm_xgb_30_70"),
    "q_xgb_s_blend": (5, "blend", "xgb"),
    "q_70_s_blend": (5, "blend", "lgbm_xgb_30_70"),
    "hole7_blend": (7, "blend", "blend"),
}


def two_stages(rows: DataFrame, labels: DataFrame, n_folds: int = 5, s_mode: str = "blend", q_mode: str = "blend", chain: bool = True, rounds: int = 150) -> tuple[DataFrame, DataFrame]:
    """(row_id, target, value) for the template and (target, stage, model_blend, logloss): stage S first, whose probabilities are features of stage Q.

    ``rows`` has row_id, is_train, x and x2 of all rows, ``labels`` row_id, subject_id, sleep_date and the targets of those to fit on.
    """
    folded = rows.where("is_train").join(hole_folds(labels, n_folds).select("row_id", "fold"), "row_id")
    ahead = rows.where("not is_train")
    known = labels.select("row_id", *[F.coalesce(F.col(t), F.lit(0)).alias(t) for t in (*S_TARGETS, *Q_TARGETS)])
    held, tests, losses = out_of_fold(folded.select("row_id", "fold", "x").join(known, "row_id"), ahead.select("row_id", "x"), S_TARGETS, n_folds, s_mode, 4200, rounds)
    wide, wide_ahead = folded.select("row_id", "fold", F.col("x2").alias("x")), ahead.select("row_id", F.col("x2").alias("x"))
    if chain:
        # the S probabilities in the targets' order are features of stage Q
        also = lambda p: p.groupBy("row_id").pivot("target", list(S_TARGETS)).agg(F.first("p"))
        add = lambda df, p: df.join(also(p), "row_id", "left").withColumn("x", F.concat("x", F.array(*[F.coalesce(t, F.lit(0.0)) for t in S_TARGETS]))).drop(*S_TARGETS)
        wide, wide_ahead = materialised(add(wide, held)), materialised(add(wide_ahead, tests))
    _, q_tests, q_losses = out_of_fold(wide.join(known, "row_id"), wide_ahead, Q_TARGETS, n_folds, q_mode, 5200, rounds)
    value = tests.unionByName(q_tests).select("row_id", "target", F.col("p").alias("value"))
    scored = []
    for stage, mode, loss in (("S", s_mode, losses), ("Q", q_mode, q_losses)):
        pair = "+".join(m for m, _ in weighted_pair(mode))
        scored.append(loss.groupBy("target").agg(F.avg("logloss").alias("logloss")).select("target", F.lit(stage).alias("stage"), F.lit(pair).alias("model_blend"), "logloss"))
    return value, scored[0].unionByName(scored[1])
