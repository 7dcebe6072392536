"""Label history: what a subject's earlier rows say about a row.

Groups of up to ``MOST`` rows are windows by subject. Where some subject has more, rows are cut into blocks in order of time, and each
block is scanned with what is carried into it: the 14 labels before it, counts and sums of labels, of changes and by weekday, and the
length of the run that it continues. Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import weekday
from ..sources.sinks import materialised
from .blocks import BLOCK, blocked, with_previous

LASTS = (1, 3, 7, 14)
#: Rows of a subject and target that one window takes.
MOST = 100_000
COLUMNS = (*[f"last_{n}_mean" for n in LASTS], "last_value", "streak", "change_rate", "dow_mean", "history_count")


def long_labels(df: DataFrame, targets: tuple[str, ...] | list[str]) -> DataFrame:
    """(row_id, subject_id, lifelog_date, target, y): one row per label, so all targets share one pass."""
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets])
    return df.select("row_id", "subject_id", "lifelog_date", F.explode(each).alias("_t")).select("row_id", "subject_id", "lifelog_date", "_t.*")


OWN = ["subject_id", "target"]


def _crowded(labels: DataFrame, most: int) -> bool:
    return not labels.groupBy(*OWN).count().where(F.col("count") > most).isEmpty()


def label_history(labels: DataFrame, most: int = MOST, partitions: int | None = None) -> DataFrame:
    """The nine history columns of each label row (row_id, subject_id, lifelog_date, target, y)."""
    if _crowded(labels, most):
        return _scanned(labels, partitions)
    own = Window.partitionBy("subject_id", "target").orderBy("lifelog_date", "row_id")
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    out = labels.withColumn("_dow", weekday("lifelog_date")).withColumn("last_value", F.lag("y").over(own))
    out = out.withColumn("_change", F.abs(F.col("y") - F.col("last_value")))
    out = out.withColumn("_island", F.sum(F.coalesce("_change", F.lit(0.0))).over(own))
    run = F.row_number().over(Window.partitionBy("subject_id", "target", "_island").orderBy("lifelog_date", "row_id"))
    out = out.withColumn("_run", F.when(F.col("y") == 1, run).otherwise(-run))
    out = out.withColumns({f"last_{n}_mean": F.avg("y").over(own.rowsBetween(-n, -1)) for n in LASTS})
    dow = Window.partitionBy("subject_id", "target", "_dow").orderBy("lifelog_date", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    return out.select(
        *labels.columns, *[f"last_{n}_mean" for n in LASTS], "last_value", F.coalesce(F.lag("_run").over(own), F.lit(0)).cast("double").alias("streak"),
        F.avg("_change").over(past).alias("change_rate"), F.avg("y").over(dow).alias("dow_mean"), F.count("y").over(past).cast("double").alias("history_count"),
    )


def _scanned(labels: DataFrame, partitions: int | None = None) -> DataFrame:
    """``label_history`` by blocks. Sums of labels and changes are of zeros and ones, so their order doesn't matter."""
    order = ["lifelog_date", "row_id"]
    rows = blocked(labels.withColumn("_dow", weekday("lifelog_date")), OWN, order, partitions)
    w = Window.partitionBy(*OWN, BLOCK).orderBy("_ago", *order)
    past, real, zero = w.rowsBetween(Window.unboundedPreceding, -1), F.col("_ago") == 0, F.lit(0.0)
    rows = with_previous(rows, OWN, order, ["y"], max(LASTS))
    rows = rows.withColumns({f"last_{n}_mean": F.avg("y").over(w.rowsBetween(-n, -1)) for n in LASTS}).withColumns({"last_value": F.lag("y").over(w), "_follows": F.lag("_ago").over(w)})
    rows = rows.withColumn("_change", F.when(real, F.abs(F.col("y") - F.col("last_value"))))
    rows = rows.withColumn("_island", F.sum(F.coalesce("_change", zero)).over(w))
    rows = rows.withColumns({"_changed": F.sum("_change").over(past), "_changes": F.count("_change").over(past), "_count": F.count(F.when(real, F.col("y"))).over(past)}).where(real)
    rows = rows.withColumn("_run", F.row_number().over(Window.partitionBy(*OWN, BLOCK, "_island").orderBy(*order)))
    week = Window.partitionBy(*OWN, BLOCK, "_dow").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = materialised(rows.withColumns({"_day_sum": F.sum("y").over(week), "_day_count": F.count("y").over(week)}))
    earlier = Window.partitionBy(*OWN).orderBy(BLOCK)
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*OWN, BLOCK).agg(F.sum("_change").alias("_c"), F.count("_change").alias("_cn"), F.count("y").alias("_n"), F.max("_island").alias("_breaks"), F.max_by("_run", F.struct("_island", "_run")).alias("_trail"))
    # a block with a change ends the run that came into it; its last run and the blocks without one after it are the next
    sums = sums.withColumn("_group", F.sum((F.col("_breaks") > 0).cast("int")).over(earlier))
    sums = sums.withColumn("_length", F.sum("_trail").over(Window.partitionBy(*OWN, "_group").orderBy(BLOCK)))
    sums = sums.select(*OWN, BLOCK, F.sum("_c").over(before).alias("_c0"), F.sum("_cn").over(before).alias("_cn0"), F.sum("_n").over(before).alias("_n0"), F.lag("_length").over(earlier).alias("_run0"))
    days = rows.groupBy(*OWN, BLOCK, "_dow").agg(F.sum("y").alias("_d"), F.count("y").alias("_dn"))
    daily = Window.partitionBy(*OWN, "_dow").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*OWN, BLOCK, "_dow", F.sum("_d").over(daily).alias("_d0"), F.sum("_dn").over(daily).alias("_dn0"))
    out = _beside(_beside(rows, sums, [*OWN, BLOCK]), days, [*OWN, BLOCK, "_dow"])
    plus = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    run = F.col("_run") + F.when(F.col("_island") == 0, F.coalesce("_run0", F.lit(0))).otherwise(0)
    out = out.withColumn("_signed", F.when(F.col("y") == 1, run).otherwise(-run))
    w = Window.partitionBy(*OWN, BLOCK).orderBy(*order)
    carried = F.when(F.col("last_value") == 1, F.col("_run0")).otherwise(-F.col("_run0"))
    streak = F.when(F.col("_follows") == 0, F.lag("_signed").over(w)).when(F.col("_follows").isNotNull(), carried)
    ratio = lambda a, b: F.when(b > 0, a / b)
    return out.select(
        *labels.columns, *[f"last_{n}_mean" for n in LASTS], "last_value", F.coalesce(streak, F.lit(0)).cast("double").alias("streak"),
        ratio(plus("_c0", "_changed"), plus("_cn0", "_changes")).alias("change_rate"), ratio(plus("_d0", "_day_sum"), plus("_dn0", "_day_count")).alias("dow_mean"),
        plus("_n0", "_count").cast("double").alias("history_count"),
    )


def _beside(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Left join by keys that may be null, without the right side's keys."""
    renamed = more.select(*[F.col(k).alias(f"_of{k}") for k in keys], *[c for c in more.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys]
    return rows.join(renamed, on, "left").drop(*[f"_of{k}" for k in keys])


def template_history(labels: DataFrame, template: DataFrame, most: int = MOST, partitions: int | None = None) -> DataFrame:
    """The same columns for rows without labels, from all of their subject's labels in file order, later-dated ones too.

    Of a subject's rows only the last 14 are ranked; the last run is what stands from the last change on, so all else is sums.
    """
    ahead = Window.partitionBy(*OWN).orderBy("row_id")
    if _crowded(labels, most):
        pairs = with_previous(blocked(labels, OWN, ["row_id"], partitions), OWN, ["row_id"], ["y"], 1)
        changed = pairs.withColumn("_change", F.abs(F.col("y") - F.lag("y").over(Window.partitionBy(*OWN, BLOCK).orderBy("_ago", "row_id")))).where("_ago = 0")
    else:
        changed = labels.withColumn("_change", F.abs(F.col("y") - F.lag("y").over(ahead)))
    changed = materialised(changed.select(*OWN, "row_id", "lifelog_date", "y", "_change"))
    last = changed.groupBy(*OWN).agg(F.max(F.when(F.col("_change") > 0, F.col("row_id"))).alias("_since"))
    rows = _beside(changed, last, OWN)
    tail = changed.withColumn("_back", F.row_number().over(Window.partitionBy(*OWN).orderBy(F.col("row_id").desc()))).where(F.col("_back") <= max(LASTS))
    tail = tail.groupBy(*OWN).agg(*[F.avg(F.when(F.col("_back") <= n, F.col("y"))).alias(f"last_{n}_mean") for n in LASTS], F.max(F.when(F.col("_back") == 1, F.col("y"))).alias("last_value"))
    whole = rows.groupBy(*OWN).agg(
        F.sum(F.when(F.col("_since").isNull() | (F.col("row_id") >= F.col("_since")), F.when(F.col("y") == 1, 1.0).otherwise(-1.0))).alias("streak"),
        F.avg("_change").alias("change_rate"),
        F.count("y").cast("double").alias("history_count"),
    )
    whole = _beside(whole, tail, OWN)
    dows = rows.groupBy("subject_id", "target", weekday("lifelog_date").alias("_dow")).agg(F.avg("y").alias("dow_mean"))
    targets = labels.select("target").distinct()
    wanted = template.select("row_id", "subject_id", "lifelog_date", weekday("lifelog_date").alias("_dow")).join(F.broadcast(targets))  # seven targets
    out = wanted.join(whole, ["subject_id", "target"], "left").join(dows, ["subject_id", "target", "_dow"], "left")
    return out.select("row_id", "subject_id", "lifelog_date", "target", *[F.coalesce(c, F.lit(0.0)).alias(c) if c in ("streak", "history_count") else F.col(c) for c in COLUMNS])
