"""Daily, hour-window and period statistics of sensor values, kept long: one row per key and feature.

Thousands of features never become columns; a group is (subject, date, window, column), and all tables
and windows go through the same aggregation, so unions take the place of outer joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.constants import EPSILON, PAIRS, PERIODS, RATIO_LIMIT, WINDOWS
from ..functions.scalars import calendar_date, time_period
from ..sources.sinks import materialised

KEY = ("subject_id", "lifelog_date")
DAILY = ("mean", "std", "min", "max", "median", "sum", "count")
WINDOWED = (*DAILY, "nunique")
PERIODIC = ("mean", "sum", "count")
WHOLE_DAY = "daily_00_24"


def keyed(df: DataFrame, subject: str = "subject_id", ts: str = "timestamp") -> DataFrame:
    """Rows with subject, date, hour and period; rows without a key belong to no group."""
    out = df.where(F.col(subject).isNotNull() & F.col(ts).isNotNull())
    return out.withColumns({"subject_id": F.col(subject).cast("string"), "lifelog_date": calendar_date(ts), "_hour": F.hour(ts), "_period": time_period(ts)})


def melted(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(keep, column, value): one row per value column; a single column needs no generator."""
    if len(columns) == 1:
        return df.select(*keep, F.lit(columns[0]).alias("column"), F.col(columns[0]).cast("double").alias("value"))
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(each).alias("_v")).select(*keep, "_v.*")


def aggregates(value: Column, names: tuple[str, ...]) -> list[Column]:
    """Named statistics: of a group without values the sum and counts are 0, the others null."""
    made = {
        "mean": F.avg(value),
        "std": F.stddev_samp(value),
        "min": F.min(value),
        "max": F.max(value),
        "median": F.median(value),
        "sum": F.coalesce(F.sum(value), F.lit(0.0)),
        "count": F.count(value).cast("double"),
        "nunique": F.count_distinct(value).cast("double"),
    }
    return [made[n].alias(n) for n in names]


def grouped_stats(values: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    return values.groupBy(*keys).agg(*aggregates(F.col("value"), names))


def daily_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    return grouped_stats(melted(df, columns, *KEY), [*KEY, "column"], DAILY)


def _in_window(name: str) -> Column:
    return F.col("_hour").isin(list(WINDOWS[name]))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(key, column, value, a count for each window): how often a value stands in each window, nulls among the values.

    A row is counted where it is, for all windows at once, and never repeated for the windows that hold its hour.
    """
    return melted(df, columns, *KEY, "_hour").groupBy(*KEY, "column", "value").agg(*[F.count_if(_in_window(w)).alias(w) for w in WINDOWS])


def stats_of_counts(counts: DataFrame) -> DataFrame:
    """Per key, window and column the statistics of ``value_counts``; a window without rows has no row.

    Values are sorted once for a key and column. A window's median stands where its running count passes the half, so that
    no task holds the values of a group in memory: the sort spills. What a group's rows have in common is one struct, whose
    aggregation goes along the sorted rows instead of keeping a wide row for every group. Rows are dealt out by key into the session's
    number of partitions, which stay apart: counts pack well, so merged ones that are small on disk would be wide in memory.
    """
    counts = counts.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)
    group = Window.partitionBy(*KEY, "column")
    ahead = group.orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col("value")
    known = counts.withColumns({f"_n_{w}": F.when(v.isNotNull(), F.col(w)).otherwise(0) for w in WINDOWS})
    held = lambda w, x: F.when(F.col(f"_n_{w}") > 0, x)
    run = known.withColumns({f"_run_{w}": F.sum(f"_n_{w}").over(ahead) for w in WINDOWS})
    run = run.withColumns({f"_all_{w}": F.sum(f"_n_{w}").over(group) for w in WINDOWS} | {f"_sum_{w}": F.sum(held(w, v * F.col(f"_n_{w}"))).over(group) for w in WINDOWS})
    made = [F.first(F.struct(*[F.col(f"_{x}_{w}") for x in ("all", "sum") for w in WINDOWS])).alias("_same")]
    for w in WINDOWS:
        n, total, mean = F.col(f"_n_{w}"), F.col(f"_all_{w}"), F.try_divide(f"_sum_{w}", f"_all_{w}")
        at_rank = lambda k: F.min(held(w, F.when(F.col(f"_run_{w}") >= k, v)))  # noqa: E731, B023
        made += [
            F.sum(w).alias(f"_rows_{w}"), F.sum(held(w, n * F.pow(v - mean, 2))).alias(f"_squares_{w}"),
            F.min(held(w, v)).alias(f"_min_{w}"), F.max(held(w, v)).alias(f"_max_{w}"), F.count_if(n > 0).alias(f"_kinds_{w}"),
            at_rank(F.floor((total + 1) / 2)).alias(f"_low_{w}"), at_rank(F.floor(total / 2) + 1).alias(f"_high_{w}"),
        ]
    wide = run.groupBy(*KEY, "column").agg(*made)

    def of(w: str) -> Column:
        same = {"count": "all", "total": "sum"}
        c = lambda name: F.col(f"_same._{same[name]}_{w}" if name in same else f"_{name}_{w}")
        low, high = c("low"), c("high")
        return F.struct(
            F.lit(w).alias("window"), c("rows").alias("_rows"), F.try_divide(c("total"), c("count")).alias("mean"), F.when(c("count") > 1, F.sqrt(c("squares") / (c("count") - 1))).alias("std"),
            c("min").alias("min"), c("max").alias("max"), F.when(low == high, low).otherwise(0.5 * low + 0.5 * high).alias("median"),
            F.coalesce(c("total"), F.lit(0.0)).alias("sum"), c("count").cast("double").alias("count"), c("kinds").cast("double").alias("nunique"),
        )

    each = wide.select(*KEY, "column", F.explode(F.array(*map(of, WINDOWS))).alias("_w")).where("_w._rows > 0")
    return each.select(*KEY, "_w.window", "column", *[f"_w.{n}" for n in WINDOWED])


def window_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per key, window and column; a window without rows has no row here."""
    return stats_of_counts(value_counts(df, columns))


def period_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    return grouped_stats(melted(df, columns, *KEY, "_period"), [*KEY, "_period", "column"], PERIODIC).withColumnRenamed("_period", "period")


def row_counts(df: DataFrame) -> DataFrame:
    """(key, scope, name, n): rows a day, a window and a period; periods without rows on a day that has some are 0."""
    counted = {"day": {"": F.lit(True)}, "period": {p: F.col("_period") == p for p in PERIODS}, "window": {w: _in_window(w) for w in WINDOWS}}
    each = [(scope, name, hit) for scope, names in counted.items() for name, hit in names.items()]
    days = df.groupBy(*KEY).agg(*[F.count_if(hit).alias(f"_{i}") for i, (_, _, hit) in enumerate(each)])
    parts = F.array(*[F.struct(F.lit(scope).alias("scope"), F.lit(name).alias("name"), F.col(f"_{i}").alias("n")) for i, (scope, name, _) in enumerate(each)])
    return days.select(*KEY, F.explode(parts).alias("_c")).select(*KEY, "_c.*").where("scope <> 'window' or n > 0")


def value_name(value: Column, integral: bool) -> Column:
    """The value as feature names have it: integers as such, others with the point as an underscore."""
    return value.cast("long").cast("string") if integral else F.replace(F.format_string("%s", value), F.lit("."), F.lit("_"))


def value_proportions(values: DataFrame, scope: list[str], limit: int = RATIO_LIMIT) -> DataFrame:
    """(key, scope, column, value, ratio): the share of each value among a group's values.

    Only columns with at most ``limit`` distinct values in their scope have ratios. A value that the
    scope has but the group has not is 0; a group without any value has no rows.
    """
    return proportions(values.where("value is not null").groupBy(*KEY, *scope, "column", "value").agg(F.count("*").alias("n")), scope, limit)


def window_proportions(counts: DataFrame, limit: int = RATIO_LIMIT) -> DataFrame:
    """``value_proportions`` of each window, from ``value_counts``."""
    each = F.array(*[F.struct(F.lit(w).alias("window"), F.col(w).alias("n")) for w in WINDOWS])
    part = counts.where("value is not null").select(*KEY, "column", "value", F.explode(each).alias("_w")).select(*KEY, "_w.*", "column", "value")
    return proportions(part.where("n > 0"), ["window"], limit)


def proportions(counts: DataFrame, scope: list[str], limit: int = RATIO_LIMIT) -> DataFrame:
    """``value_proportions`` from (key, scope, column, value, n), each value of a group once."""
    frame = [*scope, "column"]
    # all of a scope's values in at most limit + 1 places a partition: small after one shuffle of (scope, value)
    observed = counts.select(*frame, "value").distinct()
    gate = observed.groupBy(*frame).agg(F.count("*").alias("_kinds")).where(F.col("_kinds") <= limit).drop("_kinds")
    observed = observed.join(gate, frame, "left_semi")
    totals = counts.groupBy(*KEY, *frame).agg(F.sum("n").alias("_all"))
    filled = totals.join(observed, frame).join(counts, [*KEY, *frame, "value"], "left")
    return filled.select(*KEY, *frame, "value", (F.coalesce("n", F.lit(0)) / F.col("_all")).alias("ratio"))


def interactions(windowed: DataFrame, suffix: str = "suffix", value: str = "value") -> DataFrame:
    """(key, suffix, left, right, diff, ratio, abs_diff) of each window pair whose both windows have the suffix in the data.

    ``windowed`` has key, window, suffix and value. The pairs are six rows, so each value is met at most twice on each side.
    """
    names = sorted({w for pair in PAIRS for w in pair})
    here = lambda w: F.col("window") == w
    # a key's windows are one row, of which the pairs are made
    wide = windowed.where(F.col("window").isin(names)).groupBy(*KEY, suffix).agg(
        *[F.max(F.when(here(w), F.col(value))).alias(f"_v_{w}") for w in names], F.bit_or(F.when(F.col("window").isin(names), F.element_at(F.create_map(*[F.lit(x) for i, w in enumerate(names) for x in (w, 1 << i)]), F.col("window")))).alias("_seen")
    )
    bit = {w: 1 << i for i, w in enumerate(names)}
    has = lambda w: F.col("_seen").bitwiseAND(F.lit(bit[w])) != 0
    each = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_v_{a}").alias("l"), F.col(f"_v_{b}").alias("r"), (has(a) | has(b)).alias("any")) for a, b in PAIRS])
    known = windowed.where(F.col("window").isin(names)).groupBy(suffix).agg(F.collect_set("window").alias("_known"))  # eight names a suffix
    wide = wide.select(*KEY, suffix, F.explode(each).alias("_p")).where("_p.any").select(*KEY, suffix, "_p.left", "_p.right", F.col("_p.l").alias("_l"), F.col("_p.r").alias("_r"))
    wide = wide.join(F.broadcast(known), suffix).where(F.array_contains("_known", F.col("left")) & F.array_contains("_known", F.col("right")))
    diff = F.col("_r") - F.col("_l")
    return wide.select(*KEY, suffix, "left", "right", diff.alias("diff"), (F.col("_r") / (F.abs("_l") + EPSILON)).alias("ratio"), F.abs(diff).alias("abs_diff"))


def _named(df: DataFrame, name: Column, stats: tuple[str, ...]) -> DataFrame:
    """Statistics columns unpivoted into (key, feature, value); ``name`` has a %s for the statistic."""
    each = F.array(*[F.struct(F.replace(name, F.lit("%s"), F.lit(s)).alias("feature"), F.col(s).alias("value")) for s in stats])
    return df.select(*KEY, F.explode(each).alias("_f")).select(*KEY, "_f.*")


def numeric_columns(df: DataFrame) -> list[str]:
    skip = {*KEY, "timestamp", "_hour", "_period"}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in skip]


def table_features(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """All features of one table, long: (subject_id, lifelog_date, feature, value)."""
    columns = numeric_columns(df) if columns is None else columns
    integral = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    values = materialised(value_counts(df, columns))
    windowed = materialised(stats_of_counts(values))
    out = _named(windowed.where(F.col("window") == WHOLE_DAY), F.concat_ws("_", F.lit(table), F.col("column"), F.lit("%s")), DAILY)
    suffixed = _suffixed(windowed)
    out = out.unionByName(suffixed.select(*KEY, F.concat_ws("_", F.lit(table), "window", "suffix").alias("feature"), "value"))
    out = out.unionByName(_named(period_stats(df, columns), F.concat_ws("_", F.lit(table), F.col("column"), F.lit("%s"), F.col("period")), PERIODIC))
    counts = row_counts(df)
    out = out.unionByName(counts.select(*KEY, F.concat_ws("_", F.lit(table), F.when(F.col("scope") == "window", F.col("name")), F.lit("row_count"), F.when(F.col("scope") == "period", F.col("name"))).alias("feature"), F.col("n").cast("double").alias("value")))
    inter = interactions(suffixed.unionByName(counts.where("scope = 'window'").select(*KEY, F.col("name").alias("window"), F.lit("row_count").alias("suffix"), F.col("n").cast("double").alias("value"))))
    out = out.unionByName(_named(inter, F.concat(F.lit(table), F.lit("_"), F.col("left"), F.lit("_to_"), F.col("right"), F.lit("_"), F.col("suffix"), F.lit("_%s")), ("diff", "ratio", "abs_diff")))
    whole = proportions(values.where("value is not null").withColumn("n", F.col(WHOLE_DAY)), [])
    part = window_proportions(values)
    shown = F.when(F.col("column").isin([*integral, "-"]), value_name(F.col("value"), True)).otherwise(value_name(F.col("value"), False))
    out = out.unionByName(whole.select(*KEY, F.concat_ws("_", F.lit(table), "column", F.lit("ratio"), shown).alias("feature"), F.col("ratio").alias("value")))
    out = out.unionByName(part.select(*KEY, F.concat_ws("_", F.lit(table), "window", "column", F.lit("ratio"), shown).alias("feature"), F.col("ratio").alias("value")))
    return out


def _suffixed(windowed: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.concat_ws("_", "column", F.lit(s)).alias("suffix"), F.col(s).alias("value")) for s in WINDOWED])
    return windowed.select(*KEY, "window", F.explode(each).alias("_s")).select(*KEY, "window", "_s.*")
