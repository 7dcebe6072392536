"""Parsers of nested payloads as higher-order expressions: one struct per cell, no Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import AMBIENCE, APPS, EPSILON, OTHER_APP, STRONG_SIGNAL
from .scalars import finite

LIST_STATS = ("len", "mean", "std", "min", "max", "median", "p10", "p90", "range", "spike", "recovery")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it: it is the only element of an array, and
    the body a lambda over that, so that no rule of the optimizer writes it out again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbers(cell: Column) -> Column:
    """The finite values of an array of numbers, as doubles; null for null."""
    return F.filter(F.transform(cell, lambda x: finite(x)), lambda x: x.isNotNull())


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, _total(values) / F.size(values))


def deviation_of(values: Column) -> Column:
    """Population standard deviation, from squares around the mean."""
    spread = lambda m: F.sqrt(_total(F.transform(values, lambda x: (x - m) * (x - m))) / F.size(values))
    return bound(mean_of(values), lambda m: F.when(F.size(values) > 0, spread(m)))


def quantile_of(ordered: Column, q: float) -> Column:
    """Linear interpolation between neighbours of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    a = F.get(ordered, low)
    b = F.coalesce(F.get(ordered, low + 1), a)
    return F.when(F.size(ordered) > 0, a + (b - a) * (at - low))


def list_stats(cell: Column) -> Column:
    """Eleven statistics of an array of numbers; of an empty or null one the length 0 alone."""

    def of_sorted(v: Column) -> Column:
        return bound(
            F.struct(F.get(v, F.lit(0)).alias("low"), F.get(v, F.size(v) - 1).alias("high"), *[quantile_of(v, q).alias(n) for n, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))]),
            lambda q: F.struct(
                F.size(v).cast("double").alias("len"), mean_of(v).alias("mean"), deviation_of(v).alias("std"), q["low"].alias("min"), q["high"].alias("max"), q["median"].alias("median"),
                q["p10"].alias("p10"), q["p90"].alias("p90"), (q["high"] - q["low"]).alias("range"), (q["p90"] - q["median"]).alias("spike"), (q["median"] - q["low"]).alias("recovery"),
            ),
        )

    return bound(F.array_sort(F.coalesce(numbers(cell), F.array().cast("array<double>"))), of_sorted)


def ambience(cell: Column) -> Column:
    """Twenty features of an array of [label, score] pairs.

    A group is hit where one of its keywords is part of the lower-case label. Pairs without a numeric
    score count for nothing. The top group is the last hit among the labels of largest score.
    """
    pairs = F.filter(F.coalesce(cell, F.expr("cast(array() as array<array<string>>)")), lambda p: (F.size(p) >= 2) & F.get(p, 1).try_cast("double").isNotNull())
    scored = F.transform(pairs, lambda p: bound(F.lower(F.get(p, 0)), lambda label: F.struct(F.get(p, 1).try_cast("double").alias("score"), *[_has(label, AMBIENCE[g]).alias(g) for g in AMBIENCE])))
    largest = lambda v: F.greatest(F.lit(0.0), F.coalesce(F.array_max(v), F.lit(0.0)))

    def of_scored(s: Column) -> Column:
        top = largest(F.transform(s, lambda x: x["score"]))
        hits = bound(top, lambda t: F.flatten(F.transform(F.filter(s, lambda x: x["score"] >= t), lambda x: F.array_compact(F.array(*[F.when(x[g], g) for g in AMBIENCE])))))
        best = bound(hits, lambda h: F.coalesce(F.get(h, F.size(h) - 1), F.lit("unknown")))
        fields = []
        for g in AMBIENCE:
            of = F.transform(F.filter(s, lambda x: x[g]), lambda x: x["score"])  # noqa: B023
            fields.append(bound(of, lambda v: F.struct(_total(v).alias("sum"), largest(v).alias("max"))).alias(g))
        made = F.struct(*fields, top.alias("top"), best.alias("best"))
        return bound(
            made,
            lambda m: F.struct(
                *[f for g in AMBIENCE for f in (m[g]["sum"].alias(f"{g}_score"), m[g]["max"].alias(f"{g}_max"))],
                F.size(s).cast("double").alias("label_count"), m["top"].alias("top_score"), *[(m["best"] == g).cast("double").alias(f"top_is_{g}") for g in AMBIENCE],
            ),
        )

    return bound(scored, of_scored)


def _has(text: Column, keywords) -> Column:
    out = F.lit(False)
    for word in keywords:
        out |= F.contains(text, F.lit(word))
    return out


def app_category(name: Column) -> Column:
    """The first category one of whose keywords is in the lower-cased, trimmed name with a space before it."""

    def first(hay: Column) -> Column:
        out = None
        for category, keywords in APPS.items():
            hit = _has(hay, keywords)
            out = F.when(hit, category) if out is None else out.when(hit, category)
        return out.otherwise(OTHER_APP)

    return bound(F.concat(F.lit(" "), F.lower(F.trim(name))), first)


def usage(cell: Column) -> Column:
    """Twenty-three features of an array of (app_name, total_time): times and counts by category, totals, share of the top app."""
    apps = F.transform(cell, lambda a: F.struct(app_category(F.coalesce(a["app_name"].cast("string"), F.lit(""))).alias("category"), F.coalesce(finite(a["total_time"].try_cast("double")), F.lit(0.0)).alias("time")))
    apps = F.coalesce(apps, F.expr("cast(array() as array<struct<category:string,time:double>>)"))

    def of_apps(apps: Column) -> Column:
        fields = []
        for c in [*APPS, OTHER_APP]:
            mine = F.filter(apps, lambda a: a["category"] == c)  # noqa: B023
            fields.append(bound(mine, lambda m: F.struct(_total(F.transform(m, lambda a: a["time"])).alias("time"), F.size(m).cast("double").alias("n"))).alias(c))
        times = F.transform(apps, lambda a: a["time"])
        made = F.struct(*fields, _total(times).alias("total"), F.coalesce(F.array_max(times), F.lit(0.0)).alias("top"))
        return bound(
            made,
            lambda m: F.struct(
                *[f for c in [*APPS, OTHER_APP] for f in (m[c]["time"].alias(f"{c}_time"), m[c]["n"].alias(f"{c}_app_count"))],
                m["total"].alias("total_time"), F.size(apps).cast("double").alias("app_count"), (m["top"] / (m["total"] + EPSILON)).alias("top_app_time_ratio"),
            ),
        )

    return bound(apps, of_apps)


GPS_FIELDS = ("latitude", "longitude", "altitude", "speed")


def gps(cell: Column) -> Column:
    """Point count, and mean, population deviation, smallest, largest and range of the four fields."""
    fields = [F.coalesce(F.size(cell), F.lit(0)).cast("double").alias("point_count")]

    def values_of(name: str) -> Column:
        return F.coalesce(F.filter(F.transform(cell, lambda p: finite(p[name].try_cast("double"))), lambda x: x.isNotNull()), F.array().cast("array<double>"))

    def five(v: Column) -> Column:
        return F.struct(mean_of(v).alias("mean"), deviation_of(v).alias("std"), F.array_min(v).alias("min"), F.array_max(v).alias("max"), (F.array_max(v) - F.array_min(v)).alias("range"))

    made = F.struct(*[bound(values_of(name), five).alias(name) for name in GPS_FIELDS])
    return bound(made, lambda m: F.struct(*fields, *[m[name][x].alias(f"{name}_{x}") for name in GPS_FIELDS for x in ("mean", "std", "min", "max", "range")]))


def scan_ids(cell: Column, id_field: str) -> Column:
    """The distinct ids of a scan."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(cell, F.slice(cell, 1, 0)), lambda x: x[id_field].cast("string")), lambda x: x.isNotNull()))


def network(cell: Column, id_field: str, familiar: Column) -> Column:
    """Eight features of a scan, given familiar ids (all of the subject, or those of the scan); an empty scan is wholly novel."""
    items = F.coalesce(cell, F.slice(cell, 1, 0))
    ids = scan_ids(cell, id_field)
    rssi = F.coalesce(F.filter(F.transform(items, lambda x: finite(x["rssi"].try_cast("double"))), lambda x: x.isNotNull()), F.array().cast("array<double>"))
    count = lambda v: F.greatest(F.coalesce(F.size(v), F.lit(0)), F.lit(0)).cast("double")

    def of_both(m: Column) -> Column:
        known = F.filter(m["ids"], lambda x: F.array_contains(F.coalesce(familiar, F.array().cast("array<string>")), x))
        ratio = count(known) / (count(m["ids"]) + EPSILON)
        return F.struct(
            count(items).alias("detected_count"), count(m["ids"]).alias("unique_count"), ratio.alias("familiar_ratio"), (1 - ratio).alias("novel_ratio"),
            mean_of(m["rssi"]).alias("rssi_mean"), F.array_max(m["rssi"]).alias("rssi_max"), deviation_of(m["rssi"]).alias("rssi_std"), F.size(F.filter(m["rssi"], lambda x: x >= STRONG_SIGNAL)).cast("double").alias("strong_count"),
        )

    return bound(F.struct(ids.alias("ids"), rssi.alias("rssi")), of_both)


def heart_rate(cell: Column, encoded: bool = False) -> Column:
    """Mean of the positive values of an array, or of one written as text; null without any."""
    values = F.from_json(cell, "array<double>") if encoded else cell
    return mean_of(F.coalesce(F.filter(numbers(values), lambda x: x > 0), F.array().cast("array<double>")))
