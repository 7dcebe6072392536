"""Scalar expressions over columns: periods, dates, shrinkage, blends, clips and names."""

from __future__ import annotations

import importlib.util
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import PERIODS, PROBABILITY_CLIP, WINDOWS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every double and float column, as missing means one thing from here on."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields])


def finite(x: Column) -> Column:
    """The value where it is a finite number, else null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def time_period(ts: Column | str) -> Column:
    hour = F.hour(_c(ts))
    out = None
    for name, hours in PERIODS.items():
        hit = hour <= hours[-1]
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def windows_of_hour(hour: Column) -> Column:
    """The names of all windows that hold the hour; null for a null hour."""
    by_hour = [F.array(*[F.lit(name) for name, hours in WINDOWS.items() if h in hours]) for h in range(24)]
    return F.element_at(F.array(*by_hour), hour + 1)


def calendar_date(ts: Column | str) -> Column:
    return F.to_date(_c(ts))


def shifted_date(ts: Column | str, hours: int = 6) -> Column:
    """The date of the day that begins ``hours`` after midnight."""
    return F.to_date(_c(ts) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def weekday(date: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_c(date))


def feature_name(*parts: str) -> str:
    return "_".join(p for p in parts if p)


def optional(df: DataFrame, name: str) -> Column:
    """The column as double: 0 where there is no such column, null where the column has no value."""
    return F.col(name).cast("double") if name in df.columns else F.lit(0.0)


def shrink(p: Column | str, prior: Column | str, alpha: Column | float) -> Column:
    return _c(prior) + alpha * (_c(p) - _c(prior))


def blend(p: Column | str, q: Column | str, alpha: Column | float) -> Column:
    return alpha * _c(p) + (1 - alpha) * _c(q)


def history_probability(last_7: Column, last_3: Column, dow: Column, prior: Column) -> Column:
    known = lambda x: F.coalesce(_c(x), _c(prior))
    return 0.4 * known(last_7) + 0.3 * known(last_3) + 0.2 * known(dow) + 0.1 * _c(prior)


def clipped(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def clipped_probability(p: Column | str, by: float = PROBABILITY_CLIP) -> Column:
    return clipped(p, by, 1 - by)


def label_at(p: Column | str, threshold: Column | float) -> Column:
    return (_c(p) >= threshold).cast("int")


def aggressive(threshold: Column | str) -> Column:
    """A threshold lowered by a tenth, but not under 0.05."""
    return F.greatest(F.lit(0.05), _c(threshold) - 0.1)


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def file_safe(name: Column | str) -> Column:
    """Runs of anything but letters, digits and underscores become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(name), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")


def file_safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_")


def strategy_model(name: Column | str) -> Column:
    """The model that a strategy's name tells of; an unknown name is an error."""
    s = _c(name)
    known = F.when(s == "rule_subject_strategy_tuned", "rule").when(s == "history_blend", "history")
    known = known.when(s.startswith("model_"), F.substring(s, 7, 1 << 20)).when(s.startswith("meta_rule_"), F.substring(s, 11, 1 << 20))
    known = known.when(s.startswith("blend_"), F.regexp_extract(F.substring(s, 7, 1 << 20), r"^(.*?)(?:_rule_(?!.*_rule_).*)?$", 1))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown strategy: "), s)).cast("string"))


def available(*modules: str) -> dict[str, bool]:
    """Which optional libraries can be imported."""
    return {m: importlib.util.find_spec(m) is not None for m in modules}
