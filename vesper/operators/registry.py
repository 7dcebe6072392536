"""Fits of the named models for many label sets at once."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import materialised
from .folded import kernel_machines, linear_machines, networks, regressions
from .models import ENSEMBLES
from .trees import Ensemble, Fit, grow


#: Models that are fitted for all label sets of the same features at once.
SHARED = {"logistic_regression": regressions, "linear_svc": linear_machines, "svc_rbf": kernel_machines, "mlp": networks}


def fit_all(rows: DataFrame, roles: int, asked: list[tuple[int, str, tuple[int, ...] | None]], seed: int = 2026, ensembles: dict[str, Ensemble] = ENSEMBLES) -> DataFrame:
    """(row_id, fit, p) of asked rows: ``asked`` has (label set, model, features or None for all), ``fit`` is a place in it.

    ``rows`` has row_id, x and roles (see ``trees``). All tree ensembles grow in the same passes over one binned table, and all other models of
    the same kind and features in theirs, so the number of jobs follows the kinds of models and their steps, not the label sets. A model that
    isn't known is left out with a warning; label sets without training rows give nothing.
    """
    rows, parts = materialised(rows.select("row_id", "x", "roles")), []
    trees = [i for i, (_, model, _) in enumerate(asked) if model in ensembles]
    if trees:
        fits = [Fit(asked[i][0], ensembles[asked[i][1]], asked[i][2], seed) for i in trees]
        parts.append(_named(grow(rows, fits, roles)[0], dict(enumerate(trees))))
    shared: dict[tuple, dict[int, int]] = {}
    for i, (role, model, columns) in enumerate(asked):
        if model in SHARED:
            shared.setdefault((model, columns), {})[role] = i
        elif model not in ensembles:
            warnings.warn(f"skipped {model}: no such model; known are {', '.join([*SHARED, *ensembles])}", stacklevel=2)
    parts += [_named(SHARED[model](rows.withColumn("x", _some(columns))), of) for (model, columns), of in shared.items()]
    out = rows.select("row_id", F.lit(0).alias("fit"), F.lit(0.0).alias("p")).where("false")
    for part in parts:
        out = out.unionByName(part)
    return materialised(out.where("p is not null"))


def _some(columns: tuple[int, ...] | None):
    if columns is None:
        return F.col("x")
    if columns == tuple(range(len(columns))):
        return F.slice("x", 1, len(columns))
    return F.transform(F.lit(list(columns)), lambda i: F.get("x", i))


def _named(p: DataFrame, names: dict[int, int]) -> DataFrame:
    """Fits under other numbers; those without one go."""
    known = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return p.select("row_id", F.element_at(known, F.col("fit")).alias("fit"), "p").where("fit is not null")
