"""From sensor logs to long features, and from those to model rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.arrays import ambience, list_stats, usage
from ..functions.constants import TARGETS
from ..functions.scalars import finite
from ..operators.calendar import calendar_features, imputed
from ..operators.cross_features import cross_features
from ..operators.history import COLUMNS, label_history, long_labels, template_history
from ..operators.places import ble_features, gps_features, wifi_features
from ..operators.stats import KEY, keyed, table_features
from ..sources.cluster import ship_code
from ..sources.sinks import materialised


def _spread(df: DataFrame, cell: str, parsed, prefix: str) -> DataFrame:
    out = df.withColumn("_s", parsed)
    return out.select(*[c for c in df.columns if c != cell], *[F.col(f"_s.{n}").alias(f"{prefix}_{n}") for n in out.schema["_s"].dataType.names])


def parsed(df: DataFrame, table: str) -> DataFrame:
    """The table with its nested payload replaced by numeric columns; lists of numbers become their statistics."""
    payload = {"mAmbience": "m_ambience", "mUsageStats": "m_usage_stats"}.get(table)
    if table == "mAmbience":
        df = _spread(df, payload, ambience(F.col(payload)), "ambience")
    elif table == "mUsageStats":
        df = _spread(df, payload, usage(F.col(payload)), "usage")
    elif table == "mGps":
        df = gps_features(df)
    elif table == "mWifi":
        df = wifi_features(df)
    elif table == "mBle":
        df = ble_features(df)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.NumericType, T.StringType)):
            numbers = F.transform(f.name, lambda x: x.try_cast("double"))
            df = _spread(df, f.name, list_stats(numbers), f.name)
    return df


def sensor_features(sensors: dict[str, DataFrame]) -> DataFrame:
    """(subject_id, lifelog_date, feature, value) over all tables, with the features across them.

    A table's parsed rows and its features are made once and read again: a dozen tables would otherwise be one plan.
    """
    out = None
    for table, df in sorted(sensors.items()):
        one = materialised(table_features(materialised(keyed(parsed(df, table))), table))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(cross_features(out))


def label_rows(train: DataFrame, template: DataFrame) -> DataFrame:
    """Both tables as one: row_id unique over both, is_train, keys and targets (null for the template)."""
    one = train.withColumn("is_train", F.lit(True))
    last = F.lit(train.agg(F.max("row_id")).first()[0] or 0) + 1
    two = template.withColumn("is_train", F.lit(False)).withColumn("row_id", F.col("row_id") + last)
    for t in TARGETS:
        two = two.withColumn(t, F.lit(None).cast("int"))
    return one.unionByName(two)


def _given(rows: DataFrame, sensor: DataFrame | None) -> DataFrame:
    """(row_id, is_train, feature, value): the sensor, calendar and history features that rows have."""
    dated = calendar_features(rows)
    names = ["dayofweek", "month", "day", "sleep_gap_days", "days_since_start"]
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    out = dated.select("row_id", "is_train", F.explode(each).alias("_f")).select("row_id", "is_train", "_f.*")
    y = long_labels(rows.where("is_train"), TARGETS)
    past = label_history(y).select("row_id", "target", *COLUMNS).withColumn("is_train", F.lit(True))
    ahead = template_history(y, rows.where("not is_train")).select("row_id", "target", *COLUMNS).withColumn("is_train", F.lit(False))
    each = F.array(*[F.struct(F.concat(F.lower("target"), F.lit(f"_history_{c}")).alias("feature"), F.col(c).cast("double").alias("value")) for c in COLUMNS])
    out = out.unionByName(past.unionByName(ahead).select("row_id", "is_train", F.explode(each).alias("_f")).select("row_id", "is_train", "_f.*"))
    if sensor is not None:
        out = out.unionByName(rows.select("row_id", "is_train", *KEY).join(sensor, list(KEY)).select("row_id", "is_train", "feature", "value"))
    return out


def model_features(train: DataFrame, template: DataFrame, sensor: DataFrame | None) -> DataFrame:
    """(row_id, is_train, feature, value): sensor, calendar and history features, imputed from train, and the subject's one-hot.

    Only features that some train row has are kept. A row for each row and feature: for small tables and to look at; ``model_matrix``
    has the same values as arrays.
    """
    rows = label_rows(train, template)
    out = _given(rows, sensor)
    known = out.where("is_train").select("feature").distinct()
    every = rows.select("row_id", "is_train").join(known).join(out, ["row_id", "is_train", "feature"], "left")  # the dense model matrix, by definition
    filled = imputed(every, out.where("is_train"))
    hot = rows.select("row_id", "is_train", F.concat(F.lit("subject_"), "subject_id").alias("_own")).join(rows.select(F.concat(F.lit("subject_"), "subject_id").alias("feature")).distinct())
    hot = hot.select("row_id", "is_train", "feature", (F.col("feature") == F.col("_own")).cast("double").alias("value"))
    return filled.select("row_id", "is_train", "feature", "value").unionByName(hot)


def model_rows(features: DataFrame) -> DataFrame:
    """(row_id, is_train, x): values as arrays in the order of feature names."""
    pairs = F.array_sort(F.collect_list(F.struct("feature", "value")))
    return features.groupBy("row_id", "is_train").agg(F.transform(pairs, lambda p: p["value"]).alias("x"))


def model_matrix(train: DataFrame, template: DataFrame, sensor: DataFrame | None) -> DataFrame:
    """(row_id, is_train, x): ``model_rows`` of ``model_features`` from sparse rows.

    Features get numbers in the order of their names. A row goes to one place with the numbers and values that it has, its
    subject's among them; training medians, and zeros for other subjects, are what all other places hold and are no rows at all.
    """
    ship_code(train.sparkSession)
    rows = materialised(label_rows(train, template))
    given = materialised(_given(rows, sensor))
    own = F.concat(F.lit("subject_"), F.col("subject_id")).alias("feature")
    median = given.where("is_train").groupBy("feature").agg(F.coalesce(finite(F.median(F.nanvl(F.col("value"), F.lit(None)))), F.lit(0.0)).alias("base"))
    numbers = median.unionByName(rows.select(own).where("feature is not null").distinct().withColumn("base", F.lit(0.0)))
    numbers = materialised(numbers.withColumn("at", F.row_number().over(Window.orderBy("feature")) - 1))  # a row for each feature
    base = np.array([r["base"] for r in numbers.select("at", "base").orderBy("at").collect()])
    cells = given.select("row_id", "feature", finite(F.col("value")).alias("value")).unionByName(rows.select("row_id", own, F.lit(1.0).alias("value")))
    cells = cells.where("value is not null").join(numbers.select("feature", "at"), "feature").groupBy("row_id").agg(F.collect_list(F.struct("at", "value")).alias("cells"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 64) for b in batches for at in range(0, len(b), 64)):
            x = np.tile(base, (len(batch), 1))
            lists = batch["cells"].fill_null([])
            at, value = lists.flatten().flatten()
            x[np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy()), at.to_numpy()] = value.to_numpy()
            places = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(base))
            yield pa.record_batch([batch["row_id"], batch["is_train"], pa.ListArray.from_arrays(places, pa.array(x.ravel()))], names=["row_id", "is_train", "x"])

    every = rows.select("row_id", "is_train").join(cells, "row_id", "left")
    return every.mapInArrow(dense, f"row_id {dict(rows.dtypes)['row_id']}, is_train boolean, x array<double>")
