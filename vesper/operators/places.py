"""Per-subject references of the whole data: home places and familiar ids, and the features that need them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import gps, network, scan_ids
from ..functions.constants import BLE_FAMILIAR, WIFI_FAMILIAR
from ..sources.sinks import materialised


def home_places(df: DataFrame, subject: str, hour: str, x: str, y: str) -> DataFrame:
    """(subject, home_x, home_y): medians over the rows of hours 0 to 5 of the whole data."""
    night = df.where(F.col(hour).between(0, 5))
    return night.groupBy(subject).agg(F.median(x).alias("home_x"), F.median(y).alias("home_y"))


def gps_features(df: DataFrame, cell: str = "m_gps") -> DataFrame:
    """The table with GPS features in place of the cell: points, distance from home (in degrees) and radius."""
    out = df.withColumn("_g", gps(F.col(cell))).select(*[c for c in df.columns if c != cell], "_g.*").withColumn("_h", F.hour("timestamp"))
    homes = home_places(out, "subject_id", "_h", "latitude_mean", "longitude_mean")
    # one row per subject; joined by key, so that many subjects shuffle and few are broadcast by their size
    out = out.join(homes, "subject_id", "left")
    far = F.sqrt(F.pow(F.col("latitude_mean") - F.col("home_x"), 2) + F.pow(F.col("longitude_mean") - F.col("home_y"), 2))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    radius = F.sqrt(F.pow(zero("latitude_range"), 2) + F.pow(zero("longitude_range"), 2))
    names = [c for c in out.columns if c not in ("_h", "home_x", "home_y")]
    kept = [F.col(c).alias(f"gps_{c}") if c not in df.columns else F.col(c) for c in names]
    return out.select(*kept, far.alias("gps_home_distance"), radius.alias("gps_mobility_radius"))


def frequent_ids(df: DataFrame, subject: str, cell: str, id_field: str | None, least: int) -> DataFrame:
    """(subject, id, n): ids that occur ``least`` times or more, each occurrence counted, over the whole data."""
    each = df.select(F.col(subject).alias("subject_id"), F.explode(cell).alias("_i"))
    ids = F.col("_i")[id_field] if id_field else F.col("_i")
    return each.select("subject_id", ids.cast("string").alias("id")).where("id is not null").groupBy("subject_id", "id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def network_features(df: DataFrame, cell: str, id_field: str, prefix: str, least: int) -> DataFrame:
    """The table with eight scan features in place of the cell.

    A scan's ids are met with the subject's familiar ids in a join by (subject, id), and those that it has itself come back to the
    row; no row carries all familiar ids of its subject. Both sides are written first, so that a join can be split where a subject
    sees one id in most of its scans.
    """
    rows = materialised(df.withColumn("_row", F.monotonically_increasing_id()))
    known = materialised(frequent_ids(rows, "subject_id", cell, id_field, least).select("subject_id", "id"))
    seen = rows.select("_row", F.col("subject_id").cast("string").alias("subject_id"), F.explode(scan_ids(F.col(cell), id_field)).alias("id"))
    met = seen.join(known, ["subject_id", "id"]).groupBy("_row").agg(F.collect_list("id").alias("_known"))
    out = rows.join(met, "_row", "left").withColumn("_n", network(F.col(cell), id_field, F.col("_known")))
    fields = out.schema["_n"].dataType.names
    return out.select(*[c for c in df.columns if c != cell], *[F.col(f"_n.{f}").alias(f"{prefix}_{f}") for f in fields])


def wifi_features(df: DataFrame) -> DataFrame:
    return network_features(df, "m_wifi", "bssid", "wifi", WIFI_FAMILIAR)


def ble_features(df: DataFrame) -> DataFrame:
    return network_features(df, "m_ble", "address", "ble", BLE_FAMILIAR)
