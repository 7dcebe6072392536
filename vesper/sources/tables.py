"""Scans: tables by stem, named tables, label files and sensor logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import SENSORS, TARGETS
from ..functions.scalars import missing_as_null

LABELS = T.StructType(
    [T.StructField("subject_id", T.StringType()), T.StructField("sleep_date", T.DateType()), T.StructField("lifelog_date", T.DateType()), *[T.StructField(t, T.IntegerType()) for t in TARGETS]]
)
PREFIX = "ch2025_"


def _paths(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files of a folder by Hadoop's file system, so that any store that Spark reads is listed alike; sorted."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(x.getPath()) for x in found or [])


def load_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """The Parquet table of that stem, else the CSV file with a header, else FileNotFoundError."""
    if _paths(spark, folder, f"{name}.parquet"):
        return missing_as_null(spark.read.parquet(f"{folder}/{name}.parquet"))
    if _paths(spark, folder, f"{name}.csv"):
        return spark.read.csv(f"{folder}/{name}.csv", header=True, inferSchema=True)
    raise FileNotFoundError(f"no {name}.parquet or {name}.csv in {folder}")


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a folder by stem, in order; CSV files only where there is no Parquet at all."""
    paths = _paths(spark, folder, "*.parquet") or _paths(spark, folder, "*.csv")
    stems = sorted(p.rstrip("/").rpartition("/")[2].rpartition(".")[0] for p in paths)
    return {stem: load_table(spark, stem, folder) for stem in stems}


def shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


def register(spark: SparkSession, folder: str) -> list[str]:
    """Temporary views of the known sensor tables that the folder has; their names."""
    done = []
    for name in SENSORS:
        if _paths(spark, folder, f"{PREFIX}{name}.parquet"):
            load_table(spark, PREFIX + name, folder).createOrReplaceTempView(name)
            done.append(name)
    return done


def labels(spark: SparkSession, path: str) -> DataFrame:
    """A label file, with ``row_id`` for its order: the number of the row by position in the file."""
    df = spark.read.schema(LABELS).csv(path, header=True)
    return df.withColumn("_at", F.monotonically_increasing_id()).selectExpr("*", "row_number() OVER (ORDER BY _at) - 1 AS row_id").drop("_at")


def sensors(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Sensor logs by short name, the timestamp without a zone; missing ones are left out."""
    out = {}
    for path in _paths(spark, folder, "*.parquet"):
        stem = path.rstrip("/").rpartition("/")[2].removesuffix(".parquet").removeprefix(PREFIX)
        if names is None or stem in names:
            df = missing_as_null(spark.read.parquet(path))
            out[stem] = df.withColumn("subject_id", F.col("subject_id").cast("string")).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return out
