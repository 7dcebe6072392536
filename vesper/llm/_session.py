"""Session helpers: the shared checkpoint folder, tables that operators write for themselves, and reading of input tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cluster import set_checkpoint_dir, ship_code


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``."""
    return set_checkpoint_dir(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read back from the shared folder: lineage is cut and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: The tables of the innermost scope; None outside of any.
_scope: ContextVar[set | None] = ContextVar("own tables", default=None)


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The same rows as a Parquet table of the shared folder, so that later scans prune columns.

    Unless it is to be kept, it goes with ``drop``, with ``release`` of its scope, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not keep:
        target, files = _path(spark, path)
        files.deleteOnExit(target)
        if (own := _scope.get()) is not None:
            own.add(path)
        out._own_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing unfinished reads any more."""
    for df in tables:
        if path := getattr(df, "_own_path", None):
            target, files = _path(df.sparkSession, path)
            files.delete(target, True)
            if (own := _scope.get()) is not None:
                own.discard(path)


@contextmanager
def scope() -> Iterator[set]:
    """Collects the tables that operators called within write for themselves, and no others; give the set to ``release``
    once what was made of them is written."""
    own: set[str] = set()
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)


def release(spark: SparkSession, own: set) -> None:
    """Delete a scope's tables; shuffle files of finished jobs go as well, which else stay until the driver's garbage is collected."""
    for path in own:
        target, files = _path(spark, path)
        files.delete(target, True)
    own.clear()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows and bytes of an Arrow batch where the session leaves Spark's defaults: whole texts, some very long, go to Python.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Get a session ready: the package's code on the executors, and Arrow batches small enough for whole texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB") == str(64 << 20):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_code(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
