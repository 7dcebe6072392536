"""Ordered scans of groups that needn't fit a task: blocks of a group in order, and what is carried from block to block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import materialised

BLOCK = "_block"


def blocked(rows: DataFrame, own: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """The rows with the number of their block: runs of (own, order) of about equal size, in that order.

    A group is cut wherever its rows are many; its blocks are at most as many as partitions. Rows are written, which fixes the cuts.
    """
    dealt = rows.repartitionByRange(partitions, *own, *order) if partitions else rows.repartitionByRange(*own, *order)
    return materialised(dealt.withColumn(BLOCK, F.spark_partition_id()))


def with_previous(rows: DataFrame, own: list[str], order: list[str], keep: list[str], n: int) -> DataFrame:
    """Blocked rows (``_ago`` 0) and, for each block, the last ``n`` rows before it (``_ago`` from -n to -1, with ``keep`` alone)."""
    last = Window.partitionBy(*own, BLOCK).orderBy(*[F.col(c).desc() for c in order])
    tails = rows.select(*own, BLOCK, *order, *keep).withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= n)
    tails = tails.groupBy(*own, BLOCK).agg(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("_k"), *keep))).alias("_tail"))
    # every block has a row at least, so n blocks before have n rows
    before = F.flatten(F.collect_list("_tail").over(Window.partitionBy(*own).orderBy(BLOCK).rowsBetween(-n, -1)))
    tails = tails.select(*own, BLOCK, before.alias("_all")).select(*own, BLOCK, F.slice("_all", F.greatest(F.size("_all") - n, F.lit(0)) + 1, n).alias("_some"))
    each = tails.select(*own, BLOCK, F.size("_some").alias("_n"), F.posexplode("_some").alias("_p", "_r"))
    ghosts = each.select(*own, BLOCK, (F.col("_p") - F.col("_n")).alias("_ago"), *[F.col(f"_r.{c}").alias(c) for c in keep])
    return rows.withColumn("_ago", F.lit(0)).unionByName(ghosts, allowMissingColumns=True)


def places(rows: DataFrame, own: list[str], order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Add the place of each row in its group's order, from 0: the rows of the blocks before, and the place in its own."""
    rows = blocked(rows, own, order, partitions)
    sizes = rows.groupBy(*own, BLOCK).agg(F.count("*").alias("_rows"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.partitionBy(*own).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in (*own, BLOCK)]
    joined = rows.alias("_l").join(sizes.alias("_r"), same).select("_l.*", "_before")
    local = F.row_number().over(Window.partitionBy(*own, BLOCK).orderBy(*order)) - 1
    return joined.withColumn(name, (local + F.col("_before")).cast("int")).drop("_before", BLOCK)
