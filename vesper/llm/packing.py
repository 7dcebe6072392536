"""Best-fit packing of tokenised documents into sequences of a fixed capacity, bulk-synchronously.

Documents are tokenised, ended with the end id, and only longer ones are cut, into full pieces after a
shorter first one. Then supersteps repeat until every piece has its place:

1. Range sort: pieces and gaps (what is left of open sequences) are range-partitioned and sorted together by size,
   largest first, a gap before a piece of the same size.
2. Successor sweep: a piece takes the smallest gap before it that no larger piece has taken, as a closing
   bracket takes the last open one; every partition does that for itself.
3. Conflicts by rank: pieces that found no gap in their partition want the gaps left over in earlier ones. Two
   numbers of each partition tell which ranks of pieces meet which ranks of gaps; they are joined on those ranks.
4. Update: gaps shrink by what they took. A gap that took nothing is smaller than every piece that found none, as
   brackets left over are closing ones before opening ones; so it is done with. Where a sweep placed nothing, no gap holds any piece that is left: as many
   sequences as their tokens need at least are opened by the largest of them.

At first every piece of more than half the capacity opens a sequence, as no two of those can share one. Full pieces
are sequences of their own from the start. A sequence is named by the piece that opened it.
Where a quarter of the pieces or more are under a 32nd of the capacity, such pieces are first put together, in
sorted order, into bundles of up to a 16th, so that the number of supersteps doesn't grow with the pieces a sequence holds.

Each superstep's table is written to the shared folder, so that lineage is one superstep long. Partitions are bounded in
rows. A size that a third of all rows have is split over partitions, as pieces of one size are sorted by number.

Defined results: null and empty texts have one piece, the end id alone. Repeated rows are packed each.
Null keys are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import give_back
from ._session import drop, saved, ship
from .byte_bpe import Encoder, encoder

#: Rows of a partition of a superstep, about.
ROWS = 1 << 15


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a first one that may be shorter."""
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


PIECES = T.StructType(
    [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())]
)


def pieces(df: DataFrame, text: Column, keep: list[Column], *, path: str, pattern: str, end: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """A row per piece: the ``keep`` columns, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""
    from pyspark.sql.functions import arrow_udf

    ship(df.sparkSession)
    trusted = Encoder(path, pattern, True).same_ids()
    give_back()
    names, kinds = ["piece", "start", "length", "ids_crc32", "ids"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, pattern, trusted)
        for column in batches:
            rows: list[tuple] = []
            offsets = [0]
            for ids in enc.all_ids([t or "" for t in column.to_pylist()]):
                ids = np.append(ids, np.uint32(end)).astype("<u4", copy=False)
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    raw = ids[start : start + length].tobytes()
                    rows.append((k, start, length, zlib.crc32(raw), raw if with_ids else None))
                offsets.append(len(rows))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names))

    cut.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    got = df.select(*keep, arrow_udf(cut, T.ArrayType(PIECES))(text).alias("_cut"))
    return got.select(*[c for c in got.columns if c != "_cut"], F.explode("_cut").alias("_p")).select("*", "_p.*").drop("_p", *([] if with_ids else ["ids"]))


def brackets(opening: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of opening and closing brackets: the places of pairs (openings, closings), of the closings and of the openings left over."""
    level = np.cumsum(np.where(opening, 1, -1))
    lowest = np.minimum.accumulate(np.minimum(level, 0)) if len(level) else level
    alone = ~opening & (level < np.concatenate([[0], lowest[:-1]])) if len(level) else opening
    depth = np.where(opening, level, level + 1) - lowest
    at = np.flatnonzero(~alone)
    at = at[np.argsort(depth[at], kind="stable")]
    # on one depth openings and closings take turns
    pair = np.flatnonzero(opening[at[:-1]] & ~opening[at[1:]] & (depth[at[:-1]] == depth[at[1:]])) if len(at) else at
    first, second = at[pair], at[pair + 1]
    left = opening.copy()
    left[first] = False
    return first, second, np.flatnonzero(alone), np.flatnonzero(left)


_STEP = "state int, id bigint, size bigint, sequence bigint, gap bigint, part int, rank bigint"
PLACED, WAITING, OPEN = 0, 1, 2


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and left-overs of one partition's sorted pieces and gaps; the last gap left over has rank 0."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    size, piece, name = (np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in got]) for c in ("size", "piece", "id"))
    first, second, waiting, left = brackets(~piece)
    left = left[::-1]
    own = TaskContext.get().partitionId()

    def rows(state: int, at: np.ndarray, gaps: np.ndarray) -> pa.RecordBatch:
        n = max(len(at), len(gaps))
        none = pa.nulls(n, pa.int64())
        columns = [pa.array(name[at]), pa.array(size[at])] if len(at) else [none, none]
        columns += [pa.array(name[gaps]), pa.array(size[gaps])] if len(gaps) else [none, none]
        return pa.record_batch([pa.array(np.full(n, state, np.int32)), *columns, pa.array(np.full(n, own, np.int32)), pa.array(np.arange(n))], names=["state", "id", "size", "sequence", "gap", "part", "rank"])

    none = np.zeros(0, np.int64)
    for state, at, gaps in ((PLACED, second, first), (WAITING, waiting, none), (OPEN, none, left)):
        if len(at) or len(gaps):
            yield rows(state, at, gaps)


def meetings(waiting: dict[int, int], left: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of pieces of a partition meet which ranks of gaps of another: (part, first rank, pieces, gaps' part, first
    rank of them). At most two entries for each partition."""
    stack: list[tuple[int, int]] = []
    out, taken = [], {}
    for part in sorted({*waiting, *left}):
        rank, n = 0, waiting.get(part, 0)
        while n and stack:
            other, rest = stack.pop()
            m = min(n, rest)
            out.append((part, rank, m, other, taken.get(other, 0)))
            taken[other] = taken.get(other, 0) + m
            rank, n = rank + m, n - m
            if rest > m:
                stack.append((other, rest - m))
        if left.get(part):
            stack.append((part, left[part]))
    return out


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    """A small table of integers: a row or two for each partition."""
    columns = zip(*rows) if rows else [[]] * len(names.split())
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=names.split()))


def shares(waiting: dict[int, int], met: list[tuple[int, int, int, int, int]], fresh: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(part, ranks that open sequences) of the ``fresh`` first waiting pieces, and (part, first rank that is still waiting)."""
    across: dict[int, int] = {}
    for part, _, m, _, _ in met:
        across[part] = across.get(part, 0) + m
    opening, still = [], []
    for part in sorted(waiting):
        k = min(fresh, waiting[part])
        fresh -= k
        opening.append((part, k))
        still.append((part, max(across.get(part, 0), k)))
    return opening, still


def _bundled(left: DataFrame, capacity: int, parts: int) -> DataFrame:
    """(id, item, inner, size): pieces under a 32nd of the capacity in bundles, named by their first one, the others alone."""
    width = capacity // 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first, first_at = 0, None, 0
        for b in batches:
            ids, sizes = b["id"].to_numpy(), b["size"].to_numpy()
            if not len(ids):
                continue
            start = before + np.cumsum(sizes) - sizes
            slot = start // width
            fresh = np.concatenate([[first is None or slot[0] != first_at // width], slot[1:] != slot[:-1]])
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), -1))
            item = np.where(at >= 0, ids[at], first if first is not None else 0)
            begin = np.where(at >= 0, start[at], first_at)
            yield pa.record_batch([b["id"], pa.array(item), pa.array(start - begin), b["size"]], names=["id", "item", "inner", "size"])
            before, first, first_at = int(start[-1] + sizes[-1]), int(item[-1]), int(begin[-1])

    small = left.where(F.col("size") < width).repartitionByRange(parts, F.col("size").desc(), "id").sortWithinPartitions(F.col("size").desc(), "id")
    alone = left.where(F.col("size") >= width).select("id", F.col("id").alias("item"), F.lit(0).cast("bigint").alias("inner"), "size")
    return small.mapInArrow(run, "id bigint, item bigint, inner bigint, size bigint").unionByName(alone)


def _places(items: DataFrame, capacity: int, number: int) -> DataFrame:
    """(id, sequence, offset) of every item, of sizes under the capacity."""
    spark = items.sparkSession
    half = 2 * F.col("size") > capacity
    opened = items.select("id", F.col("id").alias("sequence"), F.lit(0).cast("bigint").alias("offset"), "size")
    placed = [opened.where(half).drop("size")]
    gaps = opened.where(half).select(F.col("id").alias("sequence"), (capacity - F.col("size")).alias("gap"))
    left = items.where(~half)
    used: list[DataFrame] = []
    rows, waiting_rows = number, number
    while waiting_rows:
        parts = max(1, -(-rows // ROWS))
        both = left.select("size", F.lit(True).alias("piece"), "id").union(gaps.select("gap", F.lit(False), "sequence"))
        order = [F.col("size").desc(), F.col("piece"), F.col("id")]
        step = saved(both.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_sweep, _STEP), "sweep")
        seen = step.groupBy("part", "state").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("size").alias("least")).collect()  # a row or three for each partition
        of = lambda s: {r["part"]: r["n"] for r in seen if r["state"] == s}  # noqa: E731, B023
        waiting, open_ = of(WAITING), of(OPEN)
        met = meetings(waiting, open_)
        least = min((r["least"] for r in seen if r["state"] == WAITING), default=capacity)
        done, across = sum(of(PLACED).values()), sum(m for _, _, m, _, _ in met)
        # of each partition's waiting pieces, the first ones meet gaps of other partitions; where nothing was placed, the largest open sequences
        fresh = 0 if done or across else -(-sum(r["size"] for r in seen if r["state"] == WAITING) // capacity)
        opening, still = shares(waiting, met, fresh)
        wait = step.where(F.col("state") == WAITING)
        at = F.broadcast(_values(spark, still, "p begin"))  # a row for each partition
        left_next = wait.join(at, wait["part"] == at["p"]).where(F.col("rank") >= F.col("begin")).select("id", "size")
        old = step.where(F.col("state") == OPEN)
        gaps_next = None
        took = [step.where(F.col("state") == PLACED).select("id", "size", "sequence", "gap")]
        if met:
            ranks = F.broadcast(_values(spark, met, "p first n other other_first"))  # two rows for each partition
            asked = wait.join(ranks, (wait["part"] == ranks["p"]) & (wait["rank"] >= F.col("first")) & (wait["rank"] < F.col("first") + F.col("n")))
            asked = asked.select("id", "size", F.col("other").alias("_part"), (F.col("other_first") + F.col("rank") - F.col("first")).alias("_rank"))
            given = old.select("sequence", "gap", F.col("part").cast("bigint").alias("_part"), F.col("rank").alias("_rank"))
            took.append(saved(asked.hint("merge").join(given, ["_part", "_rank"]).select("id", "size", "sequence", "gap"), "across"))
            used.append(took[-1])
        for t in took:
            placed.append(t.select("id", "sequence", (capacity - F.col("gap")).alias("offset")))
            shrunk = t.select("sequence", (F.col("gap") - F.col("size")).alias("gap"))
            gaps_next = shrunk if gaps_next is None else gaps_next.union(shrunk)
        if fresh:
            at = F.broadcast(_values(spark, opening, "p end"))
            new = wait.join(at, wait["part"] == at["p"]).where(F.col("rank") < F.col("end"))
            placed.append(new.select("id", F.col("id").alias("sequence"), F.lit(0).cast("bigint").alias("offset")))
            gaps_next = gaps_next.union(new.select("id", capacity - F.col("size")))
        used.append(step)
        waiting_rows = sum(waiting.values()) - across - fresh
        rows = waiting_rows + done + across + fresh
        left, gaps = left_next, gaps_next.where(F.col("gap") >= least)
    out = placed[0]
    for p in placed[1:]:
        out = out.union(p)
    out = saved(out, "places")
    drop(*used)
    return out


def pack(got: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Add sequence_id and offset to a table of pieces, whose lengths are 1 to ``capacity``."""
    ship(got.sparkSession)
    columns = [F.col(c) for c in got.columns]
    rows = saved(got.select(F.struct(*columns).alias("row"), F.col(length).cast("bigint").alias("size")).withColumn("id", F.monotonically_increasing_id()), "pieces")
    small = F.col("size") < capacity // 32
    seen = rows.agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count_if(F.col("size") < capacity).alias("n"), F.count_if(small).alias("small"), F.count_if(F.col("size").isNull()).alias("none")).first()
    if seen["none"] or seen["least"] is not None and (seen["least"] < 1 or seen["most"] > capacity):
        raise ValueError("pieces must have lengths from 1 to the capacity")
    left = rows.where(F.col("size") < capacity).select("id", "size")
    if 4 * seen["small"] > seen["n"]:
        bundles = saved(_bundled(left, capacity, -(-seen["small"] // ROWS)), "bundles")
        items = saved(bundles.groupBy("item").agg(F.sum("size").alias("size")).select(F.col("item").alias("id"), "size"), "items")
        placed = _places(items, capacity, seen["n"]).withColumnRenamed("id", "item")
        placed = bundles.join(placed, "item").select("id", "sequence", (F.col("offset") + F.col("inner")).alias("offset"))
    else:
        placed = _places(left, capacity, seen["n"])
    out = rows.join(placed, "id", "left")
    return out.select("row.*", F.coalesce("sequence", "id").alias("sequence_id"), F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset"))
