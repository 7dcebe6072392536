"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with the same set of word shingles are one class from the start. A class gets a MinHash
signature, and the forest has several orders of it. Sorted by such an order, classes that share a long
prefix stand together: a region is a run of classes that share the least depth. Each class meets its
neighbours of longest common prefix there, up to a reach; candidates are confirmed on full shingle sets.

Regions wider than the reach are not cut off. Those in which several components remain after the
confirmed links are swept again with eight times the reach, over rows that carry the whole signature:
a class is compared with every class of another component within the reach, and only pairs whose
signatures agree well enough come out. Regions still wider than that adapt their depth: their classes
go into deeper forests with more orders, in which regions are narrower while what is as similar as the
threshold still meets. At the greatest depth the reach grows until nothing is left. Pairs inside one
component are never needed, and no group makes all its pairs.

A pair at the threshold 0.75 shares 4 values of a tree with probability 0.316; with 32 trees of
disjoint values it is missed once in 190,000 times.

Defined results: null, empty and wordless texts have the empty set and are linked with nothing, not
even each other. Texts of fewer words than a shingle have one shingle, all their words. Repeated rows
are exact copies. Null keys are allowed; a class of null keys alone has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import LOWER, NONSPACE, U64, blocks, byte_texts, mix, owners, windows, word_hashes, words
from ._session import drop, saved, ship
from .components import joined

SHINGLE = 5
VALUES = 256
REACH = 3

#: Depth, orders and reach of each sweep; the first forest's orders are disjoint parts of the signature.
SWEEPS = ((4, 32, REACH), (4, 32, 48), (4, 32, 384), (4, 32, 3072), (8, 256, 384), (12, 768, 3072))
#: How far under the threshold the agreement of signatures may be for a pair to be confirmed on its sets: 5.2 standard
#: errors, of the signature's values in the first sweep, of these and ``MORE`` values of a byte each in the wide ones.
FIRST_LEAST = 0.14
MORE = 768
WIDE_LEAST = 0.0705
#: Values that follow the least depth in a label, for the order within a region.
FOLLOWING = 4

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * U64(2) + U64(1)
_SHIFTS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_MORE_FACTORS = _rng.integers(1, 1 << 63, MORE, dtype=np.uint64) * U64(2) + U64(1)
_MORE_SHIFTS = _rng.integers(0, 1 << 63, MORE, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    for _, _, raw, bounds in blocks(texts):
        data = LOWER[raw]
        starts, ends = words(data, NONSPACE)
        hashes = word_hashes(data, starts, ends)
        all_ = windows(hashes, size)
        first = owners(starts, bounds)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= size:
                yield np.unique(all_[a : b - size + 1])
            elif b > a:
                yield windows(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, dtype=U64)


def _smallest(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint64).max, dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 256):
            part = factors[:, None] * shingles[None, i : i + 256] + shifts[:, None]
            np.minimum(out, part.min(axis=1), out=out)
    return mix(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each of the hash functions, 16 bits of the smallest value over the set."""
    return (_smallest(shingles, _FACTORS, _SHIFTS) >> U64(48)).astype(">u2")


def _more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte each of ``MORE`` other hash functions, for classes in wide regions."""
    for batch in batches:
        got = [(_smallest(s, _MORE_FACTORS, _MORE_SHIFTS) >> U64(56)).astype(np.uint8).tobytes() for s in shingle_sets(byte_texts(batch["text"]))]
        yield pa.record_batch([batch["node"], pa.array(got, pa.binary())], names=["node", "more"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, high, low, signs = [], [], [], []
        with np.errstate(over="ignore"):
            for s in shingle_sets(byte_texts(batch["text"])):
                sizes.append(len(s))
                # two independent sums over the set name it: 126 bits
                high.append(int(mix(s * U64(0xD6E8FEB86659FD93) + U64(1)).sum() >> U64(1)) if len(s) else None)
                low.append(int(mix(s ^ U64(0xA0761D6478BD642F)).sum() >> U64(1)) if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
        yield pa.record_batch([batch["key"], batch["t"], pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(signs, pa.binary())], names=["key", "t", "n", "h", "l", "signature"])


def orders(depth: int, trees: int) -> np.ndarray:
    """For each tree, the places of the signature that its labels read."""
    if depth * trees <= VALUES:
        return (np.arange(trees)[:, None] * depth + np.arange(depth + FOLLOWING)) % VALUES
    rng = np.random.default_rng([depth, trees])
    return np.stack([rng.permutation(VALUES)[: depth + FOLLOWING] for _ in range(trees)])


def _trees(depth: int, trees: int, whole_signature: bool):
    """A row for each class and tree: label, the tree's number and the signature's values in its order; if asked, all values."""
    places = orders(depth, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sketches = batch["signature"].to_pylist()
                signs = np.frombuffer(b"".join(x[: 2 * VALUES] for x in sketches), dtype=np.uint16).reshape(-1, VALUES)
                labels = np.ascontiguousarray(signs[:, places]).view(np.uint8).reshape(batch.num_rows * trees, -1)
                tree = np.tile(np.arange(trees, dtype=">u2"), batch.num_rows).view(np.uint8).reshape(-1, 2)
                joined = np.concatenate([tree, labels], axis=1)
                offsets = np.arange(len(joined) + 1, dtype=np.int32) * joined.shape[1]
                column = pa.Array.from_buffers(pa.binary(), len(joined), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined.tobytes())])
                repeated = [pa.array(np.repeat(batch[c].to_numpy(), trees), pa.int64()) for c in ("node", "n", "c")]
                sketch = [x for x in sketches for _ in range(trees)] if whole_signature else [None] * len(joined)
                yield pa.record_batch([column, *repeated, pa.array(sketch, pa.binary())], names=["label", "node", "n", "c", "sketch"])

    return run


def forest(nodes: DataFrame, depth: int, trees: int, whole_signature: bool = False) -> DataFrame:
    """(label, node, n, c, sketch) from classes with node, n, signature and their component c."""
    return nodes.select("node", "n", "signature", "c").mapInArrow(_trees(depth, trees, whole_signature), "label binary, node bigint, n bigint, c bigint, sketch binary")


def _prefix(depth: int) -> int:
    return 2 + 2 * depth


_SWEPT = "kind int, a bigint, b bigint, near double, label binary, node bigint, n bigint, c bigint, sketch binary"


def _sweep(depth: int, disjoint: bool, done: int, reach: int, threshold: float, least: float):
    """Neighbours of sorted rows; see the module's text. Rows up to ``done`` places away have met in the sweep
    before. Where trees read disjoint values, a pair comes out in the first tree that has both in a region.
    Kind 0: a candidate pair; 1: a row of a region wider than the reach (of rows with sketches, the region's first alone); 2: a row so near the end of its partition that its neighbours may be in another."""
    width = _prefix(depth)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["kind", "a", "b", "near", "label", "node", "n", "c", "sketch"]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def met(row: tuple, region: list[tuple], ring: tuple | None) -> list[tuple]:
        """Pairs of the row with the region's last rows of other components."""
        label, node, n, c, sketch, part = row
        if sketch is None:
            near = [x for x in region if x[3] != c and (part is None or x[5] != part) and min(n, x[2]) >= threshold * max(n, x[2])]
            return [(0, min(node, x[1]), max(node, x[1]), None, None, None, None, None, None) for x in near]
        nodes, sizes, components, sketches, numbers, parts, more, count = ring
        used = slice(0, min(count, reach))
        at = np.flatnonzero((components[used] != c) & (count - numbers[used] > done) & (part is None or parts[used] != part))
        at = at[np.minimum(sizes[at], n) >= threshold * np.maximum(sizes[at], n)]
        same = sketches[at] == np.frombuffer(sketch, np.uint16, VALUES)
        agree = same.mean(axis=1)
        likely = agree >= least - FIRST_LEAST
        at, same, agree = at[likely], same[likely], agree[likely]
        other = (more[at] == np.frombuffer(sketch, np.uint8, MORE, 2 * VALUES)).mean(axis=1)
        agree = (VALUES * agree + MORE * other) / (VALUES + MORE)
        good = agree >= least
        if disjoint:
            tree = int.from_bytes(label[:2], "big")
            good &= ~same[:, : tree * depth].reshape(len(at), tree, depth).all(axis=2).any(axis=1)
        return [(0, min(node, x), max(node, x), y, None, None, None, None, None) for x, y in zip(nodes[at[good]].tolist(), agree[good].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        region: list[tuple] = []  # the last ``reach`` rows of the region
        prefix, wide, first, count = None, False, True, 0
        head: list[tuple] = []
        ring = None

        for batch in batches:
            ends_of = batch["part"].to_pylist() if "part" in batch.schema.names else [None] * batch.num_rows
            for row in zip(*[batch[c].to_pylist() for c in names[4:]], ends_of):
                label, node, n, c, sketch, part = row
                if label[:width] != prefix:
                    first = prefix is None
                    prefix, region, wide, count = label[:width], [], False, 0
                if first and len(head) < reach:
                    head.append(row)
                if region:
                    out += met(row, region, (*ring, count) if ring else None)
                if sketch is not None:
                    if ring is None:
                        ring = (*(np.zeros(reach, np.int64) for _ in range(3)), np.zeros((reach, VALUES), np.uint16), np.zeros(reach, np.int64), np.zeros(reach, np.int64), np.zeros((reach, MORE), np.uint8))
                    at = count % reach
                    ring[0][at], ring[1][at], ring[2][at], ring[3][at], ring[4][at], ring[5][at] = node, n, c, np.frombuffer(sketch, np.uint16, VALUES), count, -1 if part is None else part
                    ring[6][at] = np.frombuffer(sketch, np.uint8, MORE, 2 * VALUES)
                count += 1
                region.append(row)
                if len(region) > reach:
                    marked = ([] if wide else [row]) if sketch is not None else [row] if wide else region
                    out += [(1, None, None, None, *r[:4], None) for r in marked]
                    wide = True
                    region.pop(0)
                if len(out) >= 20_000:
                    yield emit(out)
                    out = []
        own = TaskContext.get().partitionId()
        ends = [(2, own, None, None, *r[:5]) for r in dict.fromkeys([*head, *region])]
        for i in range(0, len(ends), 20_000):
            out += ends[i : i + 20_000]
            yield emit(out)
            out = []
        if out:
            yield emit(out)

    return run


def _swept(rows: DataFrame, depth: int, disjoint: bool, done: int, reach: int, threshold: float, least: float, parts: int) -> DataFrame:
    spread = rows.repartitionByRange(parts, "label", "node") if parts > 1 else rows.coalesce(1)
    ordered = spread.sortWithinPartitions("label", "node")
    return saved(ordered.mapInArrow(_sweep(depth, disjoint, done, reach, threshold, least), _SWEPT), "forest")


def _seams(swept: DataFrame, depth: int, disjoint: bool, reach: int, threshold: float, least: float, parts: int) -> DataFrame:
    """The sweep of neighbours across partitions: the rows at partition ends are range-partitioned again, 16 partitions' ends
    in one, and so are the ends of those, until one is left; so no task gets more ends than 16 partitions have."""
    out = []
    while not out or parts > 1:
        parts = max(1, parts // 16)
        ends = swept.where("kind = 2").select("label", "node", "n", "c", "sketch", F.col("a").alias("part"))
        swept = _swept(ends, depth, disjoint, 0, reach, threshold, least, parts)
        out.append(swept)
    every = out[0].where("kind < 2")
    for more in out[1:]:
        every = every.union(more.where("kind < 2"))
    return every


def _estimated(pairs: DataFrame, signs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree on ``least`` of the values at least; a pair at the threshold is 5 standard errors above."""
    first, second = (signs.select(F.col("node").alias(f"node_{s}"), F.col("sketch").alias(s)) for s in "xy")
    # merge joins here and below: pairs grow with the corpus, and the plan is the same at every size
    both = pairs.hint("merge").join(first.hint("merge"), F.col("a") == F.col("node_x")).join(second.hint("merge"), F.col("b") == F.col("node_y"))

    def agree(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        u = np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1)
        v = np.frombuffer(b"".join(y.to_pylist()), np.uint8).reshape(len(y), -1)
        return pa.array((u == v).mean(axis=1), pa.float64())

    agree.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    from pyspark.sql.functions import arrow_udf

    return both.select("a", "b", arrow_udf(agree, "double")("x", "y").alias("near")).where(F.col("near") >= least)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): the pairs with the answer of their full shingle sets."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")).hint("merge"), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")).hint("merge"), "b")

    def check(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            out = []
            for u, v in zip(byte_texts(x), byte_texts(y)):
                s, t = shingle_sets([u, v])
                both_ = len(np.intersect1d(s, t, assume_unique=True))
                out.append(100 * both_ >= percent * (len(s) + len(t) - both_))
            yield pa.array(out, pa.bool_())

    check.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    from pyspark.sql.functions import arrow_udf

    return both.select("a", "b", arrow_udf(check, "boolean")("x", "y").alias("linked"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", *, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component) for each row: component is the smallest key reachable over confirmed links.

    Candidates, links and components stay distributed; the driver gets counts. Text is shuffled for
    the classes in candidate pairs alone.
    """
    ship(df.sparkSession)
    sets, named = _components(df, text, key, percent)
    out = sets.select("key", "n", "h", "l").join(named.select("h", "l", "smallest"), ["h", "l"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")["key"]).otherwise(F.col("key")).alias("component"))


def representatives(df: DataFrame, text: str = "text", key: str = "doc_id", *, percent: int = 75) -> DataFrame:
    """(key, t, rows) of what stays of each component: the smallest key, and of its texts the one of smallest hash ``t``
    (xxhash64 of the text); ``rows`` is how many rows have both, 1 where all of them stay, as of texts without words."""
    ship(df.sparkSession)
    sets, named = _components(df, text, key, percent)
    chosen = named.where(F.struct("least", "t").eqNullSafe(F.struct(F.col("smallest.key").alias("least"), F.col("smallest.t").alias("t"))))
    # of a component whose key has several texts one class stays; of a class, one text
    wordless = sets.where("n = 0").select("key", "t", F.lit(1).cast("bigint").alias("rows")).distinct()
    found = sets.where("n > 0").join(chosen.select("h", "l", F.col("smallest.key").alias("k"), F.col("smallest.t").alias("u")), ["h", "l"])
    found = found.where(F.col("key").eqNullSafe(F.col("k")) & (F.col("t") == F.col("u")))
    return wordless.union(found.groupBy("key", "t").agg(F.count("*").alias("rows")))


def _components(df: DataFrame, text: str, key: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows with their sets' names, and all distinct sets with the smallest (key, text hash) of their component."""
    threshold = percent / 100
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    sets = saved(rows.mapInArrow(_classes, _classes_schema(df, key)), "sets")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t")).alias("first")
    classes = saved(
        sets.where("n > 0").groupBy("h", "l").agg(first, F.first("n").alias("n"), F.first("signature").alias("signature"), F.count("*").alias("members"))
        .select("h", "l", F.col("first.key").alias("least"), F.col("first.t").alias("t"), "n", "members", "signature", F.xxhash64("h", "l").alias("node")), "classes",
    )
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = linked_components(classes, rows, parts, percent, threshold)
    named = classes.join(found, "node", "left").select("h", "l", "least", "t", F.coalesce("component", "node").alias("component"))
    # written first: a join of two plain exchanges can be split where one component has most of the classes
    named = saved(named, "named")
    smallest = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("key"), "t")).alias("smallest")
    least = saved(named.groupBy("component").agg(smallest), "smallest")
    return sets, named.join(least, "component")


def _classes_schema(df: DataFrame, key: str) -> str:
    return f"key {df.schema[key].dataType.simpleString()}, t bigint, n bigint, h bigint, l bigint, signature binary"


def linked_components(classes: DataFrame, rows: DataFrame, parts: int, percent: int, threshold: float) -> DataFrame | None:
    """(node, component) over confirmed links, for all classes that candidates of the forest connect; None without any."""
    tested = found = None
    level, wider, opened, before, past, texts, wider_signs = 0, 1, None, 0, 0, None, None
    # of each value the first byte, for comparing whole signatures
    sketches = saved(classes.select("node", "n", F.expr("unhex(regexp_replace(hex(signature), '(..)..', '$1'))").alias("sketch")), "sketches")
    while True:
        depth, trees, reach = SWEEPS[min(level, len(SWEEPS) - 1)]
        if level >= len(SWEEPS):
            wider *= 8
        least = threshold - (WIDE_LEAST if level else FIRST_LEAST)
        if opened is None:
            sorted_ = forest(classes.withColumn("c", F.col("node")), depth, trees)
        elif depth == before:
            sorted_ = opened  # the rows of the regions that are still open
        else:
            sorted_ = forest(wider_signs.join(opened.select("node", "c").distinct(), "node"), depth, trees, True)
            sorted_ = opened = saved(sorted_, "deeper")
        disjoint, done = depth * trees <= VALUES, past if depth == before else 0
        swept = _swept(sorted_, depth, disjoint, done, reach * wider, threshold, least, parts)
        seams = _seams(swept, depth, disjoint, reach * wider, threshold, least, parts)
        pairs = swept.where("kind = 0").unionByName(seams.where("kind = 0")).groupBy("a", "b").agg(F.max("near").alias("near"))
        if not level:
            pairs = saved(_estimated(pairs.select("a", "b"), sketches, least), "pairs")
            # whatever is compared later is in one of these pairs or in a region wider than the reach
            wide = swept.where("kind = 1").select("node").union(seams.where("kind = 1").select("node"))
            asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(wide)
            texts = _class_texts(rows, classes, asked)
            # each class first tries its most similar candidate; of the rest, only pairs of components that are still apart
            best = pairs.groupBy("a").agg(F.max_by("b", F.struct("near", "b")).alias("b"))
            best = saved(best.union(pairs.groupBy("b").agg(F.max_by("a", F.struct("near", "a")).alias("a")).select("a", "b")).distinct(), "best")
            answers = saved(_confirmed(best, texts, percent), "answers")
            tested = answers.select("a", "b")
            found = joined(found, answers.where("linked"))
            pairs = saved(_across(pairs.join(tested, ["a", "b"], "left_anti"), found), "pairs")
        else:
            pairs = saved(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        answers = saved(_confirmed(pairs.select("a", "b"), texts, percent), "answers")
        tested = tested.union(answers.select("a", "b"))
        found = joined(found, answers.where("linked"))
        # regions wider than the reach in which several components remain
        region = F.substring("label", 1, _prefix(depth))
        marked = swept.where("kind = 1").select("label", "node").union(seams.where("kind = 1").select("label", "node")).distinct()
        # rows with sketches have their regions marked by one row; the rows are those that were swept
        left = (marked if opened is None else opened.drop("c")).join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        several = left.groupBy(region.alias("p")).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("lo") != F.col("hi")).select("p")
        if opened is not None:
            several = several.join(marked.select(region.alias("p")).distinct(), "p", "left_semi")
        # written first, so that a region with most of the rows can be split in the join
        left = left.join(saved(several, "several"), region == F.col("p"), "left_semi")
        if opened is None:
            left = saved(left, "wide")
            extra = texts.join(left.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_more, "node bigint, more binary")
            wider_signs = classes.select("node", "n", "signature").join(extra, "node").select("node", "n", F.concat("signature", "more").alias("signature"))
            wider_signs = saved(wider_signs, "signatures")
            left = left.join(wider_signs.select("node", "n", F.col("signature").alias("sketch")), "node")
        opened = saved(left.select("label", "node", "n", "c", "sketch"), "open")
        drop(swept, pairs)
        if opened.isEmpty():
            drop(texts, sketches)
            return found
        level, before, past = level + 1, depth, reach * wider


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    x, y = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "near")


def _class_texts(rows: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, text) of one document of each class that is asked for: the one of smallest key."""
    wanted = asked.distinct()
    least = saved(classes.join(wanted, "node", "left_semi").select("node", F.col("least").alias("k"), F.col("t").alias("u")), "wanted")
    # a merge join at any size: which texts are wanted grows with the corpus
    got = rows.join(least.hint("merge"), F.col("key").eqNullSafe(F.col("k")) & (F.col("t") == F.col("u")))
    return saved(got.select("node", "text").dropDuplicates(["node"]), "texts")


def oracle(percent: int = 75) -> str:
    """DuckDB SQL for component_id and n_shingles: all pairs of a shingle, then everything reachable. For small tables."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
