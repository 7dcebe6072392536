"""Fuzzy repeated passages: shared k-mer seeds, collinear chains with gap costs, alignment of the chains.

1. Seeds: of the hashed k-mers of words (lower-cased ASCII, letters and digits), the minimizers of every
   window of ``window`` k-mers. Any run of ``k + window - 1`` equal words has a common seed.
2. Join: each seed occurrence meets the seed's first document, the one of smallest identity, alone: the
   place of the same turn there, and a later occurrence the first place too. A seed that a third of all
   documents hold makes at most twice as many pairs as it has occurrences, never all pairs.
3. Chains: per document and first document, seeds of one diagonal become anchors, and anchors are chained
   in both texts' order; a Fenwick tree over the second text's places gives each anchor its best
   predecessor under a linear gap cost.
4. Alignment: between its anchors a chain is aligned word by word, and beyond its outermost ones as far as
   edits and equal words keep within a bounded drop of the best end; it is kept with enough words and few
   enough edits.
5. Passages: the kept intervals of a document are merged, whatever first documents they have, and those of
   ``least`` words or more are the result; so a passage put together from parts of several first documents
   is found whole. First documents get rows of their own.

Defined results: null, empty and short texts have no passages. Rows that repeat key and text count as one
document, other copies as documents of their own. Repeats within one document are not looked for. Null
keys are allowed. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import ALNUM, LOWER, U64, blocks, byte_texts, mix, owners, windows, word_hashes, words
from ._session import saved, ship

K = 6
WINDOW = 8
#: Words around a chain that its ends may be drawn out over; the least words of a passage if those are more.
MARGIN = 64
GRAIN = 64
MAX_GAP = 40
GAP_COST = 0.2
#: How far an end's words less two for each edit may fall under the best before it is given up.
DROP = 8


def hashed_words(texts: list[bytes]) -> Iterator[np.ndarray]:
    for _, _, raw, bounds in blocks(texts):
        data = LOWER[raw]
        starts, ends = words(data, ALNUM)
        hashes = word_hashes(data, starts, ends)
        first = owners(starts, bounds)
        for a, b in zip(first[:-1], first[1:]):
            yield hashes[a:b]


def minimizers(hashes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, k-mer hashes) of the smallest k-mer of each window."""
    grams = windows(hashes, k)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    if len(grams) <= window:
        at = np.array([int(grams.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(grams, window)
        at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return at, grams[at]


def _seeds(every: bool):
    """Numbered seeds; with ``every``, later occurrences besides under the hash of the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["did"].to_pylist()
            out_h, out_d, out_p = [], [], []
            for did, hashes in zip(ids, hashed_words(byte_texts(batch["text"]))):
                at, grams = minimizers(hashes)
                own = numbered(grams)
                if every and len(later := repeated(at, grams)):
                    own, at = np.concatenate([own, grams[later]]), np.concatenate([at, at[later]])
                out_h.append(own.view(np.int64)), out_p.append(at)
                out_d.append(np.full(len(at), did, dtype=np.int64))
            if out_h:
                yield pa.record_batch([pa.array(np.concatenate(out_h)), pa.array(np.concatenate(out_d)), pa.array(np.concatenate(out_p).astype(np.int32))], names=["h", "did", "pos"])

    return run


def repeated(at: np.ndarray, grams: np.ndarray, near: int = K + WINDOW) -> np.ndarray:
    """Which seeds have come before in the text, ``near`` words before or more: a run of one repeated word is met at its begin, and drawn out from there."""
    order = np.argsort(grams, kind="stable")
    same = np.flatnonzero(grams[order][1:] == grams[order][:-1]) + 1
    return np.sort(order[same[at[order[same]] - at[order[same - 1]] >= near]])


def numbered(grams: np.ndarray) -> np.ndarray:
    """The hashes, those of a second, third, ... occurrence in the text told apart from the first, so that a
    text which repeats itself meets a copy of it place by place."""
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(grams) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(grams)), 0))
    turn = np.empty(len(grams), dtype=U64)
    turn[order] = (np.arange(len(grams)) - start).astype(U64)
    return np.where(turn > U64(0), mix(grams + turn), grams)


def chains(x: list[int], y: list[int], k: int = K, near: int = K + WINDOW, max_gap: int = MAX_GAP, cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Chains of anchors (place in x, place in y, words) from seed pairs, best first; each anchor is in one."""
    anchors: list[list[int]] = []
    for d, a, b in sorted((p - q, p, q) for p, q in set(zip(x, y))):
        last = anchors[-1] if anchors else None
        if last and last[0] - last[1] == d and a - (last[0] + last[2] - k) <= near:
            last[2] = a + k - last[0]
        else:
            anchors.append([a, b, k])
    anchors.sort()
    n = len(anchors)
    slack = k - 1  # neighbouring diagonals may overlap by so many words
    ranks = {v: i + 1 for i, v in enumerate(sorted({b + m - slack for _, b, m in anchors}))}
    levels = sorted(ranks)
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(levels) + 1)
    score, before = [0.0] * n, [-1] * n
    waiting: list[tuple[int, int]] = []
    for i, (a, b, m) in enumerate(anchors):
        while waiting and waiting[0][0] <= a:
            _, j = heapq.heappop(waiting)
            p, q, o = anchors[j]
            value = (score[j] + cost * (p + o + q + o), j)
            at = ranks[q + o - slack]
            while at < len(tree):
                if value > tree[at]:
                    tree[at] = value
                at += at & -at
        at, best = np.searchsorted(levels, b, "right"), (-np.inf, -1)
        while at:
            if tree[at] > best:
                best = tree[at]
            at -= at & -at
        gain = best[0] - cost * (a + b)
        score[i] = m + max(0.0, gain)
        before[i] = best[1] if gain > 0 else -1
        heapq.heappush(waiting, (a + m - slack, i))
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain: list[tuple[int, int, int]] = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(tuple(anchors[i]))
            i = before[i]
        chain.reverse()
        part: list[tuple[int, int, int]] = []
        for anchor in chain:
            if part and max(anchor[0] - part[-1][0] - part[-1][2], anchor[1] - part[-1][1] - part[-1][2]) > max_gap:
                out.append(part)
                part = []
            part.append(anchor)
        if part:
            out.append(part)
    return out


def _distance(s: list, t: list) -> int:
    """Edits between two short word lists."""
    if not s or not t:
        return len(s) + len(t)
    row = list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def ends(s: list, t: list, drop: int = DROP) -> list[tuple[int, int, int]]:
    """(edits, words of s, words of t) of the ends, on equal words, of alignments from both lists' begins: the farthest
    with no edit, then with more edits as long as they lead farther, up to the one of most words less two for each edit."""
    far, out, best, edits = {0: 0}, [(0, 0, 0)], 0, 0
    while far:
        top = out[-1]
        for d, start in far.items():  # on each diagonal the farthest place
            i = start
            while i < len(s) and i - d < len(t) and s[i] == t[i - d]:
                i += 1
            far[d] = i
            if i > start and i > top[1]:
                top = (edits, i, i - d)
        if top is not out[-1]:
            out = out + [top] if edits else [top]
            best = max(best, top[1] - 2 * edits)
        after: dict[int, int] = {}
        for d, i in far.items():
            if i - 2 * edits <= best - drop:
                continue
            if i < len(s):
                after[d + 1] = max(after.get(d + 1, 0), i + 1)
                if i - d < len(t):
                    after[d] = max(after.get(d, 0), i + 1)
            if i - d < len(t):
                after[d - 1] = max(after.get(d - 1, 0), i)
        far, edits = after, edits + 1
    last = max(range(len(out)), key=lambda k: (out[k][1] - 2 * out[k][0], k))
    return out[: last + 1]


def align(own: np.ndarray, other: np.ndarray, anchors: list[tuple[int, int, int]], identity: float = 0.8) -> tuple[int, int, int, int, int]:
    """(begin, end, begin in other, end in other, edits) of the anchors' chain, its ends drawn out to the most words that ``identity`` allows."""
    a, b, _ = anchors[0]
    i, j, edits = a, b, 0
    for p, q, m in anchors:
        cut = max(0, i - p, j - q)
        if cut >= m:
            continue
        p, q, m = p + cut, q + cut, m - cut
        edits += _distance(own[i:p].tolist(), other[j:q].tolist())
        m = min(m, len(own) - p, len(other) - q)
        edits += int((own[p : p + m] != other[q : q + m]).sum())
        i, j = p + m, q + m
    before, after = ends(own[:a][::-1].tolist(), other[:b][::-1].tolist()), ends(own[i:].tolist(), other[j:].tolist())
    words = lambda x, y: i - a + x[1] + y[1]
    x, y = before[-1], after[-1]
    if edits + x[0] + y[0] > (1 - identity) * words(x, y):
        good = [(x, y) for x in before for y in after if edits + x[0] + y[0] <= (1 - identity) * words(x, y)]
        x, y = max(good, key=lambda pair: words(*pair), default=(before[0], after[0]))
    return a - x[1], i + y[1], b - x[2], j + y[2], edits + x[0] + y[0]


_CHAIN = "did bigint, rep bigint, x0 int, x1 int, y0 int, y1 int, anchors binary"


def _chained(smallest: int, margin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        x: list[int] = []
        y: list[int] = []
        rows: list[tuple] = []

        def close() -> None:
            if held is None:
                return
            for chain in chains(x, y):
                x0, x1 = chain[0][0], chain[-1][0] + chain[-1][2]
                y0, y1 = chain[0][1], chain[-1][1] + chain[-1][2]
                if x1 - x0 + margin * 2 >= smallest:
                    rows.append((*held, x0, x1, y0, y1, np.array(chain, dtype=np.int32).tobytes()))

        def emit() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["did", "rep", "x0", "x1", "y0", "y1", "anchors"])

        for batch in batches:
            d, r = batch["did"].to_numpy(zero_copy_only=False), batch["rep"].to_numpy(zero_copy_only=False)
            p, q = batch["pos"].to_pylist(), batch["rpos"].to_pylist()
            if not len(d):
                continue
            edges = [0, *(np.flatnonzero((d[1:] != d[:-1]) | (r[1:] != r[:-1])) + 1).tolist(), len(d)]
            for a, b in zip(edges[:-1], edges[1:]):
                now = (int(d[a]), int(r[a]))
                if now != held:
                    close()
                    held, x, y = now, [], []
                x += p[a:b]
                y += q[a:b]
            if len(rows) >= 10_000:
                yield emit()
                rows.clear()
        close()
        if rows:
            yield emit()

    return run


def _sliced(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("words", pa.binary())]))
    for texts, ranges in batches:
        out = []
        for hashes, wanted in zip(hashed_words(byte_texts(texts)), ranges.to_pylist()):
            short = (hashes >> U64(32)).astype(np.uint32)
            out.append([{"lo": r["lo"], "hi": r["hi"], "words": short[r["lo"] : r["hi"]].tobytes()} for r in wanted])
        yield pa.array(out, kind)


def _aligned(identity: float):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.struct([(n, pa.int32()) for n in ("x0", "x1", "y0", "y1", "edits")])
        for own, lo, other, rlo, anchors in batches:
            out = []
            for s, a, t, b, c in zip(own.to_pylist(), lo.to_pylist(), other.to_pylist(), rlo.to_pylist(), anchors.to_pylist()):
                chain = np.frombuffer(c, dtype=np.int32).reshape(-1, 3) - np.array([a, b, 0], dtype=np.int32)
                x0, x1, y0, y1, edits = align(np.frombuffer(s, np.uint32), np.frombuffer(t, np.uint32), [tuple(r) for r in chain.tolist()], identity)
                out.append({"x0": x0 + a, "x1": x1 + a, "y0": y0 + b, "y1": y1 + b, "edits": edits})
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return run


def _merged(least: int, near: int = 2):
    """Overlapping or nearly touching intervals become one; those of ``least`` words stay."""

    def run(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("partners", pa.list_(pa.int64()))]))
        out = []
        for row in column.to_pylist():
            now: list[list] = []
            for p in sorted(row, key=lambda p: (p["x0"], p["x1"])):
                if now and p["x0"] <= now[-1][1] + near:
                    now[-1][1] = max(now[-1][1], p["x1"])
                    now[-1][2] = max(now[-1][2], p["edits"])
                    now[-1][3].add(p["rep"])
                else:
                    now.append([p["x0"], p["x1"], p["edits"], {p["rep"]}])
            out.append([{"start": a, "end": b, "edits": e, "partners": sorted(x for x in r if x is not None)} for a, b, e, r in now if b - a >= least])
        return pa.array(out, kind)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return run


def passages(df: DataFrame, text: str = "text", key: str = "doc_id", *, least: int = 50, smallest: int = 20, identity: float = 0.8) -> DataFrame:
    """(key, role, start_word, end_word, n_words, edits, partners) of each passage of ``least`` words or more that
    an earlier document has as well (role ``repeat``, with the keys of those) or that later ones repeat (role ``first``).

    ``smallest`` is the least words of a single aligned chain, ``identity`` its least share of unedited words.
    """
    from pyspark.sql.functions import arrow_udf

    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key).isNull(), key, text).alias("did"))
    margin = max(MARGIN, least)
    texts = rows.select("did", "text").where("text is not null")
    seeds, every = (texts.mapInArrow(_seeds(e), "h bigint, did bigint, pos int") for e in (False, True))
    # a document has a numbered seed once; repeated rows have it twice, at the same place
    canon = seeds.groupBy("h").agg(F.min("did").alias("rep"), F.max("did").alias("most"), F.min_by("pos", "did").alias("rpos")).where("rep <> most").drop("most")
    canon = saved(canon, "seeds")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pairs = every.select("h", "did", "pos").join(canon, "h").where("did <> rep").select("did", "rep", "pos", "rpos")
    ordered = pairs.repartition(parts, "did", "rep").sortWithinPartitions("did", "rep", "pos")
    found = ordered.mapInArrow(_chained(smallest, margin), _CHAIN)
    lo = lambda c: F.greatest(F.lit(0), F.col(c) - margin).cast("int")
    found = found.select("did", "rep", "anchors", lo("x0").alias("lo"), (F.col("x1") + margin).cast("int").alias("hi"), (F.floor(lo("y0") / GRAIN) * GRAIN).cast("int").alias("rlo"), (F.ceil((F.col("y1") + margin) / GRAIN) * GRAIN).cast("int").alias("rhi"))
    found = saved(found, "chains")
    # each range of a document once, however many chains want it
    asked = found.select("did", "lo", "hi").union(found.select("rep", "rlo", "rhi")).distinct().groupBy("did").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    asked = saved(asked, "ranges")
    _sliced.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    texts = rows.join(asked, "did")
    cut = texts.select("did", "key", F.explode(arrow_udf(_sliced, "array<struct<lo:int,hi:int,words:binary>>")("text", "ranges")).alias("s")).select("did", "key", "s.*").dropDuplicates(["did", "lo", "hi"])
    cut = saved(cut, "slices")
    own = found.join(cut.select("did", "lo", "hi", F.col("words").alias("own")), ["did", "lo", "hi"])
    both = own.join(cut.select(F.col("did").alias("rep"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"), F.col("words").alias("other")), ["rep", "rlo", "rhi"])
    got = both.select("did", "rep", arrow_udf(_aligned(identity), "struct<x0:int,x1:int,y0:int,y1:int,edits:int>")("own", "lo", "other", "rlo", "anchors").alias("p")).select("did", "rep", "p.*")
    got = saved(got.where((F.col("x1") - F.col("x0") >= smallest) & (F.col("edits") <= (1 - identity) * (F.col("x1") - F.col("x0")))), "aligned")
    keys = cut.select("did", "key").distinct()
    later = got.select("did", F.lit("repeat").alias("role"), "x0", "x1", "edits", "rep").distinct()
    source = got.select(F.col("rep").alias("did"), F.lit("first").alias("role"), F.col("y0").alias("x0"), F.col("y1").alias("x1"), F.lit(0).alias("edits"), F.lit(None).cast("bigint").alias("rep")).distinct()
    lists = later.union(source).groupBy("did", "role").agg(F.collect_list(F.struct("x0", "x1", "edits", "rep")).alias("all"))
    each = lists.select("did", "role", F.explode(arrow_udf(_merged(least), "array<struct<start:int,end:int,edits:int,partners:array<bigint>>>")("all")).alias("p")).select("did", "role", "p.*")
    each = saved(each, "passages")
    known = each.select("did", "role", "start", F.explode("partners").alias("rep")).join(keys.select(F.col("did").alias("rep"), F.col("key").alias("partner")), "rep")
    known = known.groupBy("did", "role", "start").agg(F.array_sort(F.collect_set("partner")).alias("partners"))
    out = each.drop("partners").join(known, ["did", "role", "start"], "left").join(keys, "did")
    empty = F.array().cast(known.schema["partners"].dataType)
    return out.select(F.col("key").alias(key), "role", F.col("start").cast("long").alias("start_word"), F.col("end").cast("long").alias("end_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), F.col("edits").cast("long").alias("edits"), F.coalesce("partners", empty).alias("partners"))
