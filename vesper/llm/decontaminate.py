"""Benchmark decontamination by template canonicalisation.

Words become tokens: lower-cased words, or typed placeholders for numbers, units after numbers and
names (capitalised words within a sentence, and those at its begin that stand within another). Windows of tokens are hashed, once with and once without
name placeholders, and hash-joined with the windows of the benchmark, so that a question with other
numbers, names or units is found as well as its exact text. A found pair is verified token by token
along the diagonals of its windows: a placeholder pair counts as equal only where its slot is
consistent, one value of the item always standing for the same value in the document, and that for no other.
Windows of fewer than two literal words tell nothing and are not joined: a run that counts has a window with more.

Before the join a bit array of fixed size, made from all benchmark windows, leaves out document
windows that match nothing; it drops no match at any benchmark size.

Defined results: null and empty texts or items match nothing. Items of fewer than ``least`` tokens are
too short to be told from chance and match nothing; items shorter than a window are matched whole.
Repeated rows of either table give repeated or equal pairs once per row of the documents. Null keys
are allowed. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _BASE, ALNUM, U64, blocks, byte_texts, lower, mix, owners, windows, word_hashes, words
from ._session import saved, ship

WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3

# Words that are units of measure where they follow a number.
UNITS = (
    "kg g mg lb lbs oz tons tonnes km m cm mm mi mile miles ft feet foot inch inches yards meters metres kilometers kilometres "
    "centimeters l ml liter liters litre litres gallons hour hours h min minute minutes s sec second seconds day days week weeks "
    "month months year years dollar dollars usd cent cents eur euro euros pounds gbp percent degrees mph kmh"
).split()

WINDOW = 8
LEAST = 4
_MARKS = [mix(np.array([x], dtype=U64))[0] for x in (0, 101, 102, 103)]
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWERCASE = np.zeros(256, dtype=bool)
_LOWERCASE[97:123] = True
#: Second bytes of capitals after their first byte, and the first bytes after which small letters stand: Latin-1, Greek, Cyrillic.
_CAPITALS = {0xC3: (0x80, 0x9E), 0xCE: (0x86, 0xAB), 0xD0: (0x80, 0xAF)}
_SMALL = {0xC3: (0x9F, 0xBF), 0xCE: (0xAC, 0xBF), 0xCF: (0x80, 0x8E), 0xD0: (0xB0, 0xBF), 0xD1: (0x80, 0x9F)}
_END = np.zeros(256, dtype=bool)
_END[[10, 33, 46, 58, 63]] = True
_unit_hashes: np.ndarray | None = None


def _units() -> np.ndarray:
    global _unit_hashes
    if _unit_hashes is None:
        (_, _, data, _), *_ = blocks([" ".join(UNITS).encode()])
        _unit_hashes = np.sort(word_hashes(data, *words(data, ALNUM)))
    return _unit_hashes


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, x), max(0, len(ordered) - 1))
    return ordered[at] == x if len(ordered) else np.zeros(len(x), dtype=bool)


class Tokens:
    """Tokens of the texts of a block: literal hashes, kinds, and the two canonical forms."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray) -> None:
        data = lower(raw)
        mask = ALNUM[data]
        digit = _DIGIT[data]
        mark = (data == 46) | (data == 44)
        mask[1:-1] |= mark[1:-1] & digit[:-2] & digit[2:]
        edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        self.starts, self.ends = starts, ends
        self.literal = word_hashes(data, starts, ends)
        self.first = owners(starts, bounds)
        other = np.concatenate([[0], np.cumsum(~(digit | mark))])
        number = (other[ends] == other[starts]) & digit[starts]
        opening = np.zeros(len(starts) + 1, dtype=bool)
        opening[self.first[:-1]] = True
        opening = opening[:-1]
        unit = np.zeros(len(starts), dtype=bool)
        if len(starts) > 1:
            unit[1:] = number[:-1] & ~opening[1:] & _among(self.literal[1:], _units())
        upper, smaller = _UPPER[raw], _LOWERCASE[raw]
        for table, flags in ((_CAPITALS, upper), (_SMALL, smaller)):
            for lead, (low, high) in table.items():
                at = np.flatnonzero(raw[:-1] == lead)
                flags[at[(raw[at + 1] >= low) & (raw[at + 1] <= high)]] = True
        terminators = np.concatenate([[0], np.cumsum(_END[raw])])
        inner = np.zeros(len(starts), dtype=bool)
        if len(starts) > 1:
            inner[1:] = (terminators[starts[1:]] == terminators[ends[:-1]]) & ~opening[1:]
        small = np.concatenate([[0], np.cumsum(smaller)])
        name = upper[starts] & (small[ends] > small[starts]) if len(starts) else np.zeros(0, dtype=bool)
        # at a sentence's begin any word is a capital one: there it is a name if the same text has it within a sentence
        with np.errstate(over="ignore"):
            own = mix(self.literal + U64(_BASE) * np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)).astype(U64))
        name &= inner | _among(own, np.unique(own[name & inner]))
        self.kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, WORD))).astype(np.int8)
        self.plain = np.where(number, _MARKS[NUMBER], np.where(unit, _MARKS[UNIT], self.literal))
        self.named = np.where(name, _MARKS[NAME], self.plain)

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Window hashes of both forms, and which windows lie within one text and have two literal words or more (for all starts at which a window fits)."""
        a, b = windows(self.plain, size), windows(self.named, size)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        words_ = np.concatenate([[0], np.cumsum(self.kind == WORD)])
        whole = (text[: len(a)] == text[size - 1 :]) & (words_[size:] - words_[:-size] >= 2) if len(a) else np.zeros(0, dtype=bool)
        return np.stack([mix(a + U64(size)), mix(b + U64(size) + U64(1 << 32))]), whole


def item_windows(texts: list[bytes], size: int = WINDOW, least: int = LEAST) -> Iterator[list[tuple[int, int, int]]]:
    """(hash, place, tokens in the window) of each benchmark text; one window where it is shorter than that."""
    for text in texts:
        (_, _, raw, bounds), *_ = blocks([text])
        t = Tokens(raw, bounds)
        n = len(t.literal)
        own = min(size, n)
        rows: dict[tuple[int, int], int] = {}
        if n >= least:
            both, whole = t.hashes(own)
            for form in both.view(np.int64):
                for place in np.flatnonzero(whole).tolist():
                    rows[(int(form[place]), place)] = own
        yield [(h, place, k) for (h, place), k in rows.items()]


def verify(document: bytes, item: bytes, size: int = WINDOW) -> dict:
    """How much of the item the document has: coverage (share of tokens in matched runs), run (longest run of
    matched tokens), begin and end (tokens of the document), changed (slots whose value differs)."""
    (_, _, raw, bounds), *_ = blocks([document])
    d = Tokens(raw, bounds)
    (_, _, raw, bounds), *_ = blocks([item])
    t = Tokens(raw, bounds)
    n, m = len(t.literal), len(d.literal)
    own = min(size, n)
    none = {"coverage": 0.0, "run": 0, "begin": 0, "end": 0, "changed": 0}
    if not n or m < own:
        return none
    places: dict[int, list[int]] = {}
    ti, _ = t.hashes(own)
    for form in ti:
        for j, h in enumerate(form.tolist()):
            places.setdefault(h, []).append(j)
    di, _ = d.hashes(own)
    wanted = np.array(sorted(places), dtype=U64)
    diagonals: set[int] = set()
    for form in di:
        for i in np.flatnonzero(_among(form, wanted)).tolist():
            diagonals.update(i - j for j in places[int(form[i])])
    covered, best = np.zeros(n, dtype=bool), none
    literal = 0
    for diagonal in diagonals:
        j = np.arange(max(0, -diagonal), min(n, m - diagonal))
        i = j + diagonal
        same = t.literal[j] == d.literal[i]
        slot = (t.kind[j] == d.kind[i]) & (t.kind[j] != WORD)
        good = same | slot
        seen: dict[int, int] = {}
        taken: dict[int, int] = {}
        for x in np.flatnonzero(slot).tolist():
            u, v = int(t.literal[j[x]]), int(d.literal[i[x]])
            if seen.get(u, v) != v or taken.get(v, u) != u:
                good[x] = False
            else:
                seen[u], taken[v] = v, u
        edges = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
        for a, b in zip(edges[0::2], edges[1::2]):
            words_ = int((same[a:b] & (t.kind[j[a:b]] == WORD)).sum())
            if b - a >= min(own, n) and words_ >= max(2, (b - a) // 3):
                covered[j[a:b]] = True
                literal += words_
                if b - a > best["run"]:
                    best = {"run": int(b - a), "begin": int(i[a]), "end": int(i[b - 1]) + 1, "changed": int((~same[a:b]).sum())}
    return {**none, **best, "coverage": float(covered.mean())}


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", *, coverage: float = 0.5, run: int = 13) -> DataFrame:
    """(key, item key, coverage, run, begin, end, changed) of each document and item that it holds.

    A pair counts from ``coverage`` of the item's tokens on, or from a run of ``run`` tokens on.
    """
    from pyspark.sql.functions import arrow_udf

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("h", pa.int64()), ("place", pa.int32()), ("size", pa.int32())]))
        for column in batches:
            yield pa.array([[{"h": h, "place": p, "size": k} for h, p, k in row] for row in item_windows(byte_texts(column))], kind)

    cut.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    ship(docs.sparkSession)
    named = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("item_text")).where("item_text is not null").withColumn("iid", F.monotonically_increasing_id())
    bench = saved(named.withColumn("w", arrow_udf(cut, "array<struct<h:bigint,place:int,size:int>>")("item_text")), "items")
    each = bench.select("iid", F.explode("w").alias("w")).select("iid", "w.*")
    sizes = [r["size"] for r in each.select("size").distinct().collect()]  # 1 to WINDOW at most
    count = each.count()
    bits = min(29, max(20, int(64 * max(1, count)).bit_length()))
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(each, bits))  # 2**bits bits, 64 MB at most

    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = sieve.value
        for column in batches:
            out: list = []
            for first, last, raw, bounds in blocks(byte_texts(column)):
                t = Tokens(raw, bounds)
                got: list[set] = [set() for _ in range(first, last)]
                for size in sizes:
                    both, whole = t.hashes(size)
                    for form in both:
                        at = np.flatnonzero(whole & _in_sieve(form, table, bits))
                        text_ = np.searchsorted(t.first, at, "right") - 1
                        for i, h in zip(text_.tolist(), form[at].view(np.int64).tolist()):
                            got[i].add(h)
                out += [sorted(g) for g in got]
            yield pa.array(out, pa.list_(pa.int64()))

    hits.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.withColumn("w", arrow_udf(hits, "array<bigint>")("text")).where(F.size("w") > 0)
    found = saved(found.withColumn("rid", F.monotonically_increasing_id()), "hits")
    pairs = found.select("rid", F.explode("w").alias("h")).join(each.select("iid", "h").distinct(), "h").select("rid", "iid").distinct()
    both = pairs.join(found.select("rid", "key", "text"), "rid").join(bench.select("iid", "item", "item_text"), "iid")

    def answer(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("coverage", pa.float64()), ("run", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("changed", pa.int64())])
        for x, y in batches:
            yield pa.array([verify(d, i) for d, i in zip(byte_texts(x), byte_texts(y))], kind)

    answer.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    got = both.withColumn("v", arrow_udf(answer, "struct<coverage:double,run:bigint,begin:bigint,end:bigint,changed:bigint>")("text", "item_text"))
    good = got.where((F.col("v.coverage") >= coverage) | (F.col("v.run") >= run))
    return good.select(F.col("key").alias(key), F.col("item").alias(item_key), "v.*")


_PROBES = [U64(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _in_sieve(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Whether all probes of each hash are set; later probes look at what earlier ones left."""
    at = np.arange(len(h))
    with np.errstate(over="ignore"):
        for factor in _PROBES:
            place = (h[at] * factor) >> U64(64 - bits)
            at = at[(table[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & np.uint8(1) != 0]
    out = np.zeros(len(h), dtype=bool)
    out[at] = True
    return out


def _sieve(each: DataFrame, bits: int) -> np.ndarray:
    """The bits that benchmark windows set; executors make parts of it, so the driver never gets the windows."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 3), dtype=np.uint8)
        seen = False
        for batch in batches:
            h = batch["h"].to_numpy(zero_copy_only=False).view(np.uint64)
            with np.errstate(over="ignore"):
                for factor in _PROBES:
                    place = (h * factor) >> U64(64 - bits)
                    np.bitwise_or.at(table, place >> U64(3), np.left_shift(np.uint8(1), (place & U64(7)).astype(np.uint8)))
            seen = True
        if seen:
            yield pa.record_batch([pa.array([table.tobytes()], pa.binary())], names=["t"])

    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in each.select("h").coalesce(8).mapInArrow(part, "t binary").collect():
        table |= np.frombuffer(r["t"], dtype=np.uint8)
    return table
