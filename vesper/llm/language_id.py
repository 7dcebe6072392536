"""Language identification by the nearest of several centroids per language.

Texts become vectors of hashed byte n-grams (1 to 3 bytes of the lower-cased UTF-8 of letters and gaps), weighted by
the square root of the count and the inverse document frequency, and normalised. Each language has
several centroids from spherical k-means, so that a language with several kinds of text needs no
single mean. A text takes the language of the centroid of highest cosine; it is rejected where its
cosine is far below what texts of its length reach in the fit.

Defined results: a null text, or one without a letter, is ``und``, score 0, rejected. Rows with a
null label or a null key are never fitted on but are predicted. Without any labelled text every
prediction is ``und``. Repeated rows give repeated results; other columns are kept as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._bytes import ALNUM, LOWER, blocks, give_back
from ._session import ship

UNDETERMINED = "und"
PREDICTION = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
)


@dataclass
class Centroids:
    """A fitted model; its size depends on the parameters and the number of languages alone."""

    languages: list[str]
    owner: np.ndarray
    vectors: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    @property
    def bits(self) -> int:
        return int(len(self.idf)).bit_length() - 1


#: Digits, punctuation, control characters and symbols of ASCII tell no language: they all become the space.
LETTERS = np.where(ALNUM & ~np.isin(np.arange(256), np.arange(48, 58)), LOWER, 32).astype(np.uint8)


def gram_codes(data: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each place, the hashed codes of the 1-, 2- and 3-byte grams that start there."""
    low = data.astype(np.uint32)
    out, code = [], np.zeros(len(low), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            code = code[: len(low) - n + 1] * np.uint32(257) + low[n - 1 :]
            out.append(((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - bits))
    return out


def lowered(strings: list) -> list[bytes]:
    return [b"" if s is None else s.lower().encode() for s in strings]


def counts(data: np.ndarray, bounds: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Gram counts of each text of a block, over its letters and one space for what stands between them."""
    low = LETTERS[data]
    space = low == 32
    kept = np.ones(len(low), dtype=bool)
    kept[1:] = ~(space[1:] & space[:-1])
    kept[bounds - 1] = True
    places = np.cumsum(kept) - 1
    codes = gram_codes(low[kept], bits)
    at = places[bounds - 1]
    for a, b in zip(at[:-1], at[1:] + 1):
        yield np.bincount(np.concatenate([c[a : b - n] for n, c in enumerate(codes)]), minlength=1 << bits)


def _vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(count, dtype=np.float32) * idf
    norm = float(np.sqrt(v @ v))
    return v / np.float32(norm) if norm else v


def _length_bin(n: int) -> int:
    return min(23, int(n).bit_length())


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, least: float = 0.04) -> np.ndarray:
    """Spherical k-means from random rows; clusters under ``least`` of the rows are dissolved, as a few odd texts are no kind of text."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]]
    c = c + x.mean(axis=0)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    for turn in range(rounds):
        sizes = np.bincount(best := (x @ c.T).argmax(axis=1), minlength=len(c))
        kept = np.flatnonzero(sizes >= (least * len(x) if turn else 1))
        if not len(kept):
            kept = np.array([int(sizes.argmax())])
        c = np.stack([x[best == j].sum(axis=0) for j in kept])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _held_out(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, centroids: int, rounds: int, seed: int) -> np.ndarray:
    """The cosine of each text with its nearest centroid of a fit without it: of the other half, where that has its language."""
    out, half = (x @ vectors.T).max(axis=1), np.arange(len(x)) % 2
    for h in (0, 1):
        names = [name for name in np.unique(y) if ((y == name) & (half != h)).any()]
        if names:
            other = np.concatenate([_kmeans(x[(y == name) & (half != h)], centroids, rounds, seed) for name in names])
            asked = (half == h) & np.isin(y, names)
            out[asked] = (x[asked] @ other.T).max(axis=1)
    return out


def fit(
    labelled: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    *,
    max_rows: int = 3000,
    bits: int = 12,
    centroids: int = 4,
    rounds: int = 8,
    slack: float = 0.5,
    low: float = 0.02,
    seed: int = 7,
) -> Centroids:
    """Fit on at most ``max_rows`` labelled rows, spread evenly over the languages.

    The bound is on this fit alone: rows are drawn by the hash of key and text, per language. What is
    brought to the driver is at most ``max_rows`` vectors of 2**bits small counts. Per text length, the
    rejection floor is ``slack`` times the ``low`` quantile of the cosines that texts of the fit reach with
    centroids of the other half of them.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(label).cast("string").alias("y"), F.col(text).alias("t"), F.xxhash64(key, text).alias("h")).where("y is not null and t is not null")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Centroids([], np.zeros(0, int), np.zeros((0, 1 << bits), np.float32), np.ones(1 << bits, np.float32), np.zeros(24))
    share = max(1, max_rows // len(sizes))
    # twice the share by hash first, so that the exact top rows of a language are few in any task
    wide = F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, min(1.0, (2 * share + 50) / n))])
    drawn = rows.where(F.pmod(F.col("h"), F.lit(1 << 20)) < F.element_at(wide, F.col("y")) * (1 << 20))
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h"))).where(F.col("r") <= share)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [zlib.compress(c.astype(np.uint32).tobytes(), 1) for _, _, data, bounds in blocks(lowered(batch["t"].to_pylist())) for c in counts(data, bounds, bits)]
            yield pa.record_batch([batch["y"].cast(pa.string()), pa.array(got, pa.binary())], names=["y", "v"])

    got = drawn.select("y", "t").mapInArrow(vectors, "y string, v binary").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["v"])))
    y = np.array([r["y"] for r in got])
    # counts stay packed, so that the driver holds one matrix alone
    packed = [bytes(r["v"]) for r in got]
    del got
    unpacked = lambda v: np.frombuffer(zlib.decompress(v), dtype=np.uint32)
    known, totals = np.zeros(1 << bits, np.int64), np.zeros(len(packed), np.int64)
    for i, v in enumerate(packed):
        count = unpacked(v)
        known += count > 0
        totals[i] = count.sum()
    idf = (np.log((1 + len(packed)) / (1 + known)) + 0.1).astype(np.float32)
    x = np.empty((len(packed), 1 << bits), np.float32)
    for i, v in enumerate(packed):
        x[i] = _vector(unpacked(v), idf)
    languages = sorted(sizes)
    parts = [_kmeans(x[y == name], centroids, rounds, seed) for name in languages if (y == name).any()]
    languages = [name for name in languages if (y == name).any()]
    owner = np.repeat(np.arange(len(languages)), [len(p) for p in parts])
    model = Centroids(languages, owner, np.concatenate(parts).astype(np.float32), idf, np.zeros(24))
    near, bins = _held_out(x, y, model.vectors, centroids, rounds, seed), np.array([_length_bin(n) for n in totals])
    own = [near[bins == b] for b in range(24)]
    enough = [b for b in range(24) if len(own[b]) >= 20]
    floors = np.zeros(24)
    for b in range(24) if enough else ():
        if b in enough:
            floors[b] = slack * np.quantile(own[b], low)
            continue
        # a length with few texts takes the floor of the nearest shorter one; under the shortest, where cosines fall
        # with the root of the length, the floor does so; the few texts themselves stay
        floors[b] = floors[b - 1] if b > enough[0] else slack * np.quantile(own[enough[0]], low) * 2 ** ((b - enough[0]) / 2)
        if len(own[b]):
            floors[b] = min(floors[b], slack * own[b].min())
    model.floors = floors
    del x, packed
    give_back()
    return model


def predict(df: DataFrame, model: Centroids, text: Column | str = "text", output: str = "language") -> DataFrame:
    """Add a struct column ``output`` with lang_pred, score (the cosine) and rejected."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in batches:
            strings = column.to_pylist()
            names, scores, rejected = [], [], []
            for first, last, data, bounds in blocks(lowered(strings)):
                for s, count in zip(strings[first:last], counts(data, bounds, m.bits)):
                    if s is None or not m.languages or not any(map(str.isalpha, s)):
                        names.append(UNDETERMINED), scores.append(0.0), rejected.append(True)
                        continue
                    near = m.vectors @ _vector(count, m.idf)
                    best = int(near.argmax())
                    names.append(m.languages[m.owner[best]])
                    scores.append(min(1.0, max(0.0, float(near[best]))))
                    rejected.append(bool(near[best] < m.floors[_length_bin(int(count.sum()))]))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    from pyspark.sql.functions import arrow_udf

    column = F.col(text) if isinstance(text, str) else text
    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(output, arrow_udf(score, PREDICTION)(column))
