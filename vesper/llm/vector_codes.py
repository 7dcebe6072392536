"""Product codes of vectors in exact integers: float32 matrix products screen, int64 decides.

Components become floor(scale * x); a vector is cut into equal consecutive parts, and each part position has a codebook. A round
assigns every part to its nearest entry and replaces the entries by the floors of their parts' means. For a block of rows one
float32 matrix product gives all distances but for the row's own norm, each with a bound of its rounding error that holds for any
order of the sum. Only entries whose interval overlaps the best one's are computed in int64; ties go to the lower index. So codes
and errors are those of integer arithmetic whatever the machine, its threads or the partitions.

A round is one pass over the saved integer vectors: a task adds up its own parts by entry, Spark adds the tasks' sums, and the
driver gets a row for each entry. Codebooks (parts x entries x width) are all that goes to and from the driver.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of another length
than the most common one (of equally common lengths the smaller). That length has to be a multiple of the number of parts, else
ValueError. Components of which floor(scale * x) has 2**24 or more fail with a message, as their errors needn't fit a long. Where
fewer rows are kept than a codebook has entries, it has as many entries as there are rows. Null keys are kept and come last in the
order of keys; rows that repeat a key are ordered by vector. Null labels are one label. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import saved, ship

#: Unit roundoff of float32, and roundings besides those of the products: of both factors, the norm, the difference, and their bounds.
ROUNDOFF = 2.0**-24
BESIDES = 8
LARGEST = 1 << 24


def finite(vector: Column) -> Column:
    """Whether a vector and all of its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; too large ones fail."""
    too_large = F.raise_error(F.lit(f"a component is too large: floor({scale} * x) has to be under {LARGEST}"))
    return F.transform(vector, lambda x: F.when(F.abs(x) < LARGEST / scale, F.floor(x.cast("double") * scale).cast("int")).otherwise(too_large))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, exact; both arguments are int64, distances have to fit."""
    square = (book * book).sum(axis=1)
    half = square / 2
    score = half.astype(np.float32) - x.astype(np.float32) @ book.astype(np.float32).T
    lengths = np.sqrt((x * x).sum(axis=1).astype(np.float64)), np.sqrt(square.astype(np.float64))
    steps = (x.shape[1] + BESIDES) * ROUNDOFF
    error = steps / (1 - steps) * (np.outer(*lengths) + half)
    low, high = score - error, (score + error).min(axis=1, initial=np.inf)
    rows, entries = np.nonzero(low <= high[:, None])
    apart = x[rows] - book[entries]
    exact = (apart * apart).sum(axis=1)
    order = np.lexsort((entries, exact, rows))
    best = order[np.searchsorted(rows[order], np.arange(len(x)))]
    return entries[best], exact[best]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and distances, a column for each part."""
    both = [nearest(part, book) for part, book in zip(np.split(x, len(books), axis=1), books)]
    return np.column_stack([c for c, _ in both]), np.column_stack([d for _, d in both])


def _sums(books: np.ndarray):
    """The parts of a task's rows added up by entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(books), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch["v"], parts * width)
            codes, _ = _assigned(x, books)
            for p, part in enumerate(np.split(x, parts, axis=1)):
                np.add.at(total[p], codes[:, p], part)
                count[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        values = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * width, total[part, entry].ravel())
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), values], names=["part", "entry", "n", "s"])

    return run


def kept_vectors(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """(k, l, v) of the rows with whole vectors of the most common length, v in integers, as a table; and that length."""
    ship(rows.sparkSession)
    whole = rows.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).alias("v")).where(finite(F.col("v")))
    whole = saved(whole.select("k", "l", integers(F.col("v"), scale).alias("v"), F.size("v").alias("dim")), "integers")
    common = whole.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 0
    return whole.where(F.col("dim") == dim).select("k", "l", "v"), dim


def fit(kept: DataFrame, dim: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    """Codebooks (part, entry, place) after that many rounds, begun with the vectors of the smallest keys."""
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    first = kept.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v").collect()  # as many rows as entries
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        found = kept.select("v").mapInArrow(_sums(books), "part int, entry int, n bigint, s array<bigint>")
        places = [F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(dim // parts)]
        books = books.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *places).collect():  # parts times entries
            books[r["part"], r["entry"]] = np.array(r[3:], dtype=np.int64) // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal text, joined by commas."""
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(k, l, code, error): indexes as two hex digits a part, and the squared distance to the coded vector."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, apart = _assigned(_matrix(batch["v"], parts * width), books)
            said = [bytes(row).hex() for row in codes.astype(np.uint8)]
            yield pa.record_batch([batch["k"], batch["l"], pa.array(said, pa.string()), pa.array(apart.sum(axis=1))], names=["k", "l", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, f"k {kinds['k']}, l {kinds['l']}, code string, error bigint")


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each kept row; at most 256 entries, as a code has a byte a part.

    Totals of labels are written before their join, so that Spark broadcasts them only if they are small, and can split a label
    that very many rows have if they are not.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept, dim = kept_vectors(rows, key, vector, label, scale)
    books = fit(kept, dim, parts, entries, rounds)
    coded = saved(encode(kept, books), "coded")
    totals = saved(coded.groupBy(F.col("l").alias("of")).agg(F.sum("error").alias("label_error")), "totals")
    out = coded.join(totals, F.col("l").eqNullSafe(F.col("of")))
    return out.select(F.col("k").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The query over ``embeddings`` as DuckDB SQL: integer distances as doubles, which are exact below 2**53."""
    steps = [f"""whole as (
  select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
kept as (select row_number() over (order by vec_id nulls last, v) as r, * from whole),
cut as (select r, vec_id, label, p, v[1 + p * len(v) // {parts} : (p + 1) * len(v) // {parts}] as x from kept, (select unnest(range({parts})) as p)),
book0 as (select p, r - 1 as e, x as c from cut where r <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""near{i} as (
  select r, vec_id, label, p, x, min({{'d': list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c), 'e': e}}) as best
  from cut join book{i} using (p) group by all)""")
        if i < rounds:
            steps.append(f"""means{i} as (
  select p, e, list(m order by i) as c from (
    select p, best.e as e, i, floor(sum(x[i]) / count(*)) as m from near{i}, (select unnest(range(1, 1 + (select max(len(x)) from cut))) as i) group by all) group by all),
book{i + 1} as (select p, e, coalesce(means{i}.c, book{i}.c) as c from book{i} left join means{i} using (p, e))""")
    return "with " + ",\n".join(steps) + f""",
said as (select sha256(string_agg(array_to_string(list_transform(c, lambda y: y::bigint::varchar), ','), ',' order by p, e)) as digest from book{rounds}),
coded as (select r, vec_id, label, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' order by p) as code, sum(best.d)::bigint as error from near{rounds} group by all)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256 from coded, said"""
