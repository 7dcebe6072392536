"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (3 to 5, with its ends) and of itself;
a window of consecutive words is the mean of its words; a linear softmax turns that into two
probabilities. A text scores as its most toxic window, so that length does not thin out what counts.
An unseen misspelling shares most n-grams with the word it hides. Embeddings and softmax are learned
together by minibatch gradient descent, at first on all windows, then on each text's top window.

Defined results: null, empty and wordless texts have the score of an empty window (the bias alone).
Rows without label or key are never fitted on. Without labels of both kinds every score is the rate
of label 1 (0 where there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bytes import ALNUM, LOWER, U64, blocks, give_back, owners, word_hashes, words
from ._session import ship

SIZES = (3, 4, 5)
_CANONICAL = np.where(ALNUM, LOWER, 32).astype(np.uint8)


@dataclass
class Model:
    """What scoring needs: embeddings times softmax weights, one number per bucket, and the bias."""

    weights: np.ndarray
    bias: float
    window: int


def _codes(low: np.ndarray, size: int, bits: int) -> np.ndarray:
    code = np.zeros(len(low) - size + 1, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for j in range(size):
            code *= np.uint32(16777619)
            code += low[j : len(low) - size + 1 + j]
        code ^= code >> np.uint32(15)
        code *= np.uint32(2246822519)
    return code >> np.uint32(32 - bits)


def _lowered(strings: list) -> list[bytes]:
    return [b"" if s is None else s.lower().encode() for s in strings]


def _features(data: np.ndarray, bits: int):
    """Of a block: word starts and ends; per gram size (codes at each byte, first and last + 1 place of each word); the words' own codes."""
    low = _CANONICAL[data]
    starts, ends = words(low, ALNUM)
    grams = []
    for n in SIZES:
        a, b = starts - 1, np.maximum(ends + 2 - n, starts - 1)
        grams.append((_codes(low.astype(np.uint32), n, bits) if len(low) >= n else np.zeros(0, np.uint32), a, b))
    own = (word_hashes(low, starts, ends) >> U64(64 - bits)).astype(np.uint32)
    return starts, ends, grams, own


def _word_scores(data: np.ndarray, weights: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    starts, _, grams, own = _features(data, bits)
    total, count = weights[own].astype(np.float64), np.ones(len(own))
    for codes, a, b in grams:
        sums = np.concatenate([[0.0], np.cumsum(weights[codes], dtype=np.float64)])
        b = np.minimum(b, len(codes))
        a = np.minimum(a, b)
        total += sums[b] - sums[a]
        count += b - a
    return starts, total / count


def _window_max(values: np.ndarray, size: int) -> float:
    """The largest mean of windows of ``size`` values that overlap by half; what remains makes a shorter one only where it is all there is."""
    if not len(values):
        return 0.0
    if len(values) <= size:
        return float(values.sum() / max(len(values), size / 4))
    sums = np.concatenate([[0.0], np.cumsum(values)])
    at = np.append(np.arange(0, len(values) - size, size // 2), len(values) - size)
    return float(((sums[at + size] - sums[at]) / size).max())


def _bags(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For the fit: feature codes of all words one after the other, and how many each word has."""
    (_, _, data, bounds), *_ = blocks([text])
    starts, _, grams, own = _features(data, bits)
    columns, lengths = [own], [np.ones(len(own), np.int64)]
    order = [np.arange(len(own))]
    for codes, a, b in grams:
        b = np.minimum(b, len(codes))
        n = np.maximum(b - np.minimum(a, b), 0)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        columns.append(codes[place])
        lengths.append(n)
        order.append(np.repeat(np.arange(len(own)), n))
    by = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(columns)[by], np.sum(lengths, axis=0)


def fit(
    df: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    *,
    max_rows: int = 2400,
    bits: int = 16,
    dim: int = 8,
    window: int = 32,
    epochs: int = 30,
    seed: int = 11,
) -> Model:
    """Fit on at most ``max_rows`` labelled texts, whole, a third of them of label 1 where there are as many.

    Where rows of a key contradict each other, label 1 holds. The bound is on this fit alone. Rows are drawn from ``labels`` by key hash, so only a bounded
    list of keys is broadcast to the scan of ``df``; the driver gets feature codes, not texts.
    """
    ship(df.sparkSession)
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return Model(np.zeros(1 << bits, np.float32), float(np.log((rate or 1e-6) / max(1 - rate, 1e-6))), window)
    ones = min(sizes[1], max_rows // 3)
    wanted = {1: ones, 0: min(sizes[0], max_rows - ones)}
    h = F.pmod(F.xxhash64("k"), F.lit(1 << 20))
    share = F.when(F.col("y") == 1, F.lit((2 * wanted[1] + 50) / sizes[1])).otherwise(F.lit((2 * wanted[0] + 50) / sizes[0]))
    drawn = rows.where(h < share * (1 << 20)).withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("k"), "k")))
    drawn = drawn.where(F.col("r") <= F.when(F.col("y") == 1, wanted[1]).otherwise(wanted[0])).select("k", "y")  # at most max_rows

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_bags(t, bits) for t in _lowered(batch["t"].to_pylist())]
            yield pa.record_batch([batch["k"].cast(pa.string()), batch["y"], pa.array([c.astype(np.uint32).tobytes() for c, _ in got], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in got], pa.binary())], names=["k", "y", "codes", "sizes"])

    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(drawn), "k").select("k", "y", "t")
    got = texts.mapInArrow(bags, "k string, y int, codes binary, sizes binary").collect()
    got.sort(key=lambda r: (r["k"], bytes(r["codes"])))
    got = [r for r in got if len(r["sizes"])]
    if len({r["y"] for r in got}) < 2:
        return Model(np.zeros(1 << bits, np.float32), float(np.log((rate or 1e-6) / max(1 - rate, 1e-6))), window)
    weights, bias = _train(got, rate, bits, dim, window, epochs, seed)
    del got
    give_back()
    return Model(weights, bias, window)


def _train(got: list, rate: float, bits: int, dim: int, window: int, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(seed)
    codes = np.concatenate([np.frombuffer(r["codes"], np.uint32) for r in got])
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint32) for r in got]).astype(np.int64)
    lengths = np.array([len(r["sizes"]) // 4 for r in got])
    assert sizes.sum() == len(codes)
    y = np.array([r["y"] for r in got], dtype=np.float64)
    word_at = np.concatenate([[0], np.cumsum(sizes)])  # of each word, its first code
    # windows one after the other: owner text, first word, words
    owner = np.repeat(np.arange(len(got)), -(-lengths // window))
    first_word = np.concatenate([np.arange(0, n, window) for n in lengths]) + np.repeat(np.cumsum(lengths) - lengths, -(-lengths // window))
    last_word = np.minimum(first_word + window, np.cumsum(lengths)[owner])
    e = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.log(np.array([1 - y.mean(), y.mean()])).astype(np.float32)
    seen_e = np.full(len(e), 1e-6, np.float32)
    seen_w, seen_b = np.full_like(w, 1e-6), np.full(2, 1e-6, np.float32)

    def spread(chosen: np.ndarray):
        """Codes of the chosen windows, the place in the batch of each, and its weight in the window's mean."""
        n = last_word[chosen] - first_word[chosen]
        w_at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_word[chosen], n)
        slot = np.repeat(np.arange(len(chosen)), n)
        k = sizes[w_at]
        c_at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(word_at[w_at], k)
        share = np.repeat(1.0 / (k * np.maximum(n, window / 4)[slot]), k).astype(np.float32)
        return codes[c_at], np.repeat(slot, k), share

    def step(chosen: np.ndarray, target: np.ndarray, rate_: float) -> None:
        nonlocal w, bias
        ids, slot, share = spread(chosen)
        v = np.stack([np.bincount(slot, e[ids, j] * share, len(chosen)) for j in range(dim)], axis=1).astype(np.float32)
        z = v @ w + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(chosen)), target] -= 1
        gw, gb = v.T @ p / len(chosen) + 1e-5 * w, p.mean(axis=0)
        gv = (p @ w.T).astype(np.float32)
        used, back = np.unique(ids, return_inverse=True)
        ge = np.stack([np.bincount(back, gv[slot, j] * share, len(used)) for j in range(dim)], axis=1).astype(np.float32)
        seen_e[used] += (ge * ge).mean(axis=1)
        e[used] -= rate_ * ge / np.sqrt(seen_e[used])[:, None]
        seen_w[:] += gw * gw
        seen_b[:] += gb * gb
        w -= rate_ * gw / np.sqrt(seen_w)
        bias -= rate_ * gb / np.sqrt(seen_b)

    labels = y.astype(np.int64)
    batch = int(np.clip(len(got) // 32, 8, 128))
    every = np.arange(len(owner))
    starts = np.searchsorted(owner, np.arange(len(got)))
    for epoch in range(epochs):
        if epoch < 2:
            chosen = rng.permutation(every)
        else:
            s = e @ (w[:, 1] - w[:, 0])
            by_word = np.add.reduceat(s[codes], word_at[:-1]) / sizes
            total = np.concatenate([[0.0], np.cumsum(by_word)])
            mean = (total[last_word] - total[first_word]) / np.maximum(last_word - first_word, window / 4)
            best = np.lexsort((-mean, owner))
            chosen = rng.permutation(best[starts])
        for part in np.array_split(chosen, max(1, len(chosen) // batch)):
            step(part, labels[owner[part]], 0.1 / (1 + epoch / 10))
    shift = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)) - np.log(y.mean() / (1 - y.mean()))  # back to the labels' own rate
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(bias[1] - bias[0] + shift)


def score(df: DataFrame, model: Model, text: Column | str = "text", output: str = "score") -> DataFrame:
    """Add ``output``: the probability of label 1, from 0 to 1, of every row."""
    from pyspark.sql.functions import arrow_udf

    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        bits = int(len(m.weights)).bit_length() - 1
        for column in batches:
            out = []
            for _, _, data, bounds in blocks(_lowered(column.to_pylist())):
                starts, values = _word_scores(data, m.weights, bits)
                first = owners(starts, bounds)
                out += [_window_max(values[a:b], m.window) for a, b in zip(first[:-1], first[1:])]
            z = np.clip(np.array(out, dtype=np.float64) + m.bias, -30, 30)
            yield pa.array(1 / (1 + np.exp(-z)), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(output, arrow_udf(run, "double")(F.col(text) if isinstance(text, str) else text))
