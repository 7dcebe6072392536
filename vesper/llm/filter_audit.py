"""What each order of a set of quality filters keeps, removes and loses, from one pass over the documents.

A document's failed filters are the bits of a mask, and all that any order of the filters does to it follows from its mask. So the
documents become histograms over masks: for each part one row of all documents and one for each label, 2**n counts wide. These rows
are stacked and multiplied by integer incidence matrices with a row for each mask and a column for each (order, step): kept,
removed, removed before although it would fail here, and failing here alone. With five filters those are 32-by-600 matrices.

The filters read a text once, in built-in functions; what goes on is a row of some 60 bytes: key, part, mask and a digest of the
text. Repeats are found by digest (SHA-256): the smallest key of each text that several keys have is a table, written before its
join, so that Spark can split a text with very many copies. Labels are joined by key, likewise. Histograms combine on the map side
to a row for each part and mask, and the product runs over batches of parts.

Defined results: a null text is empty, a null part the empty string. Rows with a null key have no labels, repeat nothing and make no
other a repeat. Rows that repeat key and text count as often as they stand there, and none of them is a repeat of the other. Where
labels repeat a key, one that says 1 is enough. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import saved, ship

SPACE = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDEFG"


def text_filters(text: Column, least: int = 50, distinct: int = 65, capitals: int = 5) -> list[Column]:
    """Whether a text fails: too few words, too few of them distinct, too many capitals, a symbol of markup or code."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    few = F.size(words) < least
    repeated = 100 * F.size(F.array_distinct(words)).cast("long") < distinct * F.size(words).cast("long")
    loud = 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") > capitals * F.length(t).cast("long")
    return [few, repeated, loud, t.rlike(r"[#$%&*|]")]


def incidence(filters: int) -> tuple[list[tuple[int, ...]], np.ndarray, dict[str, np.ndarray]]:
    """(orders, each column's filter, matrices of 2**filters rows and filters! * filters columns by outcome)."""
    orders = list(permutations(range(filters)))
    steps = np.array(orders, dtype=np.int64)
    before = np.cumsum(1 << steps, axis=1) - (1 << steps)
    which, before, masks = steps.ravel(), before.ravel(), np.arange(1 << filters)[:, None]
    fails, gone = (masks >> which & 1).astype(bool), (masks & before) > 0
    made = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == 1 << which}
    return orders, which, {k: m.astype(np.int64) for k, m in made.items()}


def histograms(docs: DataFrame, key: str, part: Column, failed: list[Column], text: Column | None = None, labels: DataFrame | None = None, held: tuple[Column, ...] = ()) -> DataFrame:
    """(part, masks of (mask, n and a count for each label)): a row for each part.

    ``failed`` are the conditions of a document by itself; with ``text``, being a repeat of a smaller key's text is the last one.
    ``labels`` has a column of the key's name; ``held`` are conditions over its rows, each a label.
    """
    ship(docs.sparkSession)
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))
    digest = F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)) if text is not None else F.lit(None).cast("binary")
    rows = saved(docs.select(F.col(key).alias("k"), F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest")), "masks")
    if text is not None:
        first = rows.groupBy(F.col("digest").alias("of")).agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last")
        rows = rows.join(saved(first, "first"), F.col("digest") == F.col("of"), "left")
        rows = rows.withColumn("mask", F.col("mask") + F.when(F.col("k") > F.col("first"), 1 << len(failed)).otherwise(0))
    rows = rows.select("k", "part", "mask")
    names = [f"n{i}" for i in range(len(held))]
    if labels is not None:
        has = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("of")).agg(*[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in zip(names, held)])
        rows = rows.join(saved(has, "labelled"), F.col("k") == F.col("of"), "left")
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    each = F.struct("mask", F.array("n", *names).alias("counts"))
    return cells.groupBy("part").agg(F.collect_list(each).alias("masks"))  # one entry a mask at most


def audit(parts: DataFrame, filters: int, labels: list[str]) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, one loss for each label, shapley) from ``histograms``.

    ``shapley`` is what a step's filter removes over all orders, at whatever step.
    """
    if not 0 < filters <= len(LETTERS):
        raise ValueError(f"1 to {len(LETTERS)} filters, not {filters}")
    orders, which, matrices = incidence(filters)
    said = ["".join(LETTERS[i] for i in order) for order in orders for _ in order]
    of = [LETTERS[i] for i in which]
    steps = np.tile(np.arange(1, filters + 1, dtype=np.int32), len(orders))
    own = (which[:, None] == np.arange(filters)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 64) for b in batches for at in range(0, len(b), 64)):
            n = len(batch)
            stacked = np.zeros((1 + len(labels), n, 1 << filters), dtype=np.int64)
            for row, masks in enumerate(batch["masks"].to_pylist()):
                for cell in masks:
                    stacked[:, row, cell["mask"]] = cell["counts"]
            out = {k: stacked[0] @ m for k, m in matrices.items()}
            out |= {name: stacked[1 + i] @ matrices["removed"] for i, name in enumerate(labels)}
            out["shapley"] = (out["removed"] @ own)[:, which]
            at = np.repeat(np.arange(n), len(said))
            columns = [batch["part"].take(pa.array(at)), pa.array(said * n), pa.array(np.tile(steps, n)), pa.array(of * n)]
            yield pa.record_batch([*columns, *[pa.array(v.ravel()) for v in out.values()]], names=["part", "filter_order", "step", "filter", *out])

    counts = ", ".join(f"{c} bigint" for c in (*matrices, *labels, "shapley"))
    return parts.mapInArrow(run, f"part string, filter_order string, step int, filter string, {counts}")


def oracle() -> str:
    """The query as DuckDB SQL."""
    return r"""with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
cut as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from texts),
first as (select t, min(doc_id) as least from texts group by t),
failed as (
  select part, coalesce(q.good, 0) as good, coalesce(q.toxic, 0) as toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] as f
  from cut join first using (t)
  left join (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id) q using (doc_id)),
cells as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, f),
five as (select unnest(range(1, 6)) as i),
orders as (
  select a.i as a, b.i as b, c.i as c, d.i as d, e.i as e from five a, five b, five c, five d, five e
  where a.i not in (b.i, c.i, d.i, e.i) and b.i not in (c.i, d.i, e.i) and c.i not in (d.i, e.i) and d.i <> e.i),
steps as (
  select [a, b, c, d, e] as o, 'ABCDE'[a] || 'ABCDE'[b] || 'ABCDE'[c] || 'ABCDE'[d] || 'ABCDE'[e] as filter_order, step from orders, (select unnest(range(1, 6)) as step)),
marked as (
  select part, filter_order, step, o[step] as own, n, good, toxic, f[o[step]] as fails, len(list_filter(o[1:step - 1], lambda i: f[i])) > 0 as gone, len(list_filter(f, lambda x: x)) as many
  from cells, steps),
counted as (
  select part, filter_order, step, 'ABCDE'[own] as filter, coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept, coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed,
    coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant, coalesce(sum(n) filter (fails and many = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (fails and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (fails and not gone), 0)::bigint as toxic_lost
  from marked group by part, filter_order, step, own)
select *, (sum(removed) over (partition by part, filter))::bigint as shapley from counted"""
