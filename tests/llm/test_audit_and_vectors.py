"""Filter interactions, vector codes and near-duplicate vectors against plain versions, on odd rows and dense groups."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vesper.llm import filter_audit, queries, vector_codes, vector_dedup

from .test_operators import ODD, prose, table

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id bigint, embedding array<float>, label int, v int, k int, c int, list int, dim int, h int"


def vectors(spark, rows):
    """(key, vector, label) with columns of names that the operators use inside."""
    return spark.createDataFrame([(k, v, label, 1, 2, 3, 4, 5, 6) for k, v, label in rows], VECTORS)


# ---- filters


def masks(docs):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, _, source in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        yield source or "", i, [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]


def plain_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if x[at] == 1} - {None} for at in (0, 1))
    out = Counter()
    parts = {s or "" for *_, s in docs}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in parts:
        for order in orders:
            for step in range(1, 6):
                for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
                    out[part, order, step, name] = 0
    for part, i, f in masks(docs):
        fails = {x for x, y in zip("ABCDE", f) if y}
        for order in orders:
            for step, own in enumerate(order, 1):
                gone, hit = bool(fails & set(order[: step - 1])), own in fails
                out[part, order, step, "kept"] += not gone and not hit
                out[part, order, step, "removed"] += hit and not gone
                out[part, order, step, "redundant"] += hit and gone
                out[part, order, step, "unique_fails"] += fails == {own}
                out[part, order, step, "good_lost"] += hit and not gone and i in good
                out[part, order, step, "toxic_lost"] += hit and not gone and i in toxic
    for part in parts:
        total = Counter()
        for order in orders:
            for step, own in enumerate(order, 1):
                total[own] += out[part, order, step, "removed"]
        for order in orders:
            for step, own in enumerate(order, 1):
                out[part, order, step, "shapley"] = total[own]
    return dict(out)


def test_filter_audit_equals_a_plain_version(spark):
    r = random.Random(3)
    made = [(100 + i, r.choice([prose(i, 60), prose(i, 60) + " A|B", "word " * 70, prose(i % 3, 55).upper(), "short & odd", None, ""]), "en", r.choice(["a", "b", None, ""])) for i in range(120)]
    docs = [*ODD, *made, *made[:7], (50, made[0][1], "en", "b"), (None, made[0][1], "en", "b"), (9, "zero\x00width space " * 60, "en", "c")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(90, 180)] + [(101, 1, 1), (101, 0, 0), (None, 1, 1), (5, 1, 0)]
    text = F.col("text")
    parts = filter_audit.histograms(table(spark, docs), "doc_id", F.col("source"), filter_audit.text_filters(text), text, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), (F.col("quality") == 1, F.col("toxic") == 1))
    got = filter_audit.audit(parts, 5, ["good_lost", "toxic_lost"]).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(x["part"], x["filter_order"], x["step"], n): x[n] for x in got for n in names} == plain_audit(docs, labels)
    assert len(got) == 600 * len({s or "" for *_, s in docs}) and all(x["filter"] == x["filter_order"][x["step"] - 1] for x in got)


def test_filter_audit_of_other_filters(spark):
    rows = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("g"))
    parts = filter_audit.histograms(rows, "id", F.col("g"), [F.col("id") < 4, F.col("id") % 3 == 0])
    got = {(x["part"], x["filter_order"], x["step"]): (x["kept"], x["removed"], x["redundant"], x["unique_fails"]) for x in filter_audit.audit(parts, 2, []).collect()}
    assert got["0", "AB", 1] == (3, 2, 0, 1) and got["0", "AB", 2] == (2, 1, 1, 1) and got["1", "BA", 2] == (2, 1, 1, 1)
    assert filter_audit.histograms(rows.where("false"), "id", F.col("g"), [F.col("id") < 4]).collect() == []
    with pytest.raises(ValueError):
        filter_audit.audit(parts, 8, [])


# ---- codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    whole = [(k, v, label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, v, _ in whole)
    dim = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 0
    cut = lambda v: [tuple(math.floor(1024 * float(np.float32(x))) for x in v)[p * dim // parts : (p + 1) * dim // parts] for p in range(parts)]
    kept = sorted([(k is None, k or 0, cut(v), label) for k, v, label in whole if len(v) == dim], key=lambda x: (x[0], x[1], x[2]))
    books = [[x[2][p] for x in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    nearest = lambda x: [min((far(x[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        found = [nearest(x[2]) for x in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                if mine := [x[2][p] for x, f in zip(kept, found) if f[p][1] == e]:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    digest = sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = [(None if x[0] else x[1], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), x[3]) for x in kept for f in [nearest(x[2])]]
    total = Counter()
    for _, _, error, label in out:
        total[label] += error
    return sorted(((k, c, e, total[label], digest) for k, c, e, label in out), key=str)


def test_codes_equal_a_plain_version(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.25, 0.1, r.uniform(-1, 1)]) for _ in range(8)], r.choice([0, 1, None])) for i in range(60)]
    rows += [rows[3], (3, rows[4][1], 0), (None, rows[5][1], None), (70, None, 1), (71, [], 1), (72, [0.5] * 4, 1), (73, [None] + [0.1] * 7, 1), (74, [NAN] * 8, 1), (75, [INF] * 8, 1), (76, [0.0] * 8, 1), (77, [-0.0] * 8, None)]
    for entries in (256, 16):
        got = vector_codes.compress(vectors(spark, rows), entries=entries).collect()
        assert sorted((tuple(x) for x in got), key=str) == plain_codes(rows, entries=entries)


def test_codes_of_nothing_and_of_what_does_not_fit(spark):
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, [1.0] * 8, 1)]).where("false")).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(vectors(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(vectors(spark, [(1, [1e20] * 8, 1)]))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 3, 1000, (1 << 24) - 1]), st.integers(1, 40), st.integers(1, 24))
def test_screening_never_loses_the_best_entry(seed, size, entries, width):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-size, size + 1, (entries, width)), rng.integers(-size, size + 1, (30, width))
    book[entries // 2] = book[0]
    x[: min(entries, 10)] = book[: min(entries, 10)] + rng.integers(-1, 2, (min(entries, 10), width))
    codes, apart = vector_codes.nearest(x, book)
    exact = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (codes == exact.argmin(axis=1)).all() and (apart == exact.min(axis=1)).all()


# ---- near-duplicate vectors


def plain_links(rows, least=0.9):
    """n_links and component of each row, by all pairs."""
    whole = [i for i, (_, v, _) in enumerate(rows) if v is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dim = Counter(len(rows[i][1]) for i in whole).most_common(1)[0][0]
    whole = [i for i in whole if len(rows[i][1]) == dim]
    x = np.array([rows[i][1] for i in whole], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= least
    np.fill_diagonal(linked, False)
    links, component = [0] * len(rows), [k for k, *_ in rows]
    seen = set()
    for at in range(len(whole)):
        links[whole[at]] = int(linked[at].sum())
        if at not in seen:
            group, todo = {at}, [at]
            while todo:
                for b in np.flatnonzero(linked[todo.pop()]).tolist():
                    if b not in group:
                        group.add(b)
                        todo.append(b)
            seen |= group
            keys = [rows[whole[b]][0] for b in group if rows[whole[b]][0] is not None]
            for b in group:
                component[whole[b]] = min(keys, default=None)
    return sorted(zip([k for k, *_ in rows], links, component), key=str)


def planted(seed, n, dim, cosines):
    """Random unit vectors, each with a partner of the given cosine."""
    rng = np.random.default_rng(seed)
    q, w = rng.normal(size=(2, n, dim))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    w -= (w * q).sum(axis=1, keepdims=True) * q
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    s = np.resize(np.asarray(cosines), n)[:, None]
    return q, s * q + np.sqrt(1 - s * s) * w


def test_linked_vectors_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    q, y = planted(1, 120, 16, [0.91, 0.95, 0.99])
    dense = q[0] + rng.normal(0, 0.06, (90, 16))
    chain = [[math.cos(0.4 * i), math.sin(0.4 * i)] + [0.0] * 14 for i in range(6)]
    rows = [(1000 + i, v.tolist(), 0) for i, v in enumerate([*q, *y, *dense, *map(np.array, chain)])]
    rows += [rows[5], rows[5], (3, rows[6][1], 1), (3, rows[130][1], 1), (None, rows[7][1], 1), (None, (3 * q[8]).tolist(), 1), (1, None, 1), (2, [0.0] * 16, 1), (2, [0.0] * 16, 1), (4, [NAN] * 16, 1), (6, [None] * 16, 1), (7, [], 1), (8, [1.0] * 5, 1), (9, (1e-30 * q[9]).tolist(), 1), (10, (1e30 * q[9]).tolist(), 1)]
    got = vector_dedup.near_duplicates(vectors(spark, rows), margin=2.0).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain_links(rows)


@pytest.mark.parametrize("level", [1024, 8])
def test_recall_of_links_with_few_lists_visited(spark, monkeypatch, level):
    monkeypatch.setattr(vector_dedup, "LEVEL", level)
    q, y = planted(7, 2000, 64, [0.91, 0.93, 0.95, 0.98])
    rows = [(i, v.tolist(), 0) for i, v in enumerate([*q, *y])]
    got = {x["vec_id"]: x for x in vector_dedup.near_duplicates(vectors(spark, rows)).collect()}
    want = plain_links(rows)
    found = sum(x["n_links"] for x in got.values())
    assert all(got[k]["n_links"] <= n for k, n, _ in want) and found >= 0.95 * sum(n for _, n, _ in want)


def test_no_vector_and_queries(spark):
    assert vector_dedup.near_duplicates(vectors(spark, [(1, None, 1)])).collect() == [(1, 0, 1)]
    assert vector_dedup.near_duplicates(vectors(spark, [(1, None, 1)]).where("false")).collect() == []
    assert vector_dedup.near_duplicates(vectors(spark, [(1, [0.0, 2.0], 1)])).collect() == [(1, 0, 1)]
    assert {"op11_filter_interactions", "op12_vector_codes", "op13_embedding_near_dedup"} <= queries.queries().keys() & queries.oracle_sql().keys()


def test_no_pair_at_the_threshold_is_left_out(spark, monkeypatch):
    """Pairs of random directions just over the threshold, with lists of a few vectors each."""
    monkeypatch.setattr(vector_dedup, "LIST", 8)
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    rng = np.random.default_rng(11)
    x, off = rng.standard_normal((2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    y = 0.903 * x + math.sqrt(1 - 0.903**2) * off
    got = vector_dedup.near_duplicates(vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))])).collect()
    assert {(r["vec_id"], r["n_links"], r["component"]) for r in got} == {(i, 1, i % 400) for i in range(800)}


def test_pairs_come_in_small_parts_and_few_are_looked_up(monkeypatch):
    """A dense group within random vectors: all pairs at the threshold, no more at once than asked; random pairs end at the bound of prefixes."""
    monkeypatch.setattr(vector_dedup, "PAIRS", 500)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 64))
    x[:60] = x[0] + rng.normal(0, 0.05, (60, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = list(vector_dedup._linked(vector_dedup.fit_index(x, len(x), 1), 0, x, x, 0.9))
    assert max(len(a) for a, _ in parts) <= 500
    assert sorted((i, k) for a, b in parts for i, k in zip(a.tolist(), b.tolist())) == sorted(map(tuple, np.argwhere(x @ x.T >= 0.9).tolist()))
    one = vector_dedup._prefixes(x, vector_dedup._turn(64))
    assert (one[60:] @ one[60:].T >= 0.9 - vector_dedup.SLACK).mean() < 0.01
    assert (one @ one.T >= x @ x.T - vector_dedup.SLACK).all()
