"""What the driver does in a superstep of the packing, with as many partitions as a very large table has."""

from __future__ import annotations

import random
import time

from vesper.llm import packing


def test_shares_of_many_partitions():
    rng = random.Random(1)
    waiting = {p: rng.randrange(1, 9) for p in range(20_000) if p % 7}
    left = {p: rng.randrange(1, 9) for p in range(20_000) if p % 3}
    begin = time.perf_counter()
    met = packing.meetings(waiting, left)
    opening, still = packing.shares(waiting, met, 0)
    assert time.perf_counter() - begin < 1
    assert not any(k for _, k in opening) and [p for p, _ in still] == sorted(waiting)
    # a piece takes a gap of an earlier partition only, no gap twice, and its ranks are met from 0 on without holes
    taken, ranks = set(), {p: [] for p in waiting}
    for part, first, n, other, other_first in met:
        assert other < part
        ranks[part] += range(first, first + n)
        gaps = {(other, g) for g in range(other_first, other_first + n)}
        assert not gaps & taken and other_first + n <= left[other]
        taken |= gaps
    assert all(ranks[p] == list(range(b)) and b <= waiting[p] for p, b in still)


def test_shares_where_sequences_are_opened():
    opening, still = packing.shares({0: 3, 2: 4, 5: 1}, [], 5)
    assert opening == [(0, 3), (2, 2), (5, 0)] and still == opening


def test_small_table(spark):
    got = packing._values(spark, [(1, 2), (3, 4)], "p begin")
    assert [tuple(r) for r in got.orderBy("p").collect()] == [(1, 2), (3, 4)]
    none = packing._values(spark, [], "p begin")
    assert none.count() == 0 and none.dtypes == [("p", "bigint"), ("begin", "bigint")]
