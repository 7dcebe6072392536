"""Links in a region that is wider than the reach of the first sweep."""

from __future__ import annotations

import numpy as np

from vesper.llm import near_dedup
from vesper.llm._session import ship

from .test_operators import prose


def test_a_pair_five_standard_errors_off_is_confirmed_in_wide_sweeps(spark):
    """The pair's signatures agree on 161 of 256 values, its sets are equal; ten others stand between them in the one tree where they meet."""
    ship(spark)
    rng = np.random.default_rng(3)
    signs = rng.integers(0, 1 << 16, (12, near_dedup.VALUES)).astype(np.uint16)
    signs[:, :4] = 7 << 8 | 7
    signs[1, 128:] = signs[0, 128:]
    signs[1, 8 : 8 + 4 * 29 : 4] = signs[0, 8 : 8 + 4 * 29 : 4]
    signs[:, 4] = [0, 65_000, *range(3_000, 63_000, 6_000)]
    agree = int((signs[0] >> 8 == signs[1] >> 8).sum())
    assert 0.75 - 0.14 < agree / near_dedup.VALUES < 0.75 - 0.095
    texts = [prose(1, 40), prose(1, 40), *[prose(10 + i, 40) for i in range(10)]]
    classes = spark.createDataFrame([(i, i, i, i, 36, 1, bytearray(s.astype(">u2").tobytes()), i) for i, s in enumerate(signs)], "h bigint, l bigint, least bigint, t bigint, n bigint, members bigint, signature binary, node bigint")
    rows = spark.createDataFrame(list(zip(range(12), texts, range(12))), "key bigint, text string, t bigint")
    found = near_dedup.linked_components(classes, rows, 4, 75, 0.75)
    assert {r["node"]: r["component"] for r in found.collect()} == {0: 0, 1: 0}
