"""Tree ensembles over one binned table: many fits at once, histograms summed by Spark.

All fits (targets, folds, settings) share one table: a row has its features as bins of a byte each, and a role in each label set
(label 0 or 1 where it trains, else asked or left out). A pass adds up, for every leaf of every fit that has to be looked at, the
rows, gradients and hessians by feature and bin; Spark sums the tasks' histograms by blocks of features, a task a block finds
the best split there, and the driver gets a row for each block and leaf. So a pass serves all fits, no fit copies rows, and no task
or driver holds more than histograms of a block. Fits go on at their own pace; histograms of a pass are bounded (``PASS_BYTES``),
further ones wait for the next job.

Gradients and hessians are rounded to multiples of 2**-30 and summed as integers, so sums don't depend on the order or number of
partitions, nor on a task that runs again: the same rows give the same trees.

Ways to grow a tree: ``leaf`` splits the leaf of the greatest gain until there are enough; ``level`` splits all leaves of a level;
``same`` splits all of a level at one common feature and cut. Trees of two further ways are averaged instead of boosted, and draw some
features a node: ``random`` draws a cut within each one's range there, ``forest`` takes the best cut, each tree over its own sample.
A row stands in a forest's sample as many times as a Poisson draw by its hash says, which is what drawing with replacement
comes to in a large table; balanced classes weigh the same within each sample. Rows of a leaf are counted once however often drawn.

Ordered boosting (``ordered``) keeps a row's own label out of the values that it learns from: a permutation by hash falls into
segments, each as long as all before it, and the margin that a row is trained with adds the values that its leaves have by the
rows of earlier segments alone. Rows that are asked get the values of all rows.

Cuts lie half-way between values where a feature has no more values than bins, else at approximate quantiles; they are the same for
all fits, and labels have no part in them. Missing values are the caller's to fill. A label set of one class is that class's
constant, one without a training row has null. Values at a cut go left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cluster import ship_code
from ..sources.sinks import materialised

SCALE = float(1 << 30)
BINS = 255
BLOCK = 64
PASS_BYTES = 256 << 20
#: Boosted trees after which margins are written anew, so that a pass doesn't evaluate all trees before it.
PENDING = 16
#: Segments of a permutation in ordered boosting.
SEGMENTS = 6
ASKED, LEFT_OUT = 2, 3


@dataclass(frozen=True)
class Ensemble:
    """Settings of an ensemble; limits of 0 are none, shares are drawn for each tree."""

    rounds: int
    rate: float = 1.0
    leaves: int = 0
    depth: int = 0
    l1: float = 0.0
    l2: float = 0.0
    min_rows: int = 1
    min_hessian: float = 1e-3
    columns: float = 1.0
    rows: float = 1.0
    grow: str = "leaf"
    from_odds: bool = True
    balanced: bool = False
    ordered: bool = False

    @property
    def averaged(self) -> bool:
        return self.grow in ("random", "forest")


@dataclass(frozen=True)
class Fit:
    """An ensemble over a label set (its place in ``roles``) and some features (all if None)."""

    role: int
    settings: Ensemble
    columns: tuple[int, ...] | None = None
    seed: int = 0


@dataclass
class Tree:
    """Nodes as lists: the feature and cut of inner nodes (-1: a leaf), the left child, whose neighbour is the right one, and values."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    #: Values by leaf and segment for training rows, if they are ordered.
    prefix: np.ndarray | None = None

    def split(self, node: int, feature: int, cut: int) -> int:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, at
        for x, new in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, 0.0)):
            x.extend([new, new])
        return at

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left = (np.array(x, dtype=np.int64) for x in (self.feature, self.cut, self.left))
        node = np.zeros(len(bins), dtype=np.int64)
        inner = np.flatnonzero(feature[node] >= 0)
        while len(inner):
            at = node[inner]
            node[inner] = left[at] + (bins[inner, feature[at]] > cut[at])
            inner = inner[feature[node[inner]] >= 0]
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]

    def trained(self, bins: np.ndarray, segment: np.ndarray | None) -> np.ndarray:
        """What the tree adds to the margins of training rows."""
        return self.values(bins) if self.prefix is None else self.prefix[self.leaf_of(bins), segment]


# ---- the binned table


def cuts_of(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """The cuts of each feature, ascending: bin b holds what is over cut b - 1 and not over cut b."""
    cells = rows.select(F.posexplode("x").alias("i", "v"))
    shares = [k / bins for k in range(1, bins)]
    seen = cells.groupBy("i").agg(F.approx_count_distinct("v").alias("n"), F.percentile_approx("v", shares, 20 * bins).alias("q"), F.max("v").alias("top")).collect()  # a row a feature
    few = {r["i"] for r in seen if r["n"] <= 2 * bins}
    values = {}
    if few:
        own = cells if len(few) == len(seen) else cells.where(F.col("i").isin(list(few)))
        values = {r["i"]: sorted(r["all"]) for r in own.groupBy("i").agg(F.collect_set("v").alias("all")).collect()}  # some twice ``bins`` values a feature
    out = [np.zeros(0)] * (1 + max((r["i"] for r in seen), default=-1))
    for r in seen:
        v = np.array(values.get(r["i"], []))
        out[r["i"]] = (v[1:] + v[:-1]) / 2 if 0 < len(v) <= bins else np.array(sorted({q for q in r["q"] if q < r["top"]}))
    return out


def binned(rows: DataFrame, cuts: list[np.ndarray], roles: int) -> DataFrame:
    """(row_id, salt, bins, roles, margins): bins and roles a byte each, margins of as many fits as there are roles at 0 until set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(cuts))
            codes = np.column_stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)] or [np.zeros((len(batch), 0))]).astype(np.uint8)
            of = batch["roles"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), roles).astype(np.uint8)
            yield pa.record_batch([batch["row_id"], batch["salt"], pa.array(map(bytes, codes), pa.binary()), pa.array(map(bytes, of), pa.binary())], names=["row_id", "salt", "bins", "roles"])

    kind = dict(rows.dtypes)["row_id"]
    return rows.select("row_id", F.xxhash64("row_id").alias("salt"), F.col("x").cast("array<double>").alias("x"), F.col("roles").cast("array<int>").alias("roles")).mapInArrow(run, f"row_id {kind}, salt bigint, bins binary, roles binary")


def _bytes(column: pa.Array, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _drawn_by_hash(salt: np.ndarray, *of: int) -> np.ndarray:
    """A number from 0 to under 1 for each row, the same for the same row and ``of``."""
    with np.errstate(over="ignore"):
        x = salt.astype(np.uint64) ^ np.random.default_rng(of).integers(0, 1 << 63, dtype=np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _segments(salt: np.ndarray, fit: Fit, at: int) -> np.ndarray:
    """A row's segment in the fit's permutation: the last one has half of the rows, the one before a quarter, and so on."""
    place = np.maximum(_drawn_by_hash(salt, fit.seed, at, 1), 2.0**-SEGMENTS)
    return np.maximum(SEGMENTS + np.floor(np.log2(place)).astype(np.int64), 0)


#: Shares of rows that a sample has no more than 0, 1, 2, ... times.
_TIMES = np.cumsum([np.exp(-1) / factorial(k) for k in range(16)])


def _times(salt: np.ndarray, r: Run) -> np.ndarray:
    """How often each row stands in the sample of a forest's tree."""
    return np.searchsorted(_TIMES, _drawn_by_hash(salt, r.fit.seed, r.at, r.number, 2), side="right")


# ---- growing


class Run:
    """One growing tree of a fit: of a boosted one after the other, of an averaged one each by itself."""

    def __init__(self, at: int, fit: Fit, number: int, width: int, weights: tuple[float, float]):
        self.at, self.fit, self.number, self.weights = at, fit, number, weights
        self.allowed = np.arange(width) if fit.columns is None else np.array(fit.columns, dtype=np.int64)
        self.begin()

    def begin(self) -> None:
        self.tree, self.known, self.best, self.deep, self.need = Tree(), {}, {}, {0: 0}, [0]
        #: Once a tree that is ordered has grown: sums by leaf and segment.
        self.by_segment: dict[tuple[int, int], tuple] | None = None

    def columns(self, node: int) -> np.ndarray:
        if self.by_segment is not None:
            return np.zeros(1, dtype=np.int64)
        s, n = self.fit.settings, len(self.allowed)
        drawn = max(1, int(n**0.5)) if s.averaged else max(1, int(s.columns * n))
        if drawn >= n:
            return self.allowed
        key = [self.fit.seed, self.at, self.number] + ([node] if s.averaged else [])
        return np.sort(np.random.default_rng(key).choice(self.allowed, drawn, replace=False))

    def take(self, node: int, found: tuple) -> None:
        """(gain, feature, cut, then rows, gradients and hessians of the node and of its left child)."""
        if self.by_segment is not None:
            self.by_segment[node, found[2]] = found[3:6]
            return
        self.best[node] = found
        self.known[node] = found[3:6]

    def _split(self, node: int) -> list[int]:
        _, feature, cut, *sums = self.best.pop(node)
        left = self.tree.split(node, feature, cut)
        self.known[left], self.known[left + 1] = tuple(sums[3:]), tuple(a - b for a, b in zip(sums[:3], sums[3:]))
        self.deep[left] = self.deep[left + 1] = self.deep[node] + 1
        return [left, left + 1]

    def grow(self) -> bool:
        """Split as far as is known; whether the tree is complete. ``need`` has the leaves to look at next."""
        s, self.need = self.fit.settings, []
        if self.by_segment is not None:
            self.tree.prefix = np.zeros((len(self.tree.feature), SEGMENTS))
            for node in range(len(self.tree.feature)):
                g = h = 0
                for segment in range(SEGMENTS):
                    self.tree.prefix[node, segment] = self._value(g, h)
                    _, more_g, more_h = self.by_segment.get((node, segment), (0, 0, 0))
                    g, h = g + more_g, h + more_h
            return True
        least = -np.inf if s.averaged else 1e-9
        deep_enough = lambda n: bool(s.depth) and self.deep[n] >= s.depth
        open_ = lambda n: not deep_enough(n) and self.known[n][0] >= 2 * s.min_rows and (not s.averaged or 0 < self.known[n][1] < self.known[n][2])
        while not self.need:
            ready = [n for n, b in sorted(self.best.items()) if b[0] > least and not deep_enough(n) and (s.grow == "same" or open_(n))]
            if not ready or (s.leaves and (len(self.tree.feature) + 1) // 2 >= s.leaves):
                break
            if s.grow == "leaf":
                ready = [max(ready, key=lambda n: (self.best[n][0], -n))]
            made = [c for n in ready for c in self._split(n)]
            if not (s.leaves and (len(self.tree.feature) + 1) // 2 >= s.leaves):
                self.need = [c for c in made if (not deep_enough(c) if s.grow == "same" else open_(c))]
        if self.need:
            return False
        leaves = [n for n in self.known if self.tree.feature[n] < 0]
        for node in leaves:
            self.tree.value[node] = self._value(*self.known[node][1:])
        if s.ordered:
            self.by_segment, self.need = {}, leaves
        return not s.ordered

    def weighed(self, g, h):
        """Sums of a forest's sample with its classes weighed alike: those of ones and zeros in the whole tree divide them."""
        if self.fit.settings.grow != "forest" or not self.fit.settings.balanced:
            return g, h
        _, ones, every = self.known.get(0, (0, 0, 0))
        if not 0 < ones < every:
            return g, h
        one, zero = every / (2 * ones), every / (2 * (every - ones))
        return one * g, one * g + zero * (h - g)

    def _value(self, g: int, h: int) -> float:
        s = self.fit.settings
        if s.averaged:
            g, h = self.weighed(g, h)
            return g / h if h else 0.0
        return -s.rate * float(_drawn(np.float64(g / SCALE), s.l1)) / (h / SCALE + s.l2) if h or s.l2 else 0.0


def _drawn(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0) if l1 else g


def _score(s: Ensemble, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What a leaf of these sums is worth: the second-order gain, or the purity of a weighted share."""
    g, h = g / SCALE, h / SCALE
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = (g * g + (h - g) ** 2) / h if s.averaged else _drawn(g, s.l1) ** 2 / (h + s.l2)
    return np.where(h > 0, worth, 0.0)


def _histograms(runs: list[Run], margin, bins: int):
    """Of a task's rows: (slot, block, node, sums by feature and bin) for each run's needed leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        chosen = {(slot, node): r.columns(node) for slot, r in enumerate(runs) for node in r.need}
        for batch in batches:
            codes, roles, salt = _bytes(batch["bins"]), _bytes(batch["roles"]), batch["salt"].to_numpy()
            made: dict[int, tuple] = {}
            for slot, r in enumerate(runs):
                s = r.fit.settings
                if r.at not in made:
                    rows = np.flatnonzero(roles[:, r.fit.role] < ASKED)
                    y = roles[rows, r.fit.role].astype(np.float64)
                    w = np.where(y == 1, r.weights[1], r.weights[0])
                    if s.averaged:
                        made[r.at] = rows, w * y, w
                    else:
                        p = 1 / (1 + np.exp(-margin(r.at, batch, codes, rows)))
                        made[r.at] = rows, w * (p - y), w * p * (1 - p)
                rows, g, h = made[r.at]
                if s.rows < 1:
                    own = _drawn_by_hash(salt[rows], r.fit.seed, r.at, r.number) < s.rows
                    rows, g, h = rows[own], g[own], h[own]
                if s.grow == "forest":
                    times = _times(salt[rows], r)
                    own = np.flatnonzero(times)
                    rows, g, h = rows[own], (g * times)[own], (h * times)[own]
                leaf = r.tree.leaf_of(codes[rows])
                for node in r.need:
                    here, columns = np.flatnonzero(leaf == node), chosen[slot, node]
                    cells = codes[np.ix_(rows[here], columns)] if r.by_segment is None else _segments(salt[rows[here]], r.fit, r.at)[:, None]
                    flat = (cells.astype(np.int64) + np.arange(len(columns)) * bins).ravel()
                    sums = [np.bincount(flat, minlength=len(columns) * bins)]
                    sums += [np.bincount(flat, np.repeat(np.rint(v[here] * SCALE), len(columns)), len(columns) * bins) for v in (g, h)]
                    sums = np.array(sums).astype(np.int64).reshape(3, len(columns), bins)
                    total[slot, node] = total[slot, node] + sums if (slot, node) in total else sums
        out = [(slot, at // BLOCK, node, sums[:, at : at + BLOCK].tobytes()) for (slot, node), sums in total.items() for at in range(0, sums.shape[1], BLOCK)]
        columns = [pa.array([x[i] for x in out], pa.binary() if i == 3 else pa.int32()) for i in range(4)]
        yield pa.record_batch(columns, names=["slot", "block", "node", "sums"])

    return run


BEST = "slot int, node int, gain double, feature int, cut int, n bigint, g bigint, h bigint, nl bigint, gl bigint, hl bigint"


def _best_splits(runs: list[Run], centres: list[np.ndarray], bins: int):
    """The best split of each leaf among a block's features; of a run that splits a level at once, the best common one."""

    def run(table: pa.Table) -> pa.Table:
        slot, block = table["slot"][0].as_py(), table["block"][0].as_py()
        r, s = runs[slot], runs[slot].fit.settings
        sums: dict[int, np.ndarray] = {}
        for node, raw in zip(table["node"].to_pylist(), table["sums"].to_pylist()):
            part = np.frombuffer(raw, dtype=np.int64).reshape(3, -1, bins)
            sums[node] = sums[node] + part if node in sums else part
        if r.by_segment is not None:
            rows = [(slot, node, 0.0, 0, segment, *three[:, 0, segment].tolist(), 0, 0, 0) for node, three in sums.items() for segment in range(SEGMENTS)]
            return _split_table(rows)
        gains, lefts, wholes = {}, {}, {}
        for node, (n, g, h) in sums.items():
            left = np.cumsum(np.stack([n, g, h]), axis=2)
            whole = left[:, :1, -1:]
            right = whole - left
            if s.averaged and node == 0:
                r.known[0] = tuple(whole[:, 0, 0].tolist())
            worth = [_score(s, *r.weighed(*x[1:])) for x in (left, right, whole)]
            gain = worth[0] + worth[1] - worth[2]
            fine = (left[0] >= s.min_rows) & (right[0] >= s.min_rows) & (left[2] >= s.min_hessian * SCALE) & (right[2] >= s.min_hessian * SCALE)
            if s.grow == "random":
                fine &= _drawn_cuts(r, node, block, n, centres)
            gains[node], lefts[node], wholes[node] = np.where(fine, gain, 0.0 if s.grow == "same" else -np.inf), left, whole[:, 0, 0]
        if s.grow == "same":
            common = sum(gains.values())
            gains = dict.fromkeys(gains, common)
        rows = []
        for node, gain in gains.items():
            at, cut = divmod(int(gain.argmax()), bins)
            rows.append((slot, node, float(gain[at, cut]), int(r.columns(node)[block * BLOCK + at]), cut, *wholes[node].tolist(), *lefts[node][:, at, cut].tolist()))
        return _split_table(rows)

    return run


def _split_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in BEST.split(", ")])


def _drawn_cuts(r: Run, node: int, block: int, n: np.ndarray, centres: list[np.ndarray]) -> np.ndarray:
    """One cut a feature, drawn evenly within the range of its values in the node; none where there is one value."""
    out = np.zeros(n.shape, dtype=bool)
    features = r.columns(node)[block * BLOCK : block * BLOCK + len(n)]
    even = np.random.default_rng([r.fit.seed, r.at, r.number, node, block, 1]).random(len(n))
    for i, feature in enumerate(features.tolist()):
        there = np.flatnonzero(n[i])
        if len(there) > 1:
            c = centres[feature]
            value = c[there[0]] + even[i] * (c[there[-1]] - c[there[0]])
            out[i, min(max(int(np.searchsorted(c, value, side="right")) - 1, there[0]), there[-1] - 1)] = True
    return out


def _centres(cuts: np.ndarray) -> np.ndarray:
    """A value for each bin: half-way between its cuts, and beyond the outer ones as far as to the next."""
    if not len(cuts):
        return np.zeros(1)
    inner = (cuts[1:] + cuts[:-1]) / 2
    reach = (cuts[1] - cuts[0], cuts[-1] - cuts[-2]) if len(cuts) > 1 else (1.0, 1.0)
    return np.concatenate([[cuts[0] - reach[0] / 2], inner, [cuts[-1] + reach[1] / 2]])


def _jobs(runs: list[Run], bins: int) -> Iterator[list[Run]]:
    """Runs by jobs whose histograms take some ``PASS_BYTES`` at most; at least one run each."""
    job, size = [], 0
    for r in runs:
        own = sum(len(r.columns(n)) for n in r.need) * bins * 24
        if job and size + own > PASS_BYTES:
            yield job
            job, size = [], 0
        job.append(r)
        size += own
    if job:
        yield job


def grow(rows: DataFrame, fits: list[Fit], roles: int, bins: int = BINS) -> tuple[DataFrame, list[list[Tree]], list[np.ndarray]]:
    """((row_id, fit, p) of the asked rows, the trees of each fit, the cuts): ``rows`` has row_id, x and roles, an array of ``roles``
    numbers: 0 or 1 (a label to learn from), 2 (asked) or 3. ``fit`` is the place in ``fits``."""
    ship_code(rows.sparkSession)
    rows = materialised(rows.select("row_id", "x", "roles"))
    counts = np.zeros((roles, 4), dtype=np.int64)
    for r in rows.select(F.posexplode("roles").alias("i", "role")).groupBy("i", "role").count().collect():  # four a label set
        counts[r["i"], int(r["role"])] = r["count"]
    cuts = cuts_of(rows, bins)
    wide = max([SEGMENTS, *(len(c) + 1 for c in cuts)])
    centres = [_centres(c) for c in cuts]
    table = materialised(binned(rows, cuts, roles))
    start, constant, runs = np.zeros(len(fits)), {}, []
    for at, fit in enumerate(fits):
        zeros, ones = counts[fit.role, :2].tolist()
        if not zeros or not ones:
            constant[at] = None if not zeros + ones else float(ones > 0)
            continue
        s = fit.settings
        start[at] = np.log(ones / zeros) if s.from_odds and not s.balanced else 0.0
        weights = ((zeros + ones) / (2 * zeros), (zeros + ones) / (2 * ones)) if s.balanced and s.grow != "forest" else (1.0, 1.0)
        runs += [Run(at, fit, k, len(cuts), weights) for k in (range(s.rounds) if s.averaged else [0])]
    trees: list[list[Tree]] = [[] for _ in fits]
    written = [0] * len(fits)
    margins: DataFrame | None = None
    active = [r for r in runs if r.fit.settings.rounds > 0 and len(r.allowed)]

    def margin_of_rest():
        rest = [t[n:] for t, n in zip(trees, written)]

        def margin(at: int, batch: pa.RecordBatch, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
            m = _bytes(batch["margins"], np.float64)[rows, at] if "margins" in batch.schema.names else np.full(len(rows), start[at])
            segment = _segments(batch["salt"].to_numpy()[rows], fits[at], at) if fits[at].settings.ordered else None
            return m + sum((t.trained(codes[rows], segment) for t in rest[at]), np.zeros(len(rows)))

        return margin

    while active:
        source = table if margins is None else margins
        for job in _jobs(active, wide):
            made = source.mapInArrow(_histograms(job, margin_of_rest(), wide), "slot int, block int, node int, sums binary")
            found: dict[tuple[int, int, int], tuple] = {}
            for x in made.groupBy("slot", "block").applyInArrow(_best_splits(job, centres, wide), BEST).collect():  # one a block and leaf
                ordered = job[x["slot"]].by_segment is not None
                key, new = (x["slot"], x["node"], x["cut"] if ordered else -1), tuple(x[2:])
                if key not in found or (-new[0], new[1], new[2]) < (-found[key][0], found[key][1], found[key][2]):
                    found[key] = new
            for (slot, node, _), x in sorted(found.items()):
                job[slot].take(node, x)
        for r in active:
            if r.grow():
                trees[r.at].append(r.tree)
                if not r.fit.settings.averaged and len(trees[r.at]) < r.fit.settings.rounds:
                    r.number += 1
                    r.begin()
        active = [r for r in active if r.need]
        boosted = {r.at for r in active if not r.fit.settings.averaged}
        if any(len(trees[at]) - written[at] >= PENDING for at in boosted):
            margins = materialised(source.mapInArrow(_with_margins(margin_of_rest(), len(fits)), f"{table.schema.simpleString()[7:-1].replace(':', ' ')}, margins binary"))
            written = [len(t) for t in trees]
    return table.mapInArrow(_predicted(fits, trees, start, constant), f"row_id {dict(table.dtypes)['row_id']}, fit int, p double"), trees, cuts


def _with_margins(margin, fits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, every = _bytes(batch["bins"]), np.arange(len(batch))
            m = np.column_stack([margin(at, batch, codes, every) for at in range(fits)])
            yield pa.record_batch([*[batch[c] for c in ("row_id", "salt", "bins", "roles")], pa.array(map(bytes, m), pa.binary())], names=["row_id", "salt", "bins", "roles", "margins"])

    return run


def _predicted(fits: list[Fit], trees: list[list[Tree]], start: np.ndarray, constant: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, roles = _bytes(batch["bins"]), _bytes(batch["roles"])
            for at, fit in enumerate(fits):
                rows = np.flatnonzero(roles[:, fit.role] == ASKED)
                if at in constant:
                    p = pa.array([constant[at]] * len(rows), pa.float64())
                else:
                    total = sum((t.values(codes[rows]) for t in trees[at]), np.zeros(len(rows)))
                    p = pa.array(total / max(1, len(trees[at])) if fit.settings.averaged else 1 / (1 + np.exp(-(start[at] + total))))
                yield pa.record_batch([batch["row_id"].take(pa.array(rows)), pa.array(np.full(len(rows), at, dtype=np.int32)), p], names=["row_id", "fit", "p"])

    return run
