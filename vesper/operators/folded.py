"""Linear models, small networks and kernel machines of many label sets at once, without a copy of rows for any of them.

``rows`` has row_id, x (an array of doubles without gaps) and roles: for each label set 0 or 1 (a label to learn from), 2 (asked) or
3 (left out). A step is one pass: every task adds up the gradients of all label sets over its rows, Spark sums them by label set, and
the driver, which has the coefficients alone, takes the step. No group of rows has to fit a task.

``logistic`` is the balanced gradient descent of ``models.fit_logistic``, a pass for each of its steps; tables of up to ``LOCAL`` rows,
by count, and ``CELLS`` cells take all steps within one task instead, with the same numbers.

``regressions`` and ``linear_machines`` are the balanced optima of the logistic loss and of the squared hinge with drawn-in coefficients, by
quasi-Newton steps (L-BFGS): a pass tries one point for every label set, and the driver has the last ``MEMORY`` steps of each. They
end when all gradients are as good as 0, wherever they began: below ``NEAR`` a row values don't tell points apart any more, so a point is
taken if its gradient is smaller, until that is below ``STILL`` or ``POLISH`` points have been tried, as sums are rounded.

``networks`` have one hidden layer of rectified units, drawn-in weights (their sum of squares costs ``alpha`` / 2 a row in all) and
Adam's steps on the gradient of all rows; steps are passes or stay within a task, as above.

``kernel_machines`` are balanced support vector machines with a radial kernel and Platt's probabilities: a row is given by its
kernel values with a bounded sample of rows (``landmarks``, those of the smallest hashes), in a basis of which products are the
kernel's. A table of no more rows than that has the exact kernel; of a larger one it is the projection on the sample's span. The hinge is
rounded off within ``SOFT`` of its corner, steps are accelerated in the metric of the features' second moments, and the sigmoid is
fitted on decisions of machines that haven't seen a row, of five inner folds by the row's hash. Steps read the rows' values as
matrices, of which a task has ``HELD`` bytes; the sigmoid's passes read decisions alone, which are made once.

Defined results: a label set of one class is that class's constant, one without a training row has null; features that don't vary
in training count as nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cluster import ship_code
from ..sources.sinks import materialised
from .models import STEPS

LOCAL = 20_000
CELLS = 16 << 20
MEMORY, NEAR, STILL, POLISH = 12, 1e-10, 1e-13, 6
ASKED = 2
#: Groups in which tasks' sums meet first, so that no task reads a row from every other one.
SPREAD = 64

LANDMARKS, SOFT, PASSES, INNER = 512, 0.1, 60, 5
#: Bytes of kernel values in a partition: a task's Arrow batch has all of its matrices.
HELD = 32 << 20


def _matrix(batch: pa.RecordBatch, name: str, kind=np.float64) -> np.ndarray:
    column = batch[name]
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(batch), -1)


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (key int, sums binary of doubles) by key, gathered: a row for each key."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in table["sums"].to_pylist())
        return pa.table({"key": table["key"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    first = parts.withColumn("spread", F.spark_partition_id() % SPREAD)
    if parts.rdd.getNumPartitions() > SPREAD:
        first = first.groupBy("key", "spread").applyInArrow(add, "key int, sums binary")
    return {r["key"]: np.frombuffer(r["sums"], dtype=np.float64) for r in first.select("key", "sums").groupBy("key").applyInArrow(add, "key int, sums binary").collect()}


def _sums(rows: DataFrame, of) -> dict[int, np.ndarray]:
    """``of`` gives (key, array) pairs of a batch; their sums over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, x in of(batch):
                total[key] = total[key] + x if key in total else x
        sums = pa.array([np.ascontiguousarray(x, dtype=np.float64).tobytes() for x in total.values()], pa.binary())
        yield pa.record_batch([pa.array(list(total), pa.int32()), sums], names=["key", "sums"])

    return summed(rows.mapInArrow(run, "key int, sums binary"))


def _answers(rows: DataFrame, of) -> DataFrame:
    """(row_id, fit, p) of asked rows; ``of`` gives a batch's probabilities for a label set, or None for null."""
    roles = rows.select(F.size("roles")).first()
    n = roles[0] if roles else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            role = _matrix(batch, "roles", np.int8)
            for k in range(n):
                asked = np.flatnonzero(role[:, k] == ASKED)
                p = of(batch, k, asked)
                p = pa.nulls(len(asked), pa.float64()) if p is None else pa.array(np.asarray(p, dtype=np.float64))
                yield pa.record_batch([batch["row_id"].take(pa.array(asked)), pa.array(np.full(len(asked), k, dtype=np.int32)), p], names=["row_id", "fit", "p"])

    return rows.mapInArrow(run, f"row_id {dict(rows.dtypes)['row_id']}, fit int, p double")


def _moments(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Of each label set: (zeros, ones, sums by feature)."""
    x, roles = _matrix(batch, "x"), _matrix(batch, "roles", np.int8)
    for k in range(roles.shape[1]):
        own = roles[:, k] < ASKED
        yield k, np.concatenate([[(roles[:, k] == 0).sum(), (roles[:, k] == 1).sum()], x[own].sum(axis=0)])


def _models(rows: DataFrame) -> dict[int, dict]:
    """Counts, means and scales of each label set, in two passes, as ``fit_logistic`` has them; constants where there is one class."""
    first = _sums(rows, _moments)
    means = {k: s[2:] / max(1.0, s[0] + s[1]) for k, s in first.items()}

    def squares(batch: pa.RecordBatch):
        x, roles = _matrix(batch, "x"), _matrix(batch, "roles", np.int8)
        return ((k, ((x[roles[:, k] < ASKED] - means[k]) ** 2).sum(axis=0)) for k in range(roles.shape[1]))

    out = {}
    for k, square in _sums(rows, squares).items():
        zeros, ones = first[k][:2]
        scale = np.sqrt(square / max(1.0, zeros + ones))
        out[k] = {"mean": means[k], "scale": np.where(scale > 0, scale, 1.0), "n": zeros + ones, "ones": ones}
        if not zeros or not ones:
            out[k]["constant"] = float(ones > 0) if zeros + ones else None
    return out


def _standard(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["scale"], -model["clip"], model["clip"])


def _matrices(n: int, **parts: np.ndarray) -> pa.RecordBatch:
    """One row of matrices of ``n`` rows, as bytes."""
    return pa.record_batch([pa.array([n], pa.int32()), *[pa.array([m.tobytes()], pa.binary()) for m in parts.values()]], names=["n", *parts])


def _packed(rows: DataFrame) -> DataFrame:
    """Matrices of a batch's rows as bytes, so that passes don't make them from rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield _matrices(len(b), x=_matrix(b, "x"), roles=_matrix(b, "roles", np.int8))

    return materialised(rows.mapInArrow(run, "n int, x binary, roles binary"))


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n, x, roles in zip(batch["n"].to_pylist(), batch["x"], batch["roles"]):
        yield np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(n, -1), np.frombuffer(roles.as_buffer(), dtype=np.int8).reshape(n, -1)


def _descended(rows: DataFrame, models: dict[int, dict], pull, stepped, steps: int, local: int) -> None:
    """Take the steps of all models: ``pull`` has the gradient of some standardised rows, ``stepped`` changes a model by their sum."""
    if not models:
        return
    n, width = rows.count(), len(next(iter(models.values()))["mean"])
    if n <= local and n * width <= CELLS:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = [(_matrix(b, "x"), _matrix(b, "roles", np.int8)) for b in batches if len(b)]
            x, roles = (np.concatenate(p) for p in zip(*some))
            for k, m in models.items():
                own = roles[:, k] < ASKED
                z, y = _standard(m, x[own]), roles[own, k].astype(float)
                for step in range(steps):
                    stepped(m, pull(m, z, y), step)
                    if m.get("done"):
                        break
            yield pa.record_batch([pa.array(list(models), pa.int32()), pa.array([m["theta"].tobytes() for m in models.values()], pa.binary())], names=["key", "sums"])

        for r in rows.coalesce(1).mapInArrow(run, "key int, sums binary").collect():  # a row for each label set
            models[r["key"]]["theta"] = np.frombuffer(r["sums"], dtype=np.float64)
        return
    rows = _packed(rows)
    for step in range(steps):
        # tasks get what a gradient needs, not what is remembered of earlier steps
        open_ = {k: {name: m[name] for name in ("mean", "scale", "clip", "theta", "n", "ones")} for k, m in models.items() if not m.get("done")}
        if not open_:
            break

        def gradients(batch: pa.RecordBatch, open_=open_):
            return ((k, pull(m, _standard(m, x[own]), roles[own, k].astype(float))) for x, roles in _unpacked(batch) for k, m in open_.items() for own in [roles[:, k] < ASKED])

        for k, g in _sums(rows, gradients).items():
            stepped(models[k], g, step)


def _said(models: dict[int, dict], decide):
    """Probabilities of a batch's asked rows: the sigmoid of what a model decides, or its constant."""

    def said(batch: pa.RecordBatch, k: int, asked: np.ndarray):
        m = models[k]
        if "constant" in m:
            return None if m["constant"] is None else np.full(len(asked), m["constant"])
        return _sigmoid(decide(m, _standard(m, _matrix(batch, "x")[asked])))

    return said


def _sigmoid(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -30, 30)))


def _line(model: dict, z: np.ndarray) -> np.ndarray:
    return z @ model["theta"][:-1] + model["theta"][-1]


def logistic(rows: DataFrame, steps: int = STEPS, local: int = LOCAL) -> DataFrame:
    """(row_id, fit, p) of the asked rows, the fit of each label set by balanced gradient descent."""
    ship_code(rows.sparkSession)
    rows = materialised(rows.select("row_id", "x", "roles"))
    models = _models(rows)
    for m in models.values():
        m["clip"], m["theta"] = 8.0, np.zeros(len(m["mean"]) + 1)
        if "constant" not in m:
            m["theta"][-1] = np.log(m["ones"] / (m["n"] - m["ones"]))

    def pull(m: dict, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        rate = m["ones"] / m["n"]
        error = (_sigmoid(_line(m, z)) - y) * np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate)) / m["n"]
        return np.append(error @ z, error.sum())

    def stepped(m: dict, gradient: np.ndarray, step: int) -> None:
        drawn = 0.01 * m["theta"]
        drawn[-1] = 0.0
        m["theta"] = m["theta"] - 0.08 / (1 + step / 250) * (gradient + drawn)

    _descended(rows, {k: m for k, m in models.items() if "constant" not in m}, pull, stepped, steps, local)
    return _answers(rows, _said(models, _line))


def _newton_like(m: dict, value: float, gradient: np.ndarray, last: bool) -> None:
    """Take the point that was tried if it is lower enough, else halve the step; ``theta`` is what to try next, at the end the best."""
    kept, worst = m.get("kept"), float(np.abs(gradient).max()) / m["n"]
    near = kept is not None and m["worst"] <= NEAR
    if kept is None or (worst < m["worst"] if near else value <= kept[1] + 1e-4 * m["slope"] * m["length"] + 1e-14 * abs(kept[1])):
        if kept is not None:
            moved, turned = m["theta"] - kept[0], gradient - kept[2]
            if moved @ turned > 0:
                m["steps"] = [*m["steps"], (moved, turned)][-MEMORY:]
        kept = m["kept"] = (m["theta"], value, gradient)
        way, used = -gradient, []
        for moved, turned in reversed(m["steps"]):
            used.append((moved @ way) / (moved @ turned))
            way = way - used[-1] * turned
        if m["steps"]:
            moved, turned = m["steps"][-1]
            way = way * (moved @ turned) / (turned @ turned)
        for (moved, turned), share in zip(m["steps"], reversed(used)):
            way = way + (share - (turned @ way) / (moved @ turned)) * moved
        m["way"], m["slope"] = way, float(way @ gradient)
        m["length"] = 1.0 if m["steps"] else 1 / max(1.0, float(np.sqrt(gradient @ gradient)))
        m["worst"], m["done"] = worst, worst <= STILL
    else:
        m["length"] /= 2
        m["done"] = m["length"] < 1e-12
    m["tried"] = m.get("tried", 0) + near
    m["done"] |= m["tried"] >= POLISH
    m["theta"] = kept[0] if m["done"] or last else kept[0] + m["length"] * m["way"]


def _optima(rows: DataFrame, drawn_bias: float, loss, steps: int, local: int) -> DataFrame:
    """(row_id, fit, p) of the lowest half square of coefficients plus loss, by the sigmoid of the line; ``loss`` gives of lines and labels
    (values, slopes), which balanced classes weigh."""
    ship_code(rows.sparkSession)
    rows = materialised(rows.select("row_id", "x", "roles"))
    models = _models(rows)
    for m in models.values():
        m |= {"clip": np.inf, "theta": np.zeros(len(m["mean"]) + 1), "steps": []}

    def pull(m: dict, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        weight = m["n"] / 2 / np.where(y == 1, m["ones"], m["n"] - m["ones"])
        value, slope = loss(_line(m, z), y)
        return np.concatenate([[weight @ value], (weight * slope) @ z, [weight @ slope]])

    def stepped(m: dict, sums: np.ndarray, step: int) -> None:
        drawn = m["theta"] * np.append(np.ones(len(m["mean"])), drawn_bias)
        _newton_like(m, float(sums[0] + drawn @ m["theta"] / 2), sums[1:] + drawn, step == steps - 1)

    _descended(rows, {k: m for k, m in models.items() if "constant" not in m}, pull, stepped, steps, local)
    return _answers(rows, _said(models, _line))


def regressions(rows: DataFrame, c: float = 0.5, steps: int = 600, local: int = LOCAL) -> DataFrame:
    """(row_id, fit, p) of the asked rows: balanced logistic regression, a row's loss counting ``c``; the bias isn't drawn in."""

    def loss(line: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return c * np.logaddexp(0, np.where(y == 1, -line, line)), c * (1 / (1 + np.exp(-np.clip(line, -700, 700))) - y)

    return _optima(rows, 0.0, loss, steps, local)


def linear_machines(rows: DataFrame, c: float = 0.2, steps: int = 600, local: int = LOCAL) -> DataFrame:
    """(row_id, fit, p) of the asked rows: balanced machine of the squared hinge, the bias drawn in as any coefficient; p is the
    sigmoid of the decision."""

    def loss(line: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sign = 2 * y - 1
        over = np.maximum(1 - sign * line, 0)
        return c * over * over, -2 * c * sign * over

    return _optima(rows, 1.0, loss, steps, local)


def networks(rows: DataFrame, hidden: int = 24, alpha: float = 0.03, steps: int = 300, rate: float = 0.002, seed: int = 2026, local: int = LOCAL) -> DataFrame:
    """(row_id, fit, p) of the asked rows, a network for each label set."""
    ship_code(rows.sparkSession)
    rows = materialised(rows.select("row_id", "x", "roles"))
    models = _models(rows)
    for k, m in models.items():
        width, rng = len(m["mean"]), np.random.default_rng([seed, k])
        edge = np.sqrt(6 / (width + hidden)), np.sqrt(6 / (hidden + 1))
        m["clip"], m["theta"] = np.inf, np.concatenate([rng.uniform(-edge[0], edge[0], width * hidden), np.zeros(hidden), rng.uniform(-edge[1], edge[1], hidden), [0.0]])
        m["first"] = m["second"] = np.zeros(len(m["theta"]))

    def layers(m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        t, width = m["theta"], len(m["mean"])
        return t[: width * hidden].reshape(width, hidden), t[width * hidden : (width + 1) * hidden], t[(width + 1) * hidden : -1], t[-1]

    def decide(m: dict, z: np.ndarray) -> np.ndarray:
        w, b, v, c = layers(m)
        return np.maximum(z @ w + b, 0) @ v + c

    def pull(m: dict, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        w, b, v, c = layers(m)
        units = np.maximum(z @ w + b, 0)
        error = (_sigmoid(units @ v + c) - y) / m["n"]
        back = np.outer(error, v) * (units > 0)
        return np.concatenate([(z.T @ back).ravel(), back.sum(axis=0), units.T @ error, [error.sum()]])

    def stepped(m: dict, gradient: np.ndarray, step: int) -> None:
        w, b, v, _ = layers(m)
        gradient = gradient + alpha / m["n"] * np.concatenate([w.ravel(), np.zeros(len(b)), v, [0.0]])
        m["first"], m["second"] = 0.9 * m["first"] + 0.1 * gradient, 0.999 * m["second"] + 0.001 * gradient**2
        m["theta"] = m["theta"] - rate * m["first"] / (1 - 0.9 ** (step + 1)) / (np.sqrt(m["second"] / (1 - 0.999 ** (step + 1))) + 1e-8)

    _descended(rows, {k: m for k, m in models.items() if "constant" not in m}, pull, stepped, steps, local)
    return _answers(rows, _said(models, decide))


# ---- kernel machines


def _radial(x: np.ndarray, marks: np.ndarray, varying: int) -> np.ndarray:
    apart = (x * x).sum(axis=1)[:, None] + (marks * marks).sum(axis=1) - 2 * x @ marks.T
    return np.exp(-np.maximum(apart, 0) / max(1, varying))


def kernel_machines(rows: DataFrame, landmarks: int = LANDMARKS, passes: int = PASSES) -> DataFrame:
    """(row_id, fit, p) of the asked rows; C is 1, the kernel's width that of the number of varying features."""
    ship_code(rows.sparkSession)
    rows = rows.select("row_id", "x", "roles", F.pmod(F.xxhash64("row_id"), F.lit(INNER)).cast("int").alias("inner"))
    rows = materialised(rows)
    models = _models(rows)
    every = {0: np.zeros(0)} | _sums(rows, lambda b: [(0, np.append(_matrix(b, "x").sum(axis=0), len(b)))])
    if not len(every[0]):
        return _answers(rows, lambda *_: None)
    mean = every[0][:-1] / every[0][-1]
    scale = np.sqrt(_sums(rows, lambda b: [(0, ((_matrix(b, "x") - mean) ** 2).sum(axis=0))])[0] / every[0][-1])
    varies = scale > 1e-12 * np.maximum(1, np.abs(mean))
    scaled = lambda x: np.where(varies, (x - mean) / np.where(varies, scale, 1.0), 0.0)
    varying = int(varies.sum())
    marks = scaled(np.array([r[0] for r in rows.orderBy(F.xxhash64("row_id"), "row_id").limit(landmarks).select("x").collect()]))
    worth, turn = np.linalg.eigh(_radial(marks, marks, varying))
    features = int((worth > 1e-9 * worth[-1]).sum())
    basis = turn[:, -features:] / np.sqrt(worth[-features:])

    def mapped(x: np.ndarray) -> np.ndarray:
        return np.column_stack([_radial(scaled(x), marks, varying) @ basis, np.ones(len(x))]).astype(np.float32)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield _matrices(len(b), z=mapped(_matrix(b, "x")), roles=_matrix(b, "roles", np.int8), inner=b["inner"].to_numpy().astype(np.int8))

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(every[0][-1]) * 4 * (features + 1) // HELD))
    blocks = materialised(rows.repartition(tasks, "row_id").mapInArrow(packed, "n int, z binary, roles binary, inner binary"))

    def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for n, *parts in zip(batch["n"].to_pylist(), batch["z"], batch["roles"], batch["inner"]):
            z, roles, inner = (np.frombuffer(p.as_buffer(), dtype=kind).reshape(n, -1) for p, kind in zip(parts, (np.float32, np.int8, np.int8)))
            yield z.astype(np.float64), roles, inner

    moments = _sums(blocks, lambda b: ((0, (z.T @ z).ravel()) for z, _, _ in blocks_of(b)))[0].reshape(features + 1, -1)
    size, base = np.linalg.eigh(moments)
    size = np.maximum(size, 0)
    open_ = [k for k, m in models.items() if "constant" not in m]
    heavy = {k: (models[k]["n"] / (2 * (models[k]["n"] - models[k]["ones"])), models[k]["n"] / (2 * models[k]["ones"])) for k in open_}
    # of each label set the machine of all its rows, and one for each inner fold that is left out
    machines = [(k, f) for k in open_ for f in range(-1, INNER)]
    metric = 1 / (1 + np.array([max(heavy[k]) for k, _ in machines])[None, :] / SOFT * size[:, None])
    now = ahead = np.zeros((features + 1, len(machines)))
    ridge = np.append(np.ones(features), 1e-3)[:, None]

    each = np.arange(-1, INNER)

    for step in range(passes if machines else 0):

        def pulls(b: pa.RecordBatch, ahead=ahead):
            for z, roles, inner in blocks_of(b):
                decided, seen = z @ ahead, inner != each
                for at, k in enumerate(open_):
                    role, own = roles[:, k, None], slice(at * len(each), (at + 1) * len(each))
                    y, c = np.where(role == 1, 1.0, -1.0), np.where(role == 1, heavy[k][1], np.where(role == 0, heavy[k][0], 0.0))
                    decided[:, own] = -y * c * seen * np.clip((1 - y * decided[:, own]) / SOFT, 0, 1)
                yield 0, (z.T @ decided).ravel()

        gradient = ridge * ahead + _sums(blocks, pulls)[0].reshape(ahead.shape)
        before, now = now, ahead - base @ (metric * (base.T @ gradient))
        ahead = now + step / (step + 3) * (now - before)

    # Platt's sigmoid on decisions for rows that the machine hasn't seen, with his targets; Newton's steps
    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z, roles, inner in blocks_of(b):
                decided = (z @ now).reshape(len(z), len(open_), len(each))
                yield _matrices(len(z), x=np.take_along_axis(decided, inner[:, :, None].astype(int) + 1, axis=2), roles=roles)

    decisions = materialised(blocks.mapInArrow(unseen, "n int, x binary, roles binary")) if machines else blocks
    curves = {k: np.array([0.0, np.log((models[k]["ones"] + 1) / (models[k]["n"] - models[k]["ones"] + 1))]) for k in open_}
    aims = {k: (1 / (models[k]["n"] - models[k]["ones"] + 2), (models[k]["ones"] + 1) / (models[k]["ones"] + 2)) for k in open_}
    for _ in range(12 if machines else 0):

        def slopes(b: pa.RecordBatch):
            for decided, roles in _unpacked(b):
                for at, k in enumerate(open_):
                    own = roles[:, k] < ASKED
                    d, t = decided[own, at], np.where(roles[own, k] == 1, aims[k][1], aims[k][0])
                    p = 1 / (1 + np.exp(-np.clip(curves[k][0] * d + curves[k][1], -30, 30)))
                    e, v = p - t, p * (1 - p)
                    yield k, np.array([e @ d, e.sum(), v @ (d * d), v @ d, v.sum()])

        for k, (gd, g, dd, d, n) in _sums(decisions, slopes).items():
            curves[k] = curves[k] - np.linalg.solve(np.array([[dd + 1e-6, d], [d, n + 1e-6]]), np.array([gd, g]))

    def said(b: pa.RecordBatch, k: int, asked: np.ndarray):
        if "constant" in models[k]:
            return None if models[k]["constant"] is None else np.full(len(asked), models[k]["constant"])
        d = mapped(_matrix(b, "x")[asked]).astype(np.float64) @ now[:, open_.index(k) * len(each)]
        return 1 / (1 + np.exp(-np.clip(curves[k][0] * d + curves[k][1], -30, 30)))

    return _answers(rows, said)
