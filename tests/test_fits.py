"""Tree ensembles, linear models, logistic folds, networks and kernel machines of many label sets against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from vesper.operators import folded, models, registry, trees
from vesper.operators.trees import Ensemble, Fit

N = 300


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(N, 6)), 1)
    x[:, 4] = 3.0
    y = (rng.random(N) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] * x[:, 2])))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, made):
    """Two folds, a label set of one class, and one that nothing trains."""
    x, y = made
    roles = [[int(y[i]) if i % 3 else 2, int(y[i]) if i % 5 else 2, 1 if i % 2 else 2, 3 if i % 2 else 2] for i in range(N)]
    return spark.createDataFrame([(i, [float(v) for v in x[i]], roles[i]) for i in range(N)], "row_id int, x array<double>, roles array<int>").repartition(3).persist()


def loss(y, p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def of(frame, fit):
    return frame[frame.fit == fit].sort_values("row_id").p.to_numpy()


def plain_boosting(x, y, s: Ensemble):
    """Trees as nested (feature, cut, left, right) or values, grown over the raw values; all features and rows."""
    m = np.full(len(y), np.log(y.mean() / (1 - y.mean())) if s.from_odds else 0.0)
    shrunk = lambda g: np.sign(g) * max(abs(g) - s.l1, 0)
    worth = lambda g, h: shrunk(g) ** 2 / (h + s.l2)

    def splits(rows, g, h):
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            for cut in (v[1:] + v[:-1]) / 2:
                left = x[rows, f] <= cut
                a, b = rows[left], rows[~left]
                fine = min(len(a), len(b)) >= s.min_rows and min(h[a].sum(), h[b].sum()) >= s.min_hessian
                yield (worth(g[a].sum(), h[a].sum()) + worth(g[b].sum(), h[b].sum()) - worth(g[rows].sum(), h[rows].sum()) if fine else None), f, cut, a, b

    out = []
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = p - y, p * (1 - p)
        leaves = [(np.arange(len(y)), 0)]
        chosen = []
        while True:
            if s.grow == "same":
                if leaves[0][1] >= s.depth:
                    break
                each = [[(q[0] or 0.0, *q[1:]) for q in splits(r, g, h)] for r, _ in leaves]
                total = np.array([[q[0] for q in e] for e in each]).sum(axis=0)
                k = int((total > total.max() - 1e-7).argmax())
                if total[k] <= 1e-9:
                    break
                chosen.append(each[0][k][1:3])
                leaves = [(part, d + 1) for e, (_, d) in zip(each, leaves) for part in e[k][3:]]
                continue
            best = None
            for at, (r, d) in enumerate(leaves):
                if (s.depth and d >= s.depth) or len(r) < 2 * s.min_rows:
                    continue
                for q in splits(r, g, h):
                    if q[0] is not None and q[0] > 1e-9 and (best is None or q[0] > best[1][0] + 1e-7):
                        best = (at, q)
            if best is None or (s.leaves and len(leaves) >= s.leaves):
                break
            at, (_, f, cut, a, b) = best
            chosen.append((f, cut))
            d = leaves.pop(at)[1] + 1
            leaves += [(a, d), (b, d)]
        for r, _ in leaves:
            m[r] -= s.rate * shrunk(g[r].sum()) / (h[r].sum() + s.l2)
        out.append(sorted(chosen))
    return out, m


KINDS = {
    "leaf": Ensemble(4, 0.3, leaves=7, l2=0.2, min_rows=10),
    "deep": Ensemble(3, 0.3, depth=3, leaves=15, l1=0.5, l2=1.0, min_rows=5),
    "same": Ensemble(4, 0.3, depth=3, l2=8.0, grow="same", from_odds=False),
}


@pytest.mark.parametrize("kind", KINDS)
def test_boosted_trees_have_the_splits_of_a_plain_version(rows, made, kind):
    x, y = made
    s = KINDS[kind]
    train = np.arange(N) % 3 > 0
    got, grown, cuts = trees.grow(rows, [Fit(0, s)], 4)
    # cuts lie between values of all rows; the plain version gets the training rows in the same bins
    coarse = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]).astype(float)
    want, margin = plain_boosting(coarse[train], y[train].astype(float), s)

    def gone_left(f, cut):
        return tuple(coarse[train][:, f] <= cut)

    for tree, splits in zip(grown[0], want):
        inner = [(f, c) for f, c in zip(tree.feature, tree.cut) if f >= 0]
        if s.grow == "same":
            inner = list(dict.fromkeys(inner))
        assert sorted(gone_left(f, c) for f, c in inner) == sorted(gone_left(f, c) for f, c in splits)
    codes = coarse[train].astype(np.uint8)
    start = np.log(y[train].mean() / (1 - y[train].mean())) if s.from_odds else 0.0
    assert np.allclose(start + sum(t.values(codes) for t in grown[0]), margin, atol=1e-6)
    assert loss(y[~train], of(got.toPandas(), 0)) < loss(y[~train], np.full((~train).sum(), y[train].mean()))


def test_trees_do_not_depend_on_partitions_or_on_other_fits(rows):
    kinds = [KINDS["leaf"], Ensemble(20, 0.1, depth=3, rows=0.6, columns=0.6, grow="level", min_hessian=1.0), Ensemble(18, 0.1, depth=3, l2=8.0, grow="same", from_odds=False, ordered=True), Ensemble(10, depth=4, min_rows=2, balanced=True, grow="random"), Ensemble(8, depth=4, min_rows=3, balanced=True, grow="forest")]
    fits = [Fit(r, s, None, 5) for s in kinds for r in range(4)]
    one, two = (trees.grow(df, fits, 4)[0].toPandas().sort_values(["fit", "row_id"]) for df in (rows.repartition(1), rows.repartition(7)))
    assert (one.p.fillna(-1).to_numpy() == two.p.fillna(-1).to_numpy()).all()
    assert set(of(one, 2)) == {1.0} and np.isnan(of(one, 3)).all()  # one class, and nothing to learn from
    alone = trees.grow(rows, [Fit(1, kinds[0], None, 5)], 4)[0].toPandas()
    assert (of(alone, 0) == of(one, 1)).all()


def test_ordered_margins_leave_a_rows_own_label_out(rows):
    _, grown, _ = trees.grow(rows, [Fit(0, Ensemble(2, 0.3, depth=2, l2=1.0, grow="same", ordered=True))], 4)
    for tree in grown[0]:
        leaves = [n for n, f in enumerate(tree.feature) if f < 0]
        assert tree.prefix.shape == (len(tree.feature), trees.SEGMENTS) and (tree.prefix[:, 0] == 0).all()
        assert any(tree.prefix[n, -1] != tree.value[n] for n in leaves)


def plain_forest_tree(codes, y, times, columns, s: Ensemble):
    """Of one sampled tree the (feature, rows that go left) of its inner nodes, level by level, and what its leaves say of each row."""
    own = np.flatnonzero(times)
    ones, every = (times * y).sum(), times.sum()
    weight = times * np.where(y == 1, every / (2 * ones), every / (2 * (every - ones)))
    mixed = lambda r: (weight[r] * y[r]).sum() / max(weight[r].sum(), 1e-300)
    impure = lambda r: weight[r].sum() * (1 - mixed(r) ** 2 - (1 - mixed(r)) ** 2)
    level, splits, said, made = [(0, own, np.arange(len(y)))], [], np.zeros(len(y)), 1
    for deep in range(s.depth + 1):
        below = []
        for node, rows, all_ in level:
            best = None
            if deep < s.depth and len(rows) >= 2 * s.min_rows and 0 < y[rows].sum() < len(rows):
                for f in columns(node):
                    for cut in np.unique(codes[rows, f])[:-1]:
                        a, b = rows[codes[rows, f] <= cut], rows[codes[rows, f] > cut]
                        if min(len(a), len(b)) >= s.min_rows:
                            gain = impure(rows) - impure(a) - impure(b)
                            if best is None or gain > best[0] + 1e-9:
                                best = gain, f, cut, a, b
            if best is None:
                said[all_] = mixed(rows)
                continue
            _, f, cut, a, b = best
            splits.append((f, tuple(codes[own, f] <= cut)))
            left = codes[all_, f] <= cut
            below += [(made, a, all_[left]), (made + 1, b, all_[~left])]
            made += 2
        level = below
    return splits, said


def test_forests_are_those_of_a_plain_version(rows, made):
    x, y = made
    s = Ensemble(5, depth=4, min_rows=3, balanced=True, grow="forest")
    got, grown, cuts = trees.grow(rows, [Fit(0, s, None, 7)], 4)
    salt = {r["row_id"]: r["salt"] for r in trees.binned(rows, cuts, 4).select("row_id", "salt").collect()}
    salt = np.array([salt[i] for i in range(N)])
    codes = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.uint8)
    train, total = np.arange(N) % 3 > 0, np.zeros(N)
    for k, tree in enumerate(grown[0]):
        run = trees.Run(0, Fit(0, s, None, 7), k, 6, (1.0, 1.0))
        times = np.where(train, trees._times(salt, run), 0)
        splits, said = plain_forest_tree(codes, y, times, run.columns, s)
        own = times > 0
        assert [(f, tuple(codes[own, f] <= c)) for f, c in zip(tree.feature, tree.cut) if f >= 0] == splits
        total += said
    assert np.allclose(of(got.toPandas(), 0), total[~train] / s.rounds)
    drawn = np.bincount(trees._times(np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 200_000), run), minlength=5)[:5] / 200_000
    assert np.abs(drawn - np.exp(-1) / np.array([1, 1, 2, 6, 24])).max() < 0.004


def test_columns_that_a_fit_may_use_and_odd_tables(spark, rows):
    s = Ensemble(3, 0.3, leaves=4)
    _, grown, _ = trees.grow(rows, [Fit(0, s, (1, 2)), Fit(0, Ensemble(20, depth=3, grow="random"), (0,))], 4)
    assert {f for t in grown[0] for f in t.feature} <= {-1, 1, 2} and {f for t in grown[1] for f in t.feature} <= {-1, 0}
    assert trees.grow(rows.where("false"), [Fit(0, s)], 4)[0].collect() == []
    many = spark.range(2000).selectExpr("cast(id as int) row_id", "array(cast(id as double)) x", "array(cast(id % 7 < 3 as int), 2) roles")
    p, grown, cuts = trees.grow(many.union(many.selectExpr("row_id + 5000", "x", "array(2, 2)")), [Fit(0, s)], 2)
    assert 200 < len(cuts[0]) <= 255 and p.where("fit = 0").count() == 2000


def test_logistic_folds_equal_the_fit_of_one(rows, made):
    x, y = made
    near, far = (folded.logistic(rows, steps=40, local=n).toPandas() for n in (folded.LOCAL, 0))
    for fit, out in ((0, 3), (1, 5)):
        train = np.arange(N) % out > 0
        want = models.predict_logistic(models.fit_logistic(x[train], y[train].astype(float), 40), x[~train])
        assert np.abs(of(near, fit) - want).max() < 1e-9 and np.abs(of(far, fit) - want).max() < 1e-9
    assert set(of(near, 2)) == {1.0} and np.isnan(of(near, 3)).all()
    assert folded.logistic(rows.where("false")).collect() == []


def test_networks_take_the_same_steps_near_and_far(rows, made):
    _, y = made
    near, far = (folded.networks(rows, steps=5, local=n).toPandas() for n in (folded.LOCAL, 0))
    assert np.abs(of(near, 0) - of(far, 0)).max() < 1e-9
    whole = folded.networks(rows).toPandas()
    held = np.arange(N) % 3 == 0
    assert loss(y[held], of(whole, 0)) < loss(y[held], np.full(held.sum(), y[~held].mean()))
    assert set(of(whole, 2)) == {1.0} and folded.networks(rows.where("false")).collect() == []


def plain_optimum(x, y, asked, machine: bool):
    """Newton's steps with the whole matrix, halved while the value grows."""
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    z, c = np.column_stack([(x - mean) / scale, np.ones(len(y))]), 0.2 if machine else 0.5
    weight = c * len(y) / 2 / np.where(y == 1, y.sum(), len(y) - y.sum())
    ridge, sign, t = np.append(np.ones(x.shape[1]), float(machine)), 2.0 * y - 1, np.zeros(x.shape[1] + 1)

    def value(t):
        line = sign * (z @ t)
        return ridge @ (t * t) / 2 + weight @ (np.maximum(1 - line, 0) ** 2 if machine else np.logaddexp(0, -line))

    for _ in range(60):
        line = sign * (z @ t)
        p = 1 / (1 + np.exp(line))
        slope, bend = (-2 * sign * np.maximum(1 - line, 0), 2.0 * (line < 1)) if machine else (-sign * p, p * (1 - p))
        step = np.linalg.solve((z.T * (weight * bend)) @ z + np.diag(ridge), z.T @ (weight * slope) + ridge * t)
        size = 1.0
        while value(t - size * step) > value(t) + 1e-12 and size > 1e-6:
            size /= 2
        t = t - size * step
    return 1 / (1 + np.exp(-(np.column_stack([(asked - mean) / scale, np.ones(len(asked))]) @ t)))


@pytest.mark.parametrize("machine", [False, True])
def test_linear_models_are_the_optimum(rows, made, machine):
    x, y = made
    fitted = folded.linear_machines if machine else folded.regressions
    near, far = (fitted(rows, local=n).toPandas() for n in (folded.LOCAL, 0))
    for fit, out in ((0, 3), (1, 5)):
        train = np.arange(N) % out > 0
        want = plain_optimum(x[train], y[train], x[~train], machine)
        assert np.abs(of(near, fit) - want).max() < 1e-8 and np.abs(of(far, fit) - want).max() < 1e-8
    assert set(of(near, 2)) == {1.0} and np.isnan(of(far, 3)).all()
    assert fitted(rows.where("false")).collect() == []


def test_separable_labels_and_wide_tables_have_an_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 90)) * 10.0 ** rng.integers(-3, 4, 90)
    y = (x[:, 0] > 0).astype(int)
    wide = spark.createDataFrame([(i, x[i].tolist(), [int(y[i]) if i % 4 else 2]) for i in range(40)], "row_id int, x array<double>, roles array<int>")
    train = np.arange(40) % 4 > 0
    for machine, fitted in ((False, folded.regressions), (True, folded.linear_machines)):
        assert np.abs(of(fitted(wide).toPandas(), 0) - plain_optimum(x[train], y[train], x[~train], machine)).max() < 1e-8


@pytest.mark.parametrize("machine, seeds", [(False, (24, 36)), (True, (29, 38))])
def test_optima_are_better_than_their_rounding(spark, machine, seeds):
    """Queries show probabilities to 9 digits; one that is off in the 10th may be rounded the other way, in all rows that have it."""
    fitted = folded.linear_machines if machine else folded.regressions
    for seed in seeds:
        rng = np.random.default_rng(seed)
        x = np.column_stack([rng.integers(0, 2, 3000), rng.integers(0, 8, 3000) / 7.0])
        y = (rng.random(3000) < 0.1 + 0.02 * seed * x[:, 0] + 0.05 * x[:, 1]).astype(int)
        asked = np.unique(x, axis=0)
        roled = [*zip(x.tolist(), y.tolist()), *((v, 2) for v in asked.tolist())]
        frame = spark.createDataFrame([(i, v, [role]) for i, (v, role) in enumerate(roled)], "row_id int, x array<double>, roles array<int>")
        assert np.abs(of(fitted(frame).toPandas(), 0) - plain_optimum(x, y, asked, machine)).max() < 5e-12


def exact_machine(x, y, asked):
    """Pairwise steps on the dual of the exact kernel, decisions of five inner folds, and Platt's sigmoid on those."""
    mean, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    a, b = (x - mean) / scale, (asked - mean) / scale
    kernel = lambda p, q: np.exp(-((p[:, None, :] - q[None]) ** 2).sum(axis=2) / (a.shape[1] * a.var()))
    ones = y.sum()
    c, sign = np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones))), 2.0 * y - 1

    def solve(own):
        k, s, most, alpha, slope = kernel(a[own], a[own]), sign[own], c[own], np.zeros(len(own)), -np.ones(len(own))
        for _ in range(20_000):
            up, low = ((s > 0) & (alpha < most)) | ((s < 0) & (alpha > 0)), ((s > 0) & (alpha > 0)) | ((s < 0) & (alpha < most))
            v = -s * slope
            i, j = np.flatnonzero(up)[v[up].argmax()], np.flatnonzero(low)[v[low].argmin()]
            if v[i] - v[j] < 1e-3:
                break
            step = min((v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), most[i] - alpha[i] if s[i] > 0 else alpha[i], alpha[j] if s[j] > 0 else most[j] - alpha[j])
            alpha[i] += s[i] * step
            alpha[j] -= s[j] * step
            slope += step * s * (k[:, i] - k[:, j])
        return lambda q: kernel(q, a[own]) @ (alpha * s) + (v[up].max() + v[low].min()) / 2

    inner, d = np.random.default_rng(1).integers(0, 5, len(y)), np.zeros(len(y))
    for f in range(5):
        d[inner == f] = solve(np.flatnonzero(inner != f))(a[inner == f])
    aim, curve = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2)), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(curve[0] * d + curve[1])))
        e, v = p - aim, p * (1 - p)
        curve = curve - np.linalg.solve([[v @ (d * d) + 1e-6, v @ d], [v @ d, v.sum() + 1e-6]], [e @ d, e.sum()])
    return 1 / (1 + np.exp(-(curve[0] * solve(np.arange(len(y)))(b) + curve[1])))


def test_kernel_machines_are_near_the_exact_solution(rows, made):
    x, y = made
    got = folded.kernel_machines(rows).toPandas()
    for fit, out in ((0, 3), (1, 5)):
        train = np.arange(N) % out > 0
        want = exact_machine(x[train], y[train], x[~train])
        assert abs(loss(y[~train], of(got, fit)) - loss(y[~train], want)) < 0.02 and np.abs(of(got, fit) - want).mean() < 0.03
    assert set(of(got, 2)) == {1.0} and np.isnan(of(got, 3)).all()
    few = folded.kernel_machines(rows, landmarks=60, passes=30).toPandas()
    assert abs(loss(y[np.arange(N) % 3 == 0], of(few, 0)) - loss(y[np.arange(N) % 3 == 0], of(got, 0))) < 0.05
    assert folded.kernel_machines(rows.where("false")).collect() == []


def test_kernel_machines_read_matrices_of_bounded_tasks(rows, monkeypatch):
    """Passes read matrices, not rows; a task's are bounded; the sigmoid's passes read decisions alone. In many tasks the numbers are the same."""
    want = folded.kernel_machines(rows, landmarks=60, passes=3).toPandas().sort_values(["fit", "row_id"]).p.to_numpy()
    seen, sums = [], folded._sums
    monkeypatch.setattr(folded, "_sums", lambda rows, of: seen.append((rows.columns, rows.rdd.getNumPartitions())) or sums(rows, of))
    monkeypatch.setattr(folded, "HELD", 60 * 61 * 4, raising=False)
    got = folded.kernel_machines(rows, landmarks=60, passes=3).toPandas().sort_values(["fit", "row_id"]).p.to_numpy()
    assert np.nanmax(np.abs(got - want)) < 1e-5
    values = [(columns, tasks) for columns, tasks in seen if "z" in columns]
    assert len(values) == 4 and all("row_id" not in columns and tasks == N // 60 for columns, tasks in values)
    assert len([1 for columns, _ in seen if columns == ["n", "x", "roles"]]) == 12


def test_every_named_model_and_one_unknown(rows):
    small = {name: Ensemble(2, 0.1, leaves=3) if s.grow == "leaf" else Ensemble(2, 0.1, depth=2, grow=s.grow) for name, s in models.ENSEMBLES.items()}
    asked = [(r, name, None) for name in models.model_names() for r in range(2)] + [(0, "nothing such", None), (2, "random_forest", (0, 1))]
    with pytest.warns(UserWarning, match="skipped nothing such"):
        got = registry.fit_all(rows, 4, asked, ensembles=small).toPandas()
    sizes = got.groupby("fit").size().to_dict()
    assert sizes == {i: (N // 3, N // 5)[r] for i, (r, name, _) in enumerate(asked[:-2])} | {len(asked) - 1: N // 2}
    assert got.p.between(0, 1).all() and set(got[got.fit == len(asked) - 1].p) == {1.0}


def test_named_settings():
    assert len(models.model_names()) == 9 and set(models.ENSEMBLES) < set(models.model_names())
    pair = models.chained_ensembles()
    assert pair["lightgbm"].leaves == 15 and pair["xgboost"].grow == "level" and pair["extra_trees"].rounds == 180


@pytest.mark.parametrize("most", [models.MOST, 20])
def test_logistic_groups_are_fitted_on_rows_with_counts_or_by_passes(spark, made, most):
    """Repeated rows are one for the fit, of a task or of passes; groups of one class and without training rows."""
    x, y = made
    frames = []
    some = [(i, [float(v) for v in x[i]], int(y[i]), i % 3 == 0) for i in range(N)]
    for copy in range(4):
        frames += [("Q1", "f", i + N * copy, v, t, h) for i, v, t, h in some]
    frames += [("Q2", "f", i, v, 1, h) for i, v, _, h in some[:18]] + [("Q3", "f", i, v, t, True) for i, v, t, _ in some[:5]]
    rows = spark.createDataFrame(frames, "target string, fold string, row_id long, x array<double>, y int, is_valid boolean")
    got = models.logistic_by_group(rows, ["target", "fold"], 40, most).toPandas().sort_values("row_id")
    train = np.arange(N) % 3 > 0
    want = models.predict_logistic(models.fit_logistic(np.tile(x[train], (4, 1)), np.tile(y[train].astype(float), 4), 40), x[~train])
    assert list(got.columns) == ["target", "fold", "row_id", "y", "p"]
    assert np.abs(got[got.target == "Q1"].p.to_numpy() - np.tile(want, 4)).max() < 1e-9
    assert set(got[got.target == "Q2"].p) == {1.0} and len(got[got.target == "Q2"]) == 6
    assert got[got.target == "Q3"].p.isna().all() and len(got[got.target == "Q3"]) == 5
