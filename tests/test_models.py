from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.operators import models
from tempora.operators.models import ha, linear, svr
from tempora.operators.models.gp import rbf
from tempora.operators.models.trees import feature_importances
from tempora.operators.tune import best_params, grid_search, param_combinations, params_table

DAY0 = date(2017, 1, 1)


def make(spark, x, targets):
    """``x`` (days, p) and {series: (days, steps)} as Spark tables."""
    xs = spark.createDataFrame([(DAY0 + timedelta(days=i), [float(v) for v in row]) for i, row in enumerate(x)], "day date, x array<double>")
    ys = spark.createDataFrame([(s, DAY0 + timedelta(days=d), k, float(v)) for s, m in targets.items() for d, row in enumerate(m)
                                for k, v in enumerate(row)], "series_id string, day date, step int, y double")
    return xs, ys


def tensor(pred, n_days, n_steps, param=0):
    out = {}
    for r in pred.where(F.col("param_idx") == param).collect():
        out.setdefault(r.series_id, np.full((n_days, n_steps), np.nan))[(r.day - DAY0).days, r.step] = r.pred
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.integers(0, 3, 60), rng.integers(0, 4, 60), rng.normal(size=60).round(2)]).astype(float)
    ys = {s: np.abs(x @ rng.normal(size=(3, 2)) + rng.normal(scale=0.3, size=(60, 2)) + 3) for s in ("a", "b", "c")}
    return x, ys, *make(spark, x, ys)


def test_registry():
    assert models.get_estimator("lr") is linear
    with pytest.raises(ValueError):
        models.get_estimator("xgb")


def test_average_equals_single_observation(spark):
    """With one row per tuple both methods return the observation."""
    xs, ys = make(spark, [[6, 1, 1], [0, 1, 1]], {"s": [[5.0, 7.5], [2.0, 1.0]]})
    for method in ("mean", "median"):
        got = tensor(models.predict(models.fit("ha", xs, ys, {"method": method}), xs), 2, 2)
        assert got["s"].tolist() == [[5.0, 7.5], [2.0, 1.0]]
    with pytest.raises(ValueError):
        models.fit("ha", xs, ys, {"method": "mode"})


def test_average_skips_null_keys_and_refits(spark):
    xs, ys = make(spark, [[1], [1], [2]], {"s": [[1.0], [3.0], [8.0]]})
    broken = xs.withColumn("x", F.when(F.col("day") == DAY0 + timedelta(days=1), F.array(F.lit(None).cast("double"))).otherwise(F.col("x")))
    old = models.fit("ha", broken, ys)
    assert {r.x[0]: r.pred for r in ha.as_table(old).collect()} == {1.0: 1.0, 2.0: 8.0}
    xs2, ys2 = make(spark, [[1], [3]], {"s": [[10.0], [4.0]]})
    merged = ha.refit(old, models.fit("ha", xs2, ys2))
    assert {r.x[0]: r.pred for r in ha.as_table(merged).collect()} == {1.0: 10.0, 2.0: 8.0, 3.0: 4.0}


def test_average_falls_back_to_nearest(spark):
    xs, ys = make(spark, [[1, 0], [0, 1]], {"s": [[1.0], [2.0]], "t": [[3.0], [4.0]]})
    new = spark.createDataFrame([(DAY0, [5.0, 1.0]), (DAY0 + timedelta(days=1), [0.0, 1.0]), (DAY0 + timedelta(days=2), [2.0, 2.0])], "day date, x array<double>")
    got = tensor(models.predict(models.fit("ha", xs, ys), new), 3, 1)
    assert got["s"][:, 0].tolist() == [1.0, 2.0, 2.0] and got["t"][:, 0].tolist() == [3.0, 4.0, 4.0]


def test_least_squares(data):
    x, ys, xs, yt = data
    got = tensor(models.predict(models.fit("lr", xs, yt), xs), 60, 2)
    a = np.column_stack([np.ones(60), x])
    for s, y in ys.items():
        want = np.maximum(a @ np.linalg.lstsq(a, y, rcond=None)[0], 0)
        assert np.allclose(got[s], want, atol=1e-8)


def test_least_squares_with_dependent_features(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 2))
    x = np.column_stack([base, base.sum(1), np.ones(30)])
    y = {"s": base @ [[1.0], [2.0]] + 5}
    xs, ys = make(spark, x, y)
    assert np.allclose(tensor(models.predict(models.fit("lr", xs, ys), xs, floor=False), 30, 1)["s"], y["s"], atol=1e-6)


def objective(x, y, coef, alpha, ratio, fit_intercept, normalize):
    """The penalised error of a solution, in the columns that the solver saw."""
    width = np.linalg.norm(x - x.mean(0), axis=0) if normalize and fit_intercept else np.ones(x.shape[1])
    w = coef[1:] * width
    r = y - coef[0] - x @ coef[1:]
    return r @ r / 2 / len(y) + alpha * ratio * np.abs(w).sum() + alpha * (1 - ratio) * w @ w / 2


@pytest.mark.parametrize("n, p", [(60, 3), (25, 90)])
@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("normalize", [True, False])
def test_elastic_net_is_one_solver_for_all_widths(n, p, intercept, normalize):
    """Against proximal steps, and by its own duality gap."""
    rng = np.random.default_rng(p)
    x = rng.normal(size=(n, p)) * rng.uniform(0.5, 3, p) + 1
    y = x[:, :3] @ np.array([[1.0, -2], [0.5, 0], [0, 3]]) + rng.normal(size=(n, 2)) + 4
    alpha, ratio = (0.02, 0.5) if normalize and intercept else (0.3, 0.5)
    got = linear.solve_batch("en", x, y.T, intercept, normalize, alpha=alpha, l1_ratio=ratio, tol=1e-9, max_iter=20_000)
    mx, my = (x.mean(0), y.mean(0)) if intercept else (np.zeros(p), np.zeros(2))
    c = x - mx
    width = np.linalg.norm(c, axis=0) if normalize and intercept else np.ones(p)
    z = c / width
    step, w = 1 / (np.linalg.norm(z, 2) ** 2 / n + alpha * (1 - ratio)), np.zeros((p, 2))
    for _ in range(60_000):
        w = w - step * (z.T @ (z @ w - (y - my)) / n + alpha * (1 - ratio) * w)
        w = np.sign(w) * np.maximum(np.abs(w) - step * alpha * ratio, 0)
    for k in range(2):
        best = objective(x, y[:, k], np.r_[my[k] - mx @ (w[:, k] / width), w[:, k] / width], alpha, ratio, intercept, normalize)
        assert objective(x, y[:, k], got[k], alpha, ratio, intercept, normalize) <= best * (1 + 1e-7) + 1e-9
    own = (got[:, 1:] * width).T
    assert (linear.duality_gap(z, y - my, own, alpha * ratio * n, alpha * (1 - ratio) * n) <= 1e-6 * ((y - my) ** 2).sum(0)).all()


def test_ridge_is_closed_on_both_sides():
    rng = np.random.default_rng(3)
    for n, p in ((40, 6), (12, 50)):
        x, y = rng.normal(size=(n, p)), rng.normal(size=(n, 3))
        got = linear.elastic_net(x, y, alpha=0.2, l1_ratio=0)
        assert np.allclose(got, np.linalg.solve(x.T @ x + 0.2 * n * np.eye(p), x.T @ y))


def test_wide_days_search_and_predict(spark):
    """The width of the widest workload, with folds: no size is refused and least squares meets the training days."""
    rng = np.random.default_rng(11)
    n, p = 731, 7_977
    flags = rng.random((n, p)) < 0.01
    days = spark.createDataFrame([(DAY0 + timedelta(days=i), np.flatnonzero(row).tolist()) for i, row in enumerate(flags)], "day date, on array<int>")
    idx = F.sequence(F.lit(0), F.lit(p - 1))
    xs = days.select("day", F.transform(idx, lambda j: F.array_contains("on", j).cast("double")).alias("x"))
    xs = models_store(xs)
    y = flags[:, :5] @ np.array([4.0, -3, 2, 5, 1]) + 10
    _, ys = make(spark, [[0.0]] * n, {"s": [[v] for v in y]})
    fitted = models.fit("lr", xs, ys)
    assert np.allclose(tensor(models.predict(fitted, xs), n, 1)["s"][:, 0], y, atol=1e-6)
    cv = grid_search("en", xs, ys, [{"alpha": 0.01, "l1_ratio": 1.0}], n_splits=5, train_score=False).collect()
    assert len(cv) == 5 and min(r.score for r in cv) > 0.5


def models_store(df):
    from tempora.session import materialize
    return materialize(df, "x")


def test_series_with_fewer_days_gets_its_own_solution(data):
    x, ys, xs, yt = data
    part = yt.where((F.col("series_id") != "a") | (F.dayofmonth("day") % 2 == 0))
    got = {(r.series_id, r.step): r.coef for r in models.fit("lr", xs, part).tables["model"].collect()}
    keep = np.array([(DAY0 + timedelta(days=i)).day % 2 == 0 for i in range(60)])
    for s in ("a", "b"):
        rows = keep if s == "a" else np.ones(60, bool)
        a = np.column_stack([np.ones(rows.sum()), x[rows]])
        assert np.allclose(got[s, 1], np.linalg.lstsq(a, ys[s][rows, 1], rcond=None)[0], atol=1e-8)


def test_elastic_net_optimality(data):
    x, ys, xs, yt = data
    grid = [{"alpha": a, "l1_ratio": r, "tol": 1e-8} for a in (0.01, 0.2) for r in (0.25, 1.0)]
    rows = models.fit("en", xs, yt, grid).tables["model"].collect()
    assert len(rows) == 3 * 2 * 4
    for r in rows:
        p, w = grid[r.param_idx], np.array(r.coef[1:])
        res = ys[r.series_id][:, r.step] - r.coef[0] - x @ w
        g = x.T @ res / 60
        assert abs(res.mean()) < 1e-6
        l1, l2 = p["alpha"] * p["l1_ratio"], p["alpha"] * (1 - p["l1_ratio"])
        for gj, wj in zip(g, w):
            assert abs(gj) <= l1 + 1e-5 if wj == 0 else abs(gj - l1 * np.sign(wj) - l2 * wj) < 1e-5


def test_elastic_net_normalised_columns(data):
    x, ys, xs, yt = data
    row = models.fit("en", xs, yt, {"alpha": 0.02, "l1_ratio": 0.5, "normalize": True, "tol": 1e-8}).tables["model"].where(
        "series_id = 'a' and step = 0").first()
    c = x - x.mean(0)
    z = c / np.linalg.norm(c, axis=0)
    w = np.array(row.coef[1:]) * np.linalg.norm(c, axis=0)
    y = ys["a"][:, 0]
    g = z.T @ (y - y.mean() - z @ w) / 60
    for gj, wj in zip(g, w):
        assert abs(gj) <= 0.01 + 1e-6 if wj == 0 else abs(gj - 0.01 * np.sign(wj) - 0.01 * wj) < 1e-6


def test_gaussian_process_collapse_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (80, 2)).astype(float)
    y = {"s": rng.normal(5, 1, (80, 2)), "t": rng.normal(9, 2, (80, 2))}
    xs, ys = make(spark, x, y)
    grid = [{"alpha": 0.5, "normalize_y": True}, {"alpha": 0.1, "normalize_y": False}]
    pred = models.predict(models.fit("gp", xs, ys, grid), xs, floor=False)
    k = rbf(x, x)
    for i, p in enumerate(grid):
        got = tensor(pred, 80, 2, i)
        for s in y:
            centre = y[s].mean(0) if p["normalize_y"] else 0.0
            want = k @ np.linalg.solve(k + p["alpha"] * np.eye(80), y[s] - centre) + centre
            assert np.allclose(got[s], want, atol=1e-8)


def test_support_vectors_meet_their_conditions(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 3, (90, 2))
    y = np.sin(x[:, 0]) * 3 + x[:, 1] + rng.normal(0, 0.2, 90)
    for params in ({"kernel": "rbf", "gamma": 0.7}, {"kernel": "linear"}):
        k = svr.kernel_matrix(x, x, params)
        beta, b, _ = svr.solve_dual(k, y, c=2.0, epsilon=0.1, tol=1e-5)
        f = k @ beta + b
        assert abs(beta.sum()) < 1e-9 and np.abs(beta).max() <= 2.0 + 1e-12
        r = y - f
        assert np.all(np.abs(r[beta == 0]) <= 0.1 + 1e-4)
        inner = (np.abs(beta) > 1e-9) & (np.abs(beta) < 2.0 - 1e-9)
        assert np.allclose(r[inner], 0.1 * np.sign(beta[inner]), atol=1e-4)
        assert np.all(r[beta >= 2.0 - 1e-9] >= 0.1 - 1e-4) and np.all(r[beta <= -2.0 + 1e-9] <= -0.1 + 1e-4)


def mean_error(got, want):
    return np.mean([np.abs(got[s] - want[s]).mean() for s in want])


@pytest.mark.parametrize("choice, params", [
    ("rf", {"n_estimators": 20, "max_depth": 6, "random_state": 1}), ("gbr", {"estimator__n_estimators": 10, "estimator__max_depth": 3}),
    ("svr", {"estimator__C": 10.0, "estimator__gamma": 0.5}), ("gp", {"alpha": 0.1})])
def test_models_beat_the_mean(data, choice, params):
    x, ys, xs, yt = data
    fitted = models.fit(choice, xs, yt, params)
    got = tensor(models.predict(fitted, xs), 60, 2)
    assert all(np.isfinite(v).all() and (v >= 0).all() for v in got.values())
    assert mean_error(got, ys) < mean_error({s: np.broadcast_to(v.mean(0), v.shape) for s, v in ys.items()}, ys)


@pytest.mark.parametrize("choice", ["ha", "lr", "gp", "svr", "rf"])
def test_model_store(spark, data, tmp_path, choice):
    _, _, xs, yt = data
    fitted = models.fit(choice, xs, yt, {"max_depth": 3, "n_estimators": 3} if choice == "rf" else None)
    path = str(tmp_path / choice)
    models.save_model(fitted, path, infos={"model_name": "m"})
    loaded = models.load_model(spark, path)
    a, b = (tensor(models.predict(m, xs), 60, 2) for m in (fitted, loaded))
    assert all(np.allclose(a[s], b[s], equal_nan=True) for s in a)
    with pytest.raises(Exception):
        models.save_model(fitted, path)
    models.save_model(fitted, path, force=True)


def test_grid_search_finds_the_single_point(data):
    _, _, xs, yt = data
    cv = grid_search("ha", xs.withColumn("x", F.slice("x", 1, 1)), yt, [{"method": "median"}], n_splits=3)
    assert {(r.split, r.fold) for r in cv.collect()} == {(s, f) for s in ("test", "train") for f in range(3)}
    assert {r.param_idx for r in best_params(cv).collect()} == {0}


def fold_scores(x, y, solve, n_splits):
    out = []
    for held in np.array_split(np.arange(len(x)), n_splits):
        rest = np.setdiff1d(np.arange(len(x)), held)
        p = solve(x[rest], y[rest], x[held])
        out.append(np.mean(1 - ((y[held] - p) ** 2).sum(0) / ((y[held] - y[held].mean(0)) ** 2).sum(0)))
    return out


@pytest.mark.parametrize("choice", ["lr", "gp", "svr"])
def test_grid_search_scores(data, choice):
    x, ys, xs, yt = data

    def solve_lr(a, b, new):
        one = lambda m: np.column_stack([np.ones(len(m)), m])
        return one(new) @ np.linalg.lstsq(one(a), b, rcond=None)[0]

    def solve_gp(a, b, new):
        return rbf(new, a) @ np.linalg.solve(rbf(a, a) + 0.3 * np.eye(len(a)), b)

    def solve_svr(a, b, new):
        p = {"gamma": 0.5}
        cols = [svr.solve_dual(svr.kernel_matrix(a, a, p), b[:, j], 1.0, 0.1) for j in range(b.shape[1])]
        return np.column_stack([svr.kernel_matrix(new, a, p) @ beta + off for beta, off, _ in cols])

    grid = {"lr": [{}], "gp": [{"alpha": 5.0}, {"alpha": 0.3}], "svr": [{"gamma": 0.5}]}[choice]
    solve = {"lr": solve_lr, "gp": solve_gp, "svr": solve_svr}[choice]
    cv = grid_search(choice, xs, yt, grid, n_splits=4).where("split = 'test'").toPandas()
    assert len(cv) == 3 * 4 * len(grid)
    for s, y in ys.items():
        got = cv[(cv.series_id == s) & (cv.param_idx == len(grid) - 1)].sort_values("fold")["score"]
        assert np.allclose(got, fold_scores(x, y, solve, 4), atol=1e-6)


def test_elastic_net_search_picks_small_penalty(data):
    _, _, xs, yt = data
    grid = {"alpha": [0.001, 10.0], "l1_ratio": [0.5]}
    best = best_params(grid_search("en", xs, yt, grid, n_splits=3, train_score=False))
    assert {r.param_idx for r in best.collect()} == {0}
    assert param_combinations(grid)[0] == {"alpha": 0.001, "l1_ratio": 0.5}


def test_forest_search_runs(data):
    _, _, xs, yt = data
    cv = grid_search("rf", xs, yt, [{"max_depth": 2, "n_estimators": 3}], n_splits=2, train_score=False)
    assert cv.count() == 3 * 2


def test_chosen_parameters_per_series(spark, data):
    _, _, xs, yt = data
    chosen = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1)], "series_id string, param_idx int")
    for choice, grid in (("ha", [{"method": "mean"}, {"method": "median"}]), ("en", [{"alpha": 0.1}, {"alpha": 1.0}])):
        got = models.fit(choice, xs, yt, grid, chosen=chosen).tables["model"].select("series_id", "param_idx").distinct().collect()
        assert sorted((r.series_id, r.param_idx) for r in got) == [("a", 1), ("b", 0), ("c", 1)]


def test_params_table(spark):
    rows = params_table(spark, {"b": [1], "a": ["x", "y"]}).orderBy("param_idx").collect()
    assert [r.params for r in rows] == [{"a": "x", "b": "1"}, {"a": "y", "b": "1"}]


def test_targets_on_days_without_features_are_left_out(spark):
    xs, ys = make(spark, [[float(i)] for i in range(8)], {"s": [[1.0 + 2 * i] for i in range(8)]})
    some = xs.where(F.col("day") >= DAY0 + timedelta(days=3))
    for choice, params in (("lr", {}), ("en", {"alpha": 1e-9})):
        got = tensor(models.predict(models.fit(choice, some, ys, params), xs), 8, 1)
        assert np.allclose(got["s"][:, 0], [1.0 + 2 * i for i in range(8)], atol=1e-3)
    assert np.isfinite(tensor(models.predict(models.fit("svr", some, ys, {"estimator__C": 1.0}), some), 8, 1)["s"][3:]).all()


def test_process_counts_each_series_own_days(spark):
    x = [[0.0], [0.0], [1.0], [1.0], [2.0]]
    xs, ys = make(spark, x, {"s": [[1.0], [3.0], [5.0], [6.0], [9.0]], "t": [[2.0], [2.0], [4.0], [4.0], [1.0]]})
    holed = ys.where(~((F.col("series_id") == "s") & F.col("day").isin(DAY0, DAY0 + timedelta(days=4))))
    got = tensor(models.predict(models.fit("gp", xs, holed, {"alpha": 0.5}), xs), 5, 1)["s"][:, 0]
    own, y = np.array([0.0, 1.0, 1.0]), np.array([3.0, 5.0, 6.0])
    kernel = lambda a, b: np.exp(-(a[:, None] - b[None, :]) ** 2 / 2)
    want = kernel(np.array([0.0, 0, 1, 1, 2]), own) @ np.linalg.solve(kernel(own, own) + 0.5 * np.eye(3), y)
    assert np.allclose(got, want)


def test_trees_serve_opposite_series_and_all_steps(spark):
    xs, ys = make(spark, [[float(i % 2)] for i in range(20)], {"s": [[10.0, 0.0]] * 20, "t": [[0.0, 10.0]] * 20})
    for choice, params in (("rf", {"n_estimators": 5, "random_state": 1}), ("gbr", {"estimator__n_estimators": 20})):
        got = tensor(models.predict(models.fit(choice, xs, ys, params), xs), 20, 2)
        assert np.allclose(got["s"], [10, 0]) and np.allclose(got["t"], [0, 10])


@pytest.mark.parametrize("choice, params", [
    ("rf", {"nonsense": 1}), ("rf", {"criterion": "mae"}), ("rf", {"max_leaf_nodes": 4}), ("gbr", {"loss": "huber"}), ("lr", {"alpha": 1}), ("en", {"nonsense": 1}),
    ("gp", {"kernel": "rbf"}), ("gp", {"nonsense": 1}), ("svr", {"nonsense": 1}), ("svr", {"kernel": "poly"})])
def test_unknown_parameters_are_errors(data, choice, params):
    with pytest.raises(ValueError):
        models.fit(choice, data[2], data[3], params)


def best_cut(x, y, min_leaf=1):
    """By trying all: the first of the best (gain, feature, threshold)."""
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[:-1] + v[1:]) / 2:
            a, b = y[x[:, f] <= t], y[x[:, f] > t]
            if min(len(a), len(b)) >= min_leaf:
                gain = ((y - y.mean(0)) ** 2).sum() - ((a - a.mean(0)) ** 2).sum() - ((b - b.mean(0)) ** 2).sum()
                if gain > best[0] + 1e-9:
                    best = (gain, f, t)
    return best


def brute_tree(x, y, new, depth=None, min_split=2, min_leaf=1):
    if len(y) < min_split or depth == 0 or ((y - y.mean(0)) ** 2).sum() < 1e-12:
        return np.tile(y.mean(0), (len(new), 1))
    _, f, t = best_cut(x, y, min_leaf)
    if f is None:
        return np.tile(y.mean(0), (len(new), 1))
    left, out = x[:, f] <= t, np.empty((len(new), y.shape[1]))
    deeper = None if depth is None else depth - 1
    goes = new[:, f] <= t
    out[goes] = brute_tree(x[left], y[left], new[goes], deeper, min_split, min_leaf)
    out[~goes] = brute_tree(x[~left], y[~left], new[~goes], deeper, min_split, min_leaf)
    return out


@pytest.mark.parametrize("params", [{}, {"max_depth": 1}, {"max_depth": 3, "min_samples_leaf": 4}, {"min_samples_split": 15}, {"min_samples_split": 0.3}])
def test_one_tree_by_brute_force(data, params):
    x, ys, xs, yt = data
    fitted = models.fit("rf", xs, yt, {"n_estimators": 1, "bootstrap": False, **params})
    got = tensor(models.predict(fitted, xs), 60, 2)
    split = params.get("min_samples_split", 2)
    for s, y in ys.items():
        want = brute_tree(x, y, x, params.get("max_depth"), 18 if split == 0.3 else split, params.get("min_samples_leaf", 1))
        assert np.allclose(got[s], np.maximum(want, 0), atol=1e-9)


def test_boosting_by_brute_force(data):
    x, ys, xs, yt = data
    got = tensor(models.predict(models.fit("gbr", xs, yt, {"estimator__n_estimators": 4, "estimator__learning_rate": 0.3, "estimator__max_depth": 2}), xs), 60, 2)
    for s, y in ys.items():
        want = np.tile(y.mean(0), (60, 1))
        for _ in range(4):
            for k in range(2):
                want[:, k] += 0.3 * brute_tree(x, (y - want)[:, k:k + 1], x, 2)[:, 0]
        assert np.allclose(got[s], np.maximum(want, 0), atol=1e-9)


def test_trees_draw_features_and_rows(data):
    x, ys, xs, yt = data
    params = {"n_estimators": 12, "max_features": 1, "random_state": 3}
    a, b = (tensor(models.predict(models.fit("rf", df, yt, params), xs), 60, 2) for df in (xs, xs.repartition(5)))
    assert all(np.allclose(a[s], b[s]) for s in a)  # the same however the days lie
    fitted = models.fit("rf", xs, yt, params)
    rows = feature_importances(fitted, ["u", "v", "w"]).collect()
    assert len(rows) == 9 and all(r.percent > 0 for r in rows)
    assert all(abs(sum(r.percent for r in rows if r.series_id == s) - 100) < 0.1 for s in ys)
    used = {f for r in fitted.tables["model"].collect() for f in r.feature}
    assert used == {-1, 0, 1, 2} and fitted.tables["model"].count() == 3 * 12


def test_trees_and_vectors_of_series_with_missing_days(data):
    x, ys, xs, yt = data
    holed = yt.where((F.col("series_id") != "a") | (F.dayofmonth("day") % 3 != 0))
    keep = np.array([(DAY0 + timedelta(days=i)).day % 3 != 0 for i in range(60)])
    got = tensor(models.predict(models.fit("rf", xs, holed, {"n_estimators": 1, "bootstrap": False, "max_depth": 2}), xs), 60, 2)
    assert np.allclose(got["a"], brute_tree(x[keep], ys["a"][keep], x, 2)) and np.allclose(got["b"], brute_tree(x, ys["b"], x, 2))
    fitted = models.fit("svr", xs, holed, {"C": 2.0, "gamma": 0.4, "tol": 1e-6})
    got = tensor(models.predict(fitted, xs, floor=False), 60, 2)
    for s, own in (("a", keep), ("b", np.ones(60, bool))):
        k = svr.kernel_matrix(x, x[own], {"gamma": 0.4})
        beta, b, done = svr.solve_dual(k[own], ys[s][own, 1], 2.0, 0.1, 1e-6)
        assert done and np.allclose(got[s][:, 1], k @ beta + b, atol=1e-4)
    assert {r.converged for r in fitted.tables["model"].collect()} == {True}
    assert not svr.solve_dual(k, ys["b"][:, 1], 2.0, 0.1, 1e-6, max_iter=3)[2]
