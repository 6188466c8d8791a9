"""Random forest and gradient boosting, one model per series (and per step for boosting), as a table of trees.

A forest's tree has all steps of a series as outputs and splits where their summed squared errors fall most; boosting
grows one small tree after another on the residuals of one step. Trees are grown level by level: all open nodes of a
level are cut by one histogram of (node, feature, bin), where the bins of a feature are its distinct values among the
days, so every cut between two values is tried. Models are dealt to blocks (:mod:`.arrays`), the trees of a forest in
groups where there are fewer models than tasks; folds, series and parameters are rows, nothing loops over them in the
driver.

``trees`` has a row per tree: (units, param_idx, tree, steps, feature, threshold, left, right, value, gain). Nodes are
numbered from 0, the root; a leaf has feature -1. ``value`` holds each node's values for all steps one after another,
already divided by the number of trees or multiplied by the learning rate, so a prediction is the sum over a model's
trees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .arrays import (by_param, check_finite, check_params, count_models, day_rows, in_blocks, long_rows, matrix, on_days, shape, target_vectors, unit_schema,
                     with_params)
from .base import Fitted

# Parameters, and settings that must have the value named.
_USED = {"rf": {"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "max_features", "bootstrap", "random_state"},
         "gbr": {"n_estimators", "learning_rate", "subsample", "max_depth", "min_samples_split", "min_samples_leaf", "max_features", "random_state"}}
_SQUARED = ("mse", "squared_error", "friedman_mse")
_ALWAYS = {"criterion": _SQUARED, "max_leaf_nodes": (None,), "min_weight_fraction_leaf": (0, 0.0), "min_impurity_decrease": (0, 0.0),
           "min_impurity_split": (None,), "n_jobs": None, "verbose": None, "warm_start": (False,), "ccp_alpha": (0, 0.0)}
_WITHOUT_EFFECT = {"rf": {**_ALWAYS, "oob_score": (False,), "max_samples": (None,)},
                   "gbr": {**_ALWAYS, "loss": ("ls", "squared_error"), "init": (None,), "alpha": None, "presort": None,
                           "n_iter_no_change": (None,), "validation_fraction": None, "tol": None}}
_DEFAULTS = {"rf": {"n_estimators": 100, "max_depth": None, "bootstrap": True}, "gbr": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0}}


def settings(choice: str, params: dict) -> dict:
    """The parameters of a model with their defaults."""
    out = {"min_samples_split": 2, "min_samples_leaf": 1, "max_features": None, "random_state": None, **_DEFAULTS[choice],
           **{k: v for k, v in params.items() if k in _USED[choice]}}
    out["random_state"] = 0 if out["random_state"] is None else int(out["random_state"])
    return out


def _count(value, n: int, least: int) -> int:
    """A number of rows given as such or as a share of all."""
    return max(least, math.ceil(value * n)) if isinstance(value, float) and value < 1 else max(least, int(value))


def _n_features(value, p: int) -> int:
    if value is None or value == "auto":
        return p
    if value in ("sqrt", "log2"):
        return max(1, int(math.sqrt(p) if value == "sqrt" else math.log2(p)))
    return max(1, int(value * p)) if isinstance(value, float) else min(p, int(value))


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def add(self, values: np.ndarray) -> np.ndarray:
        """New leaves with these values; their numbers."""
        first = len(self.feature)
        for v in values:
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.gain.append(0.0)
            self.value.append(v)
        return np.arange(first, first + len(values))


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    feature, threshold = np.array(tree.feature), np.array(tree.threshold)
    left, right = np.array(tree.left), np.array(tree.right)
    node = np.zeros(len(x), int)
    while True:
        inner = np.flatnonzero(feature[node] >= 0)
        if not len(inner):
            return node
        at = node[inner]
        node[inner] = np.where(x[inner, feature[at]] <= threshold[at], left[at], right[at])


def bins_of(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The place of each value among the sorted distinct values of its feature, and these."""
    values, places = [], np.empty(x.shape, np.int64)
    for j in range(x.shape[1]):
        own, places[:, j] = np.unique(x[:, j], return_inverse=True)
        values.append(own)
    return places, values


def grow(bins: np.ndarray, values: list[np.ndarray], y: np.ndarray, w: np.ndarray, max_depth: int | None, min_split: int, min_leaf: int,
         n_features: int, rng: np.random.Generator) -> Tree:
    """A tree for targets y (rows, outputs) with weights w, 0 for rows left out.

    A node is cut at the smallest threshold of the first feature where the summed squared error falls most; ``n_features``
    features that vary in the node are tried, drawn anew for each.
    """
    p, outputs = bins.shape[1], y.shape[1]
    width = max(map(len, values), default=1)
    tree = Tree()
    rows = np.flatnonzero(w > 0)
    mean = (w[rows] @ y[rows]) / w[rows].sum()
    tree.add(mean[None, :])
    floor = 1e-12 * max(1e-300, float(w[rows] @ ((y[rows] - mean) ** 2).sum(1)))
    node, depth = np.zeros(len(rows), int), 0  # node: place of each row among the open nodes
    names = np.zeros(1, int)
    while len(rows) and p and (max_depth is None or depth < max_depth):
        q = len(names)
        yw = y[rows] * w[rows][:, None]
        count, weight = np.bincount(node, minlength=q), np.bincount(node, w[rows], q)
        total = np.stack([np.bincount(node, yw[:, s], q) for s in range(outputs)], 1)
        spread = np.bincount(node, (yw * y[rows]).sum(1), q) - (total ** 2).sum(1) / weight
        fit = (count >= min_split) & (spread > floor)
        keep = fit[node]
        rows, node, yw = rows[keep], node[keep], yw[keep]
        if not len(rows):
            break
        code = ((node[:, None] * p + np.arange(p)) * width + bins[rows]).ravel()
        cell, which = np.unique(code, return_inverse=True)
        each = np.repeat(np.arange(len(rows)), p)
        n_cell, w_cell = np.bincount(which), np.bincount(which, w[rows][each])
        s_cell = np.stack([np.bincount(which, yw[each, s]) for s in range(outputs)], 1)
        segment, place = cell // width, cell % width
        start = np.flatnonzero(np.diff(segment, prepend=-1))
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(cell))))

        def upto(v: np.ndarray) -> np.ndarray:
            """Running sums within a node and feature."""
            c = np.cumsum(v, 0)
            return c - (c[start] - v[start])[run]

        ln, lw, ls = upto(n_cell), upto(w_cell), upto(s_cell)
        own = segment // p
        rn, rw, rs = count[own] - ln, weight[own] - lw, total[own] - ls
        last = np.append(segment[1:] != segment[:-1], True)
        valid = ~last & (ln >= min_leaf) & (rn >= min_leaf)
        gain = np.full(len(cell), -np.inf)
        gain[valid] = ((ls[valid] ** 2).sum(1) / lw[valid] + (rs[valid] ** 2).sum(1) / rw[valid] - (total[own[valid]] ** 2).sum(1) / weight[own[valid]])
        if n_features < p:
            varies = np.zeros((q, p), bool)
            varies.ravel()[segment[~last]] = True
            draw = np.where(varies, rng.random((q, p)), 2.0)
            drawn = draw.argsort(1, kind="stable").argsort(1, kind="stable") < n_features
            gain[~drawn.ravel()[segment]] = -np.inf
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        best = np.maximum.reduceat(gain, heads)
        node_run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(cell))))
        # of equal gains the first in order of feature and value
        good = np.isfinite(gain) & (gain >= best[node_run] - 1e-9 * np.abs(spread[own]))
        first = np.full(len(heads), -1)
        at = np.flatnonzero(good)[::-1]
        first[node_run[at]] = at
        cut = first[first >= 0]
        if not len(cut):
            break
        feature, threshold = segment[cut] % p, np.array([(values[segment[c] % p][place[c]] + values[segment[c] % p][place[c + 1]]) / 2 for c in cut])
        parents = own[cut]
        lefts = tree.add(ls[cut] / lw[cut][:, None])
        rights = tree.add(rs[cut] / rw[cut][:, None])
        slot = np.full(q, -1)
        slot[parents] = np.arange(len(cut))
        for k, name in enumerate(names[parents]):
            tree.feature[name], tree.threshold[name], tree.gain[name] = int(feature[k]), float(threshold[k]), float(max(gain[cut[k]], 0.0))
            tree.left[name], tree.right[name] = int(lefts[k]), int(rights[k])
        held = slot[node]
        rows, held = rows[held >= 0], held[held >= 0]
        goes_left = bins[rows, feature[held]] <= place[cut][held]
        node = np.where(goes_left, held, held + len(cut))
        names = np.concatenate([lefts, rights])
        depth += 1
    return tree


def forest(x: np.ndarray, y: np.ndarray, p: dict, trees: range) -> list[Tree]:
    """The trees with these numbers; each depends on the seed and its number alone."""
    bins, values = bins_of(x)
    n = len(y)
    out = []
    for t in trees:
        rng = np.random.default_rng([p["random_state"], t])
        w = np.bincount(rng.integers(0, n, n), minlength=n).astype(float) if p["bootstrap"] else np.ones(n)
        tree = grow(bins, values, y, w, p["max_depth"], _count(p["min_samples_split"], n, 2), _count(p["min_samples_leaf"], n, 1),
                       _n_features(p["max_features"], x.shape[1]), rng)
        tree.value = [v / p["n_estimators"] for v in tree.value]
        out.append(tree)
    return out


def boosted(x: np.ndarray, y: np.ndarray, p: dict) -> list[Tree]:
    """The mean of the targets y (rows,) as a leaf, then a tree for the residuals of each stage."""
    bins, values = bins_of(x)
    n = len(y)
    first = Tree()
    first.add(np.array([[y.mean()]]))
    out, rest = [first], y - y.mean()
    rng = np.random.default_rng([p["random_state"], 1])
    for _ in range(p["n_estimators"]):
        w = np.ones(n)
        if p["subsample"] < 1:
            w[rng.permutation(n)[max(1, int(p["subsample"] * n)):]] = 0.0
        tree = grow(bins, values, rest[:, None], w, p["max_depth"], _count(p["min_samples_split"], n, 2), _count(p["min_samples_leaf"], n, 1),
                       _n_features(p["max_features"], x.shape[1]), rng)
        tree.value = [v * p["learning_rate"] for v in tree.value]
        rest = rest - np.array(tree.value)[leaves(tree, x), 0]
        out.append(tree)
    return out


_TREE = ["tree", "steps", "feature", "threshold", "left", "right", "value", "gain"]


def _row(number: int, steps: list[int], tree: Tree) -> tuple:
    return (number, steps, tree.feature, tree.threshold, tree.left, tree.right, np.concatenate(tree.value), tree.gain)


def fit(choice: str, x: DataFrame, y: DataFrame, grid: list[dict], units: list[str], sets: list[str],
        chosen: DataFrame | None) -> Fitted:
    """A forest learns from the days on which a series has all of its steps, a boosted model from its step's own days."""
    check_params(choice, grid, _USED[choice], _WITHOUT_EFFECT[choice])
    plain = [settings(choice, p) for p in grid]
    n, _ = shape(x, sets)
    vectors = with_params(target_vectors(on_days(y, x, sets), units), grid, units, chosen)
    n_models = count_models(y, n)
    most = max(p["n_estimators"] for p in plain)
    used = 1 if chosen is not None else len(grid)
    slots = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = min(most, max(1, slots // n_models)) if choice == "rf" else 1
    if groups > 1:
        vectors = vectors.withColumn("trees", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    else:
        vectors = vectors.withColumn("trees", F.lit(0))

    def solve(days: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        place, data = matrix(days)
        out = []
        keys = [*units, "trees"] if choice == "rf" else [*units, "step"]
        for key, at in block.groupby(keys).indices.items():
            key = key if isinstance(key, tuple) else (key,)
            own = block.iloc[at].sort_values("step")
            known = set(place.tolist())
            common = sorted(set.intersection(known, *[set(map(int, d)) for d in own["days"]]))
            if not common:
                continue
            ys = check_finite(np.array([np.asarray(v)[np.isin(d, common)] for d, v in zip(own["days"], own["ys"])], dtype=float).T)
            features = data[np.searchsorted(place, common)]
            steps = own["step"].tolist()
            for i, _ in by_param(own, np.arange(1)):
                p = plain[i]
                if choice == "rf":
                    numbers = range(key[-1], p["n_estimators"], groups)
                    grown = forest(features, ys, p, numbers)
                else:
                    numbers, grown = range(p["n_estimators"] + 1), boosted(features, ys[:, 0], p)
                out += [(*key[:len(units)], i, *_row(t, steps, tree)) for t, tree in zip(numbers, grown)]
        return pd.DataFrame(out, columns=[*units, "param_idx", *_TREE])

    schema = (f"{unit_schema(y, units)}, param_idx int, tree int, steps array<int>, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
              "value array<double>, gain array<double>")
    dealt = [*units, "trees"] if choice == "rf" else [*units, "step"]
    cells = n * (1 + used * (most // max(1, groups) + 1) // 4)
    table = in_blocks(day_rows(x, sets), vectors, sets, dealt, n_models * groups, cells, solve, schema)
    return Fitted(choice, {"model": table}, grid, units, sets)


def predict(fitted: Fitted, x_new: DataFrame) -> DataFrame:
    """The sum over the trees of each model, block by block."""
    units, model = fitted.units, fitted.tables["model"]
    n, p = shape(x_new, fitted.sets)
    models = model.groupBy(*units, "param_idx", "steps").count().agg(F.count(F.lit(1)), F.max("count"), F.max(F.size("steps"))).first()

    def add_up(days: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        place, data = matrix(days)
        out = []
        block = block.assign(first=block["steps"].map(lambda s: s[0]))
        for _, at in block.groupby([*units, "param_idx", "first"]).indices.items():
            own = block.iloc[at].sort_values("tree")
            steps = list(own["steps"].iat[0])
            total = np.zeros((len(place), len(steps)))
            for r in own.itertuples():
                tree = Tree(*[list(v) for v in (r.feature, r.threshold, r.left, r.right)])
                total += np.asarray(r.value).reshape(-1, len(steps))[leaves(tree, data)]
            head = own.iloc[np.zeros(len(steps), int)][[*units, "param_idx"]].assign(step=steps)
            out.append(long_rows(head[[*units, "param_idx", "step"]], place, total.T))
        return pd.concat(out)

    schema = f"{unit_schema(model, [*units, 'param_idx'])}, step int, d int, pred double"
    cells = (models[1] or 1) * 64 + n * (models[2] or 1)
    out = in_blocks(day_rows(x_new, fitted.sets), model, fitted.sets, [*units, "param_idx", "steps"], models[0] or 1, cells, add_up, schema)
    return out.select(*units, "param_idx", F.date_from_unix_date("d").alias("day"), "step", "pred")


def feature_importances(fitted: Fitted, names: list[str]) -> DataFrame:
    """(units, param_idx, feature, percent): shares of the fall in squared error by feature, rounded to 2 decimals.

    Shares are taken per tree and averaged over the trees that split; features without a split have 0.
    """
    units = fitted.units
    key = [*units, "param_idx"]
    cells = fitted.tables["model"].select(*key, "steps", "tree", F.explode(F.arrays_zip("feature", "gain")).alias("c")).where("c.feature >= 0")
    by_tree = cells.groupBy(*key, "steps", "tree", F.col("c.feature").alias("f")).agg(F.sum("c.gain").alias("gain"))
    totals = by_tree.groupBy(*key, "steps", "tree").agg(F.sum("gain").alias("all"), F.map_from_entries(F.collect_list(F.struct("f", "gain"))).alias("by"))
    share = F.when(F.col("all") > 0, F.coalesce(F.element_at("by", F.col("f")), F.lit(0.0)) / F.col("all"))
    labels = F.array(*[F.struct(F.lit(i).alias("f"), F.lit(name).alias("feature")) for i, name in enumerate(names)])
    spread = totals.withColumn("l", F.explode(labels)).select(*key, "all", "by", "l.f", "l.feature")
    return spread.groupBy(*key, "feature").agg(F.bround(100 * F.avg(share), 2).alias("percent"))
