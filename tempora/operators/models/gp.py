"""Gaussian process mean with the kernel 1 * RBF(1) and noise ``alpha`` on the diagonal.

Days with equal features are collapsed: the mean on distinct tuples with the noise divided by their number of days is
the same mean. With K the kernel of the tuples and N their day counts the dual is
``N^0.5 (N^0.5 K N^0.5 + alpha)^-1 N^0.5 (m - centre)``, m the mean targets of the tuples. All models of a block
(:mod:`.arrays`) with the same days and the same ``alpha`` are right sides of one positive definite system; the kernel
is made in the task that needs it, from the rows of its set. A series with missing days has its own counts and so its
own system. A task's memory grows with the squared number of distinct tuples of calendar days, not with the series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .arrays import (alike, by_param, check_params, count_models, day_rows, in_blocks, long_rows, matrix, on_days, shape, target_vectors,
                     unit_schema, with_params)
from .base import Fitted

# Parameters; the only kernel; those without effect, as the kernel has nothing to optimise.
_USED = {"alpha", "normalize_y"}
_WITHOUT_EFFECT = {"kernel": (None,), "optimizer": None, "n_restarts_optimizer": None, "copy_X_train": None, "random_state": None}


def rbf(a: np.ndarray, b: np.ndarray, length: float = 1.0) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-np.maximum(d, 0.0) / (2 * length ** 2))


def tuples_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first days with each distinct tuple of the given days, the tuple of each day, and their counts."""
    _, first, which, counts = np.unique(data[at], axis=0, return_index=True, return_inverse=True, return_counts=True)
    return at[first], which.ravel(), counts


def solve_duals(x: np.ndarray, counts: np.ndarray, means: np.ndarray, alpha: float) -> np.ndarray:
    """Duals (models, tuples) of centred mean targets (models, tuples)."""
    root = np.sqrt(counts)
    system = rbf(x, x) * np.outer(root, root)
    system[np.diag_indices_from(system)] += alpha
    return (root[:, None] * np.linalg.solve(system, root[:, None] * means.T)).T


def fit(choice: str, x: DataFrame, y: DataFrame, grid: list[dict], units: list[str], sets: list[str],
        chosen: DataFrame | None) -> Fitted:
    check_params(choice, grid, _USED, _WITHOUT_EFFECT)
    n, _ = shape(x, sets)
    vectors = with_params(target_vectors(on_days(y, x, sets), units), grid, units, chosen)
    used = 1 if chosen is not None else len(grid)

    def solve(days: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        place, data = matrix(days)
        out = []
        for rows, at, ys in alike(block, place):
            first, which, counts = tuples_of(data, at)
            sums = np.zeros((len(rows), len(first)))
            np.add.at(sums.T, which, ys.T)
            for i, members in by_param(block, rows):
                centre = ys[members].mean(1) if grid[i].get("normalize_y", False) else np.zeros(len(members))
                duals = solve_duals(data[first], counts, sums[members] / counts - centre[:, None], grid[i].get("alpha", 1e-10))
                out.append(block.iloc[rows[members]][[*units, "step"]].assign(param_idx=i, days=[place[first]] * len(members), dual=list(duals), centre=centre))
        return pd.concat(out)[[*units, "param_idx", "step", "days", "dual", "centre"]]

    schema = f"{unit_schema(y, units)}, param_idx int, step int, days array<int>, dual array<double>, centre double"
    table = in_blocks(day_rows(x, sets), vectors, sets, [*units, "step"], count_models(y, n), n * (used + 1), solve, schema)
    return Fitted(choice, {"model": table, "basis": day_rows(x, sets)}, grid, units, sets)


def predict(fitted: Fitted, x_new: DataFrame) -> DataFrame:
    return predict_with_kernel(fitted, x_new, lambda a, b, params: rbf(a, b))


def predict_with_kernel(fitted: Fitted, x_new: DataFrame, kernel) -> DataFrame:
    """Kernel rows of the new days times duals, block by block; ``days`` of a model name its rows of the basis.

    Models of a block with the same basis days and parameters share one kernel.
    """
    units, sets, grid = fitted.units, fitted.sets, fitted.grid
    model, basis = fitted.tables["model"], fitted.tables["basis"]
    both = basis.unionByName(day_rows(x_new, sets, 1))
    n, _ = shape(x_new, sets)

    def multiply(days: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        place, data = matrix(days, 0)
        asked, new = matrix(days, 1)
        out = []
        groups = block.groupby([block["days"].map(lambda d: np.asarray(d, np.int64).tobytes()), "param_idx"]).indices
        for (key, i), rows in groups.items():
            k = kernel(new, data[np.searchsorted(place, np.frombuffer(key, np.int64))], grid[int(i)])
            values = np.array(block["dual"].iloc[rows].tolist(), dtype=float) @ k.T + block["centre"].to_numpy()[rows][:, None]
            out.append(long_rows(block.iloc[rows][[*units, "param_idx", "step"]], asked, values))
        return pd.concat(out)

    schema = f"{unit_schema(model, [*units, 'param_idx', 'step'])}, d int, pred double"
    out = in_blocks(both, model, sets, [*units, "step", "param_idx"], model.count(), 2 * n, multiply, schema)
    return out.select(*units, "param_idx", F.date_from_unix_date("d").alias("day"), "step", "pred")
