"""Epsilon-insensitive support vector regression, one model per series and step.

Models are solved in blocks (:mod:`.arrays`). A block sorts its models by kernel and keeps one kernel matrix at a time,
over the days of the set; a series with missing days uses its own part of it. ``C``, ``epsilon`` and ``tol`` share a
kernel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .arrays import (alike, by_param, check_params, count_models, day_rows, in_blocks, matrix, on_days, shape, target_vectors, unit_schema,
                     with_params)
from .base import Fitted
from .gp import predict_with_kernel

# Parameters, and those that only the solver of another library or another kernel uses.
_USED = {"kernel", "gamma", "C", "epsilon", "tol", "max_iter"}
_WITHOUT_EFFECT = {"degree": None, "coef0": None, "shrinking": None, "cache_size": None, "verbose": None}


def kernel_matrix(a: np.ndarray, b: np.ndarray, params: dict) -> np.ndarray:
    kind = params.get("kernel", "rbf")
    if kind == "linear":
        return a @ b.T
    if kind != "rbf":
        raise ValueError(f"unsupported kernel {kind!r}; use 'rbf' or 'linear'")
    gamma = params.get("gamma", "auto")
    gamma = 1.0 / b.shape[1] if gamma == "auto" else 1.0 / (b.shape[1] * b.var()) if gamma == "scale" else float(gamma)
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d, 0.0))


def solve_dual(k: np.ndarray, y: np.ndarray, c: float = 1.0, epsilon: float = 0.1, tol: float = 1e-3,
               max_iter: int = -1) -> tuple[np.ndarray, float, bool]:
    """Pairwise ascent: the variable that violates most, with the partner that gains most.

    Minimises b'Kb/2 - y'b + epsilon |b|_1 with -c <= b <= c and sum(b) = 0. Ends when no pair violates by more than
    ``tol``, or after ``max_iter`` steps if that is not negative; returns b, the offset and whether it got there.
    """
    n = len(y)
    beta, grad = np.zeros(n), -y.astype(float)
    diag, steps = np.diag(k).copy(), 0
    while True:
        up = np.where(beta < c, grad + np.where(beta >= 0, epsilon, -epsilon), np.inf)
        down = np.where(beta > -c, grad + np.where(beta > 0, epsilon, -epsilon), -np.inf)
        i = int(up.argmin())
        worst = down.max() - up[i]
        if worst <= tol or 0 <= max_iter <= steps:
            break
        lead = np.maximum(down - up[i], 0.0)
        j = int((lead * lead / np.maximum(diag[i] + diag - 2 * k[i], 1e-12)).argmax())
        curve = max(diag[i] + diag[j] - 2 * k[i, j], 1e-12)
        room = min(c - beta[i] if beta[i] >= 0 else -beta[i], beta[j] + c if beta[j] <= 0 else beta[j])
        t = min(lead[j] / curve, room)
        beta[i] += t
        beta[j] -= t
        grad += t * (k[i] - k[j])
        steps += 1
    return beta, float(-(up.min() + down.max()) / 2), bool(worst <= tol)


def fit(choice: str, x: DataFrame, y: DataFrame, grid: list[dict], units: list[str], sets: list[str],
        chosen: DataFrame | None) -> Fitted:
    """The model table has ``converged``, false only where ``max_iter`` ended a model's steps."""
    check_params(choice, grid, _USED, _WITHOUT_EFFECT)
    for params in grid:
        kernel_matrix(np.zeros((1, 1)), np.zeros((1, 1)), {**params, "gamma": 1.0})  # an unknown kernel fails here
    n, _ = shape(x, sets)
    vectors = with_params(target_vectors(on_days(y, x, sets), units), grid, units, chosen)
    used = 1 if chosen is not None else len(grid)

    def solve(days: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        place, data = matrix(days)
        out = []
        for rows, at, ys in alike(block, place):
            own, kernels = data[at], {}
            uses = sorted(by_param(block, rows), key=lambda u: str((grid[u[0]].get("kernel", "rbf"), grid[u[0]].get("gamma", "auto"))))
            for i, members in uses:
                p = grid[i]
                key = (p.get("kernel", "rbf"), p.get("gamma", "auto"))
                if key not in kernels:
                    kernels = {key: kernel_matrix(own, own, p)}
                for m in members:
                    beta, b, done = solve_dual(kernels[key], ys[m], p.get("C", 1.0), p.get("epsilon", 0.1), p.get("tol", 1e-3), p.get("max_iter", -1))
                    support = beta != 0
                    out.append((*block.iloc[rows[m]][[*units, "step"]], i, place[at[support]], beta[support], b, done))
        return pd.DataFrame(out, columns=[*units, "step", "param_idx", "days", "dual", "centre", "converged"])[[*units, "param_idx", "step", "days", "dual", "centre", "converged"]]

    schema = f"{unit_schema(y, units)}, param_idx int, step int, days array<int>, dual array<double>, centre double, converged boolean"
    table = in_blocks(day_rows(x, sets), vectors, sets, [*units, "step"], count_models(y, n), n * (used + 1), solve, schema)
    return Fitted(choice, {"model": table, "basis": day_rows(x, sets)}, grid, units, sets)


def predict(fitted: Fitted, x_new: DataFrame) -> DataFrame:
    return predict_with_kernel(fitted, x_new, kernel_matrix)
