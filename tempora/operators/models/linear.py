"""Least squares and elastic net for every series and step at once.

Models are solved in blocks against the day matrix of their set (:mod:`.arrays`), all models of a block with the same
days and parameters together. Both solvers work on the matrix itself, so one solver serves narrow and wide data alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .arrays import (alike, by_param, check_params, count_models, day_rows, in_blocks, long_rows, matrix, on_days, shape, target_vectors,
                     unit_schema, with_params)
from .base import Fitted

# Parameters, and those that change nothing here with the values they may have.
_USED = {"lr": {"fit_intercept", "normalize"},
         "en": {"alpha", "l1_ratio", "fit_intercept", "normalize", "positive", "max_iter", "tol"}}
_WITHOUT_EFFECT = {"lr": {"n_jobs": None, "copy_X": None},
                   "en": {"precompute": None, "copy_X": None, "warm_start": (False,), "random_state": None, "selection": None}}


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (p, models) of targets (n, models); the shortest solution if features are dependent."""
    return np.linalg.lstsq(x, y, rcond=None)[0]


def _descend(a: np.ndarray, b: np.ndarray, w: np.ndarray, l1: float, l2: float, positive: bool, sweeps: int, tol: float) -> None:
    """Cyclic coordinate descent on w for w'aw / 2 - b'w + l1 |w|_1 + l2 |w|^2 / 2, in place, for all columns of b."""
    diag = np.diag(a)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(a)):
            rho = b[j] - a[j] @ w + diag[j] * w[j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - l1, 0.0) / (diag[j] + l2)
            if positive:
                new = np.maximum(new, 0.0)
            moved = max(moved, np.abs(new - w[j]).max())
            w[j] = new
        if moved <= tol * 1e-4 * max(np.abs(w).max(initial=0.0), 1e-12):
            return


def duality_gap(x: np.ndarray, y: np.ndarray, w: np.ndarray, l1: float, l2: float, positive: bool = False) -> np.ndarray:
    """How far each model's objective is from its least value at most."""
    r = y - x @ w
    slope = x.T @ r - l2 * w
    steepest = (slope if positive else np.abs(slope)).max(0, initial=0.0)
    rr, ww = (r * r).sum(0), (w * w).sum(0)
    c = np.where(steepest > l1, l1 / np.maximum(steepest, 1e-300), 1.0)
    return 0.5 * rr * (1 + c * c) + l1 * np.abs(w).sum(0) - c * (r * y).sum(0) + 0.5 * l2 * (1 + c * c) * ww


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, l1_ratio: float = 0.5, positive: bool = False,
                max_iter: int = 1000, tol: float = 1e-4) -> np.ndarray:
    """Coefficients (p, models) that minimise |y - Xw|^2 / 2n + alpha l1_ratio |w|_1 + alpha (1 - l1_ratio) |w|^2 / 2.

    Descent runs on a working set: features whose slope exceeds the absolute penalty enter, the steepest first, for all
    models of the batch; the others are zero by their slopes. It ends when none is left to enter, or when every model's
    duality gap is below a thousandth of ``tol`` times its squared targets. Without an absolute penalty the solution is
    closed.
    """
    n, p = x.shape
    l1, l2 = alpha * l1_ratio * n, alpha * (1 - l1_ratio) * n
    if l1 == 0 and not positive:
        if l2 == 0:
            return least_squares(x, y)
        # (X'X + l2)^-1 X' = X' (XX' + l2)^-1: the smaller of the two systems
        return np.linalg.solve(x.T @ x + l2 * np.eye(p), x.T @ y) if p <= n else x.T @ np.linalg.solve(x @ x.T + l2 * np.eye(n), y)
    squares = (x * x).sum(0)
    usable = squares > 1e-12 * max(1.0, squares.max(initial=0.0))
    w = np.zeros((p, y.shape[1]))
    slopes = x.T @ y
    working = np.zeros(p, bool)
    goal = 1e-3 * tol * (y * y).sum(0)
    while True:
        above = (slopes if positive else np.abs(slopes)).max(1, initial=-np.inf)
        enter = usable & ~working & (above > l1 * (1 + 1e-9))
        if not enter.any() or working.any() and (duality_gap(x, y, w, l1, l2, positive) <= goal).all():
            return w
        # as many as are in already, the steepest first, but never fewer than 64
        most = max(64, int(working.sum()))
        steep = np.flatnonzero(enter)
        working[steep[np.argsort(-above[steep], kind="stable")[:most]]] = True
        at = np.flatnonzero(working)
        part = x[:, at]
        own = w[at]
        _descend(part.T @ part, part.T @ y, own, l1, l2, positive, max_iter, tol)
        w[at] = own
        slopes = x.T @ (y - part @ own) - l2 * w


def solve_batch(choice: str, x: np.ndarray, y: np.ndarray, fit_intercept: bool = True, normalize: bool = False, **params) -> np.ndarray:
    """(models, 1 + p) with the intercept first; x (n, p), y (models, n). ``normalize`` counts with an intercept only."""
    mx, my = (x.mean(0), y.mean(1)) if fit_intercept else (np.zeros(x.shape[1]), np.zeros(len(y)))
    xc, yc = x - mx, (y - my[:, None]).T
    width = np.ones(x.shape[1])
    if normalize and fit_intercept:
        length = np.sqrt((xc * xc).sum(0))
        width = np.where(length > 1e-12 * max(1.0, length.max(initial=0.0)), length, 1.0)
        xc = xc / width
    w = (least_squares(xc, yc) if choice == "lr" else elastic_net(xc, yc, **params)) / width[:, None]
    return np.column_stack([my - mx @ w, w.T])


def fit(choice: str, x: DataFrame, y: DataFrame, grid: list[dict], units: list[str], sets: list[str],
        chosen: DataFrame | None) -> Fitted:
    check_params(choice, grid, _USED[choice], _WITHOUT_EFFECT[choice])
    plain = [{k: v for k, v in p.items() if k in _USED[choice]} for p in grid]
    days = day_rows(x, sets)
    n, p = shape(x, sets)
    vectors = with_params(target_vectors(on_days(y, x, sets), units), grid, units, chosen)
    used = 1 if chosen is not None else len(grid)

    def solve(days: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        place, data = matrix(days)
        out = []
        for rows, at, ys in alike(block, place):
            own = data[at]
            for i, members in by_param(block, rows):
                coefs = solve_batch(choice, own, ys[members], **plain[i])
                out.append(block.iloc[rows[members]][[*units, "step"]].assign(param_idx=i, coef=list(coefs)))
        return pd.concat(out)[[*units, "param_idx", "step", "coef"]]

    schema = f"{unit_schema(y, units)}, param_idx int, step int, coef array<double>"
    table = in_blocks(days, vectors, sets, [*units, "step"], count_models(y, n), max(n, used * (p + 1)), solve, schema)
    return Fitted(choice, {"model": table}, grid, units, sets)


def predict(fitted: Fitted, x_new: DataFrame) -> DataFrame:
    """Blocks of models times the matrix of the new days."""
    units = fitted.units
    model = fitted.tables["model"]
    n, p = shape(x_new, fitted.sets)

    def multiply(days: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        place, data = matrix(days)
        coefs = np.array(block["coef"].tolist(), dtype=float)
        return long_rows(block[[*units, "param_idx", "step"]], place, coefs[:, :1] + coefs[:, 1:] @ data.T)

    schema = f"{unit_schema(model, [*units, 'param_idx', 'step'])}, d int, pred double"
    out = in_blocks(day_rows(x_new, fitted.sets), model, fitted.sets, [*units, "step", "param_idx"], model.count(), n + p, multiply, schema)
    return out.select(*units, "param_idx", F.date_from_unix_date("d").alias("day"), "step", "pred")
