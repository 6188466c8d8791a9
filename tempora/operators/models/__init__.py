"""Estimators that fit one model per series for all series at once.

Shared contract
---------------
``x``      (sets..., day, x ARRAY<DOUBLE>): the day matrix, the same for every series; one row per calendar day.
``y``      (units..., day, step, y): the targets; ``units`` name one model, by default ``series_id``.
``sets``   the unit columns by which the training days differ (``fold`` in cross-validation, else none).
``grid``   list of parameter dicts; every fitted row carries ``param_idx``, its place in that list.
``chosen`` optional (units..., param_idx): which parameters a unit uses; without it every unit gets the whole grid.

``fit(...)`` returns a :class:`Fitted`, ``predict(fitted, x_new)`` returns (units..., param_idx, day, step, pred).
"""

from .base import Fitted, fit, get_estimator, load_model, predict, save_model

__all__ = ["Fitted", "fit", "get_estimator", "load_model", "predict", "save_model"]
