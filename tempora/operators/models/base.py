"""Registry, common helpers and the model store."""

from __future__ import annotations

import importlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...session import materialize
from ...sources.tables import read_manifest, write_manifest, write_table

# Names of the estimators.
_MODULES = {"ha": "ha", "lr": "linear", "en": "linear", "gp": "gp", "svr": "svr", "rf": "trees", "gbr": "trees"}
_PREFIX = "estimator__"


@dataclass
class Fitted:
    """A fitted model: Spark tables plus a few plain settings."""

    choice: str
    tables: dict[str, DataFrame]
    grid: list[dict]
    units: list[str]
    sets: list[str] = field(default_factory=list)


def get_estimator(choice: str):
    """The module implementing an estimator name; an unknown name is an error."""
    if choice not in _MODULES:
        raise ValueError(f"unknown estimator {choice!r}; known: {sorted(_MODULES)}")
    return importlib.import_module(f"{__package__}.{_MODULES[choice]}")


def clean_params(params: dict | None) -> dict:
    """Drop the optional ``estimator__`` prefix of parameter names."""
    return {k[len(_PREFIX):] if k.startswith(_PREFIX) else k: v for k, v in (params or {}).items()}


def fit(choice: str, x: DataFrame, y: DataFrame, grid: Sequence[dict] | dict | None = None,
        units: Sequence[str] = ("series_id",), sets: Sequence[str] = (), chosen: DataFrame | None = None) -> Fitted:
    """Fit one model per unit and parameter set. A single dict is shared by every series."""
    grid = [grid] if grid is None or isinstance(grid, dict) else list(grid)
    grid = [clean_params(p) for p in grid]
    fitted = get_estimator(choice).fit(choice, x, y, grid, list(units), list(sets), chosen)
    # written once: predictions, stores and reports all read it
    fitted.tables["model"] = materialize(fitted.tables["model"], "model")
    return fitted


def predict(fitted: Fitted, x_new: DataFrame, floor: bool = True) -> DataFrame:
    """Predict every unit on the given days, floored at 0 unless told otherwise."""
    out = get_estimator(fitted.choice).predict(fitted, x_new)
    if floor:
        out = out.withColumn("pred", F.when(F.col("pred") < 0, F.lit(0.0)).otherwise(F.col("pred")))
    return out


def save_model(fitted: Fitted, path: str, force: bool = False, infos: dict | None = None) -> str:
    """Store the tables as Parquet and the settings as a manifest beside them."""
    get_estimator(fitted.choice)
    spark = next(iter(fitted.tables.values())).sparkSession if fitted.tables else SparkSession.active()
    for name, table in fitted.tables.items():
        write_table(table, f"{path}/{name}", force)
    state = {"choice": fitted.choice, "grid": fitted.grid, "units": fitted.units, "sets": fitted.sets,
             "tables": sorted(fitted.tables)}
    write_manifest(spark, f"{path}/manifest", {**{k: str(v) for k, v in (infos or {}).items()}, **_as_json(state)}, force)
    return path


def _as_json(state: dict) -> dict:
    import json
    return {k: json.dumps(v) for k, v in state.items()}


def load_model(spark: SparkSession, path: str) -> Fitted:
    import json
    infos = read_manifest(spark, f"{path}/manifest")
    state = {k: json.loads(infos[k]) for k in ("choice", "grid", "units", "sets", "tables")}
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in state["tables"]}
    return Fitted(state["choice"], tables, state["grid"], state["units"], state["sets"])
