"""Blocks of models: how estimators meet the day matrix without the driver.

A day matrix has one row per calendar day and set (fold) and serves every series. Models are many: one per series and
step, per fold and parameter set. ``in_blocks`` deals the models of a set to blocks of a bounded number of cells and
joins each block with the rows of the set's matrix; a task then holds one matrix and one block, solves the block with
numpy and returns its rows. Nothing is collected or broadcast, no size is refused, and a set with many models is as many
tasks as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Numbers that the models of one block read or write: 32 MB.
BLOCK_CELLS = 4_000_000


def on_days(y: DataFrame, x: DataFrame, sets: list[str]) -> DataFrame:
    """The targets on days that have features; a model is fitted on no others."""
    return y.join(x.select(*sets, "day"), [*sets, "day"], "left_semi")


def target_vectors(y: DataFrame, units: list[str]) -> DataFrame:
    """(units, step, days, ys): the targets of one model in day order. A vector has one entry per calendar day."""
    cells = F.array_sort(F.collect_list(F.struct(F.unix_date("day").alias("d"), F.col("y"))))
    grouped = y.where("y IS NOT NULL").groupBy(*units, "step").agg(cells.alias("c"))
    return grouped.select(*units, "step", F.col("c.d").alias("days"), F.col("c.y").alias("ys"))


def with_params(df: DataFrame, grid: list[dict], units: list[str], chosen: DataFrame | None) -> DataFrame:
    """Add ``params``, the places in the grid that a model is fitted with: all, or the one chosen for its unit."""
    if chosen is None:
        return df.withColumn("params", F.array(*[F.lit(i) for i in range(len(grid))]))
    keys = [c for c in chosen.columns if c != "param_idx"]
    return df.join(chosen.withColumn("params", F.array("param_idx")).drop("param_idx"), keys)


def day_rows(x: DataFrame, sets: list[str], kind: int = 0) -> DataFrame:
    """(sets, kind, day as number, x) of the days whose features are all known."""
    return x.where(~F.exists("x", lambda v: v.isNull())).select(*sets, F.lit(kind).alias("kind"), F.unix_date("day").alias("d"), "x")


def shape(x: DataFrame, sets: list[str]) -> tuple[int, int]:
    """Most days of a set and most features of a day."""
    row = x.groupBy(*sets).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")).agg(F.max("n"), F.max("p")).first()
    return row[0] or 0, row[1] or 0


def check_finite(ys: np.ndarray) -> np.ndarray:
    """The targets, if all are numbers; a NULL target is no row, but NaN and infinity are errors."""
    if not np.isfinite(ys).all():
        raise ValueError("a series has targets that are not finite")
    return ys


def in_blocks(x: DataFrame, models: DataFrame, sets: list[str], keys: list[str], n_models: int, cells: int,
              solve: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``solve(days, block)`` for blocks of models: days (kind, d, x) in order, block the rows of ``models``.

    Models with equal ``keys`` share a block; a model counts for ``cells`` numbers. Enough models give a block for
    every task that the session runs at a time.
    """
    slots = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(n_models * cells / BLOCK_CELLS), min(n_models, slots))
    held, same = [*sets, "_block"], [*[f"_{s}" for s in sets], "_block"]
    dealt = models.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")).repartition(blocks, *held)
    # the sets get names of their own: both sides may come from one table
    copies = x.withColumnsRenamed(dict(zip(sets, same)))
    copies = copies.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, *same)
    empty = [part.split()[0] for part in schema.replace(",", "\n").splitlines()]

    def run(days: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if days.empty or block.empty:
            return pd.DataFrame(columns=empty)
        return solve(days.sort_values(["kind", "d"], ignore_index=True), block.reset_index(drop=True))

    return copies.groupBy(*same).cogroup(dealt.groupBy(*held)).applyInPandas(run, schema)


def matrix(days: pd.DataFrame, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Day numbers and features of the rows of one kind."""
    own = days[days["kind"] == kind]
    return own["d"].to_numpy(), np.array(own["x"].tolist(), dtype=float).reshape(len(own), -1)


def alike(block: pd.DataFrame, days: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places, targets) of the models of a block that have the same days: places in ``days``, one target a row."""
    groups: dict[bytes, list[int]] = {}
    for i, own in enumerate(block["days"]):
        groups.setdefault(np.asarray(own, np.int64).tobytes(), []).append(i)
    for key, rows in groups.items():
        own = np.frombuffer(key, np.int64)
        known = np.isin(own, days)
        ys = check_finite(np.array([block["ys"].iat[i] for i in rows], dtype=float))[:, known]
        yield np.array(rows), np.searchsorted(days, own[known]), ys


def by_param(block: pd.DataFrame, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place in the grid, places among the rows) of the models that are fitted with it."""
    uses: dict[int, list[int]] = {}
    for at, i in enumerate(rows):
        for p in block["params"].iat[i]:
            uses.setdefault(int(p), []).append(at)
    for p, at in sorted(uses.items()):
        yield p, np.array(at)


def unit_schema(df: DataFrame, columns: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{c} {types[c]}" for c in columns)


def check_params(choice: str, grid: list[dict], used: set[str], without_effect: dict[str, tuple | None]) -> None:
    """Raise for parameters that an estimator does not know, and for values that it cannot honour."""
    for params in grid:
        for name, value in params.items():
            if name in used:
                continue
            if name not in without_effect or (without_effect[name] is not None and value not in without_effect[name]):
                raise ValueError(f"{choice} does not know {name}={value!r}")


def count_models(y: DataFrame, days: int) -> int:
    """About how many models the targets make: one per so many days. The count of a stored table reads no data."""
    return max(1, y.count() // max(1, days))


def long_rows(models: pd.DataFrame, days: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    """A row for each model and day; values (models, days)."""
    out = models.iloc[np.repeat(np.arange(len(models)), len(days))].reset_index(drop=True)
    return out.assign(d=np.tile(days, len(models)).astype(np.int32), pred=values.ravel())
