"""Cross-validated grid search for every series at once."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from ..sources.tables import finished_folders
from . import models
from .evaluate import r2_scores
from .windows import kfold, training_folds


def param_combinations(grid: dict[str, Sequence] | Sequence[dict]) -> list[dict]:
    """All combinations, with the last name varying fastest; names are taken in sorted order."""
    if not isinstance(grid, dict):
        return [dict(g) for g in grid]
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*[grid[n] for n in names])]


def grid_search(choice: str, x: DataFrame, y: DataFrame, grid: dict | Sequence[dict], n_splits: int = 5,
                shuffle: bool = False, seed: int = 0, train_score: bool = True, weights: str = "uniform") -> DataFrame:
    """(series_id, param_idx, fold, split, score) for every series, parameter set and held-out fold.

    Folds are assigned to days. The targets are repeated once per fold that trains on them, and (series, fold)
    names one model, so all fits of the search run as one job instead of a loop. The models are stored, then all days
    are predicted and scored in one pass: a day is test in its own fold and train in the others.
    """
    combos = param_combinations(grid)
    folds = materialize(kfold(x, n_splits, shuffle, seed), "folds")
    trains = training_folds(folds, n_splits)
    units = ["series_id", "fold"]
    x_train = x.join(trains, "day").select("fold", "day", "x")
    y_train = y.join(trains, "day").select("series_id", "fold", "day", "step", "y")
    fitted = models.fit(choice, x_train, y_train, combos, units, ["fold"])

    own = folds.withColumnRenamed("fold", "own_fold")
    asked = x.join(own, "day")
    every_fold = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    asked = asked.withColumn("fold", every_fold if train_score else F.col("own_fold")).select("fold", "day", "x")
    pred = models.predict(fitted, asked, floor=False).join(own, "day")
    pred = pred.withColumn("split", F.when(F.col("fold") == F.col("own_fold"), "test").otherwise("train"))
    return r2_scores(y, pred.drop("own_fold"), ["series_id", "param_idx", "fold", "split"], ["series_id"], weights)


_SCORES = "series_id string, param_idx int, fold int, split string, score double, error string"


def resumable_search(choice: str, x: DataFrame, y: DataFrame, grid: dict | Sequence[dict], ledger: str, n_splits: int = 5,
                     shuffle: bool = False, seed: int = 0, train_score: bool = True, weights: str = "uniform", buckets: int = 8) -> DataFrame:
    """:func:`grid_search` with a ledger: (series_id, param_idx, fold, split, score, error).

    Series are dealt to buckets by a hash; the scores of a bucket are committed to a folder of their own below
    ``ledger``. A later call with the same settings leaves finished series out, so a killed search goes on where it
    stopped. A bucket that fails is halved until the failing series stands alone; that one is recorded with its error
    and no scores, and the others go on. Settings that differ have ledgers of their own.
    """
    combos = param_combinations(grid)
    named = json.dumps([choice, combos, n_splits, shuffle, seed, train_score, weights], sort_keys=True, default=str)
    folder = f"{ledger}/{hashlib.md5(named.encode()).hexdigest()}"
    spark = x.sparkSession

    def known() -> DataFrame:
        paths = finished_folders(spark, folder)
        return spark.read.schema(_SCORES).parquet(*paths) if paths else spark.createDataFrame([], _SCORES)

    def commit(rows: DataFrame) -> None:
        rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in _SCORES.split(", ")]).write.parquet(f"{folder}/{uuid.uuid4().hex}")

    waiting = [(buckets, r) for r in range(buckets)]
    while waiting:
        modulus, rest = waiting.pop()
        own = y.where(F.pmod(F.xxhash64("series_id"), F.lit(modulus)) == rest).join(known().select("series_id").distinct(), "series_id", "left_anti")
        if own.isEmpty():
            continue
        try:
            scores = grid_search(choice, x, own, combos, n_splits, shuffle, seed, train_score, weights)
            commit(scores.withColumn("error", F.lit(None).cast("string")))
        except Exception as error:
            ends = own.agg(F.min("series_id").alias("low"), F.max("series_id").alias("high")).first()
            if ends["low"] != ends["high"]:
                waiting += [(2 * modulus, rest), (2 * modulus, rest + modulus)]
                continue
            text = next((line for line in reversed(str(error).splitlines()) if "Error" in line or "Exception" in line), str(error))[:500]
            failed = own.select("series_id").limit(1).withColumn("error", F.lit(text or type(error).__name__))
            commit(failed.withColumns({c: F.lit(None) for c in ("param_idx", "fold", "split", "score")}))
    return known()


def best_params(cv_results: DataFrame) -> DataFrame:
    """(series_id, param_idx, score): highest mean test score; the first in grid order on ties."""
    means = (cv_results.where(F.col("split") == "test").groupBy("series_id", "param_idx")
             .agg(F.avg("score").alias("score")))
    best = means.groupBy("series_id").agg(
        F.max(F.struct(F.round("score", 12).alias("s"), (-F.col("param_idx")).alias("m"), F.col("score"))).alias("b"))
    return best.select("series_id", (-F.col("b.m")).cast("int").alias("param_idx"), F.col("b.score").alias("score"))


def params_table(spark: SparkSession, grid: dict | Sequence[dict]) -> DataFrame:
    """(param_idx, params MAP): the grid as a table."""
    rows = [(i, {k: str(v) for k, v in p.items()}) for i, p in enumerate(param_combinations(grid))]
    return spark.createDataFrame(rows, "param_idx int, params map<string,string>")
