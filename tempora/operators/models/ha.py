"""Historical average: the mean or median of the targets per feature tuple, stored as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ..joins import nearest_vectors
from ..stats import group_median
from .base import Fitted
from .tuples import tag_days, tuple_table

METHODS = ("mean", "median")


def _method(params: dict) -> str:
    method = params.get("method", "mean")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; use one of {METHODS}")
    return method


def fit(choice: str, x: DataFrame, y: DataFrame, grid: list[dict], units: list[str], sets: list[str],
        chosen: DataFrame | None) -> Fitted:
    """Group by (units, step, tuple). Tuples with a NULL entry are dropped.

    The mean is a partial aggregation; the median counts equal values first and never gathers a group.
    """
    methods = [_method(p) for p in grid]
    tagged = tag_days(x, sets)
    data = y.join(tagged.select(*sets, "day", "tuple_id"), [*sets, "day"])
    keys = [*units, "step", "tuple_id"]
    parts = []

    def wanted(method: str) -> DataFrame:
        """The rows of the units that use a method."""
        if chosen is None or len(set(methods)) == 1:
            return data
        places = [i for i, own in enumerate(methods) if own == method]
        return data.join(chosen.where(F.col("param_idx").isin(places)).drop("param_idx"), [c for c in chosen.columns if c != "param_idx"], "left_semi")

    if "mean" in methods:
        parts.append(wanted("mean").groupBy(*keys).agg(F.avg("y").alias("pred")).withColumn("method", F.lit("mean")))
    if "median" in methods:
        parts.append(group_median(wanted("median"), keys, "y", "pred").withColumn("method", F.lit("median")))
    fitted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    places = {m: F.array(*[F.lit(i) for i, own in enumerate(methods) if own == m]) for m in METHODS}
    own = F.when(F.col("method") == "mean", places["mean"]).otherwise(places["median"]).cast("array<int>")
    table = fitted.withColumn("param_idx", F.explode(own)).select(*units, "param_idx", "step", "tuple_id", "pred")
    if chosen is not None:
        table = table.join(chosen, chosen.columns, "left_semi")
    return Fitted(choice, {"model": table, "tuples": tuple_table(tagged, sets)}, grid, units, sets)


def as_table(fitted: Fitted) -> DataFrame:
    """The model with its feature tuples spelled out: (units, param_idx, step, x, pred)."""
    tuples = fitted.tables["tuples"].select(*fitted.sets, "tuple_id", "x")
    return fitted.tables["model"].join(tuples, [*fitted.sets, "tuple_id"]).select(
        *fitted.units, "param_idx", "step", "x", "pred")


def refit(old: Fitted, new: Fitted) -> Fitted:
    """New tuples replace old ones, old tuples that were not seen again stay. Tuples are numbered anew."""
    sets = new.sets
    both = old.tables["tuples"].unionByName(new.tables["tuples"]).groupBy(*sets, "x").agg(F.sum("n_days").alias("n_days"))
    tuples = both.withColumn("tuple_id", F.row_number().over(W.partitionBy(*sets).orderBy("x")) - 1)

    def renumber(fitted: Fitted) -> DataFrame:
        ids = fitted.tables["tuples"].select(*sets, "x", F.col("tuple_id").alias("_old"))
        ids = ids.join(tuples.select(*sets, "x", "tuple_id"), [*sets, "x"]).drop("x")
        model = fitted.tables["model"].withColumnRenamed("tuple_id", "_old").join(ids, [*sets, "_old"])
        return model.select(*new.units, "param_idx", "step", "tuple_id", "pred")

    fresh = renumber(new)
    key = [*new.units, "param_idx", "step", "tuple_id"]
    kept = renumber(old).join(fresh.select(*key), key, "left_anti")
    return Fitted(new.choice, {"model": fresh.unionByName(kept), "tuples": tuples}, new.grid, new.units, sets)


def match_days(tuples: DataFrame, x_new: DataFrame, sets: list[str]) -> DataFrame:
    """(sets, day, tuple_id): each day's own tuple, or the known one most similar by cosine.

    Only calendar-sized tables take part, and the search is planned only when some tuple is unknown. Models per fold
    know different tuples each, so the search is one per set.
    """
    exact = x_new.join(tuples, [*sets, "x"]).select(*sets, "day", "tuple_id")
    unknown = x_new.join(tuples, [*sets, "x"], "left_anti")
    if unknown.isEmpty():
        return exact
    near = nearest_vectors(unknown.select(*sets, F.col("x").alias("q")), tuples.select(*sets, F.col("x").alias("k")), sets=sets)
    found = (unknown.join(near.select(*sets, F.col("q").alias("x"), "k"), [*sets, "x"])
             .join(tuples.select(*sets, F.col("x").alias("k"), "tuple_id"), [*sets, "k"]).select(*sets, "day", "tuple_id"))
    return exact.unionByName(found)


def predict(fitted: Fitted, x_new: DataFrame) -> DataFrame:
    """Days meet the model rows of their tuple; days are few, model rows may be many."""
    sets = fitted.sets
    days = match_days(fitted.tables["tuples"].select(*sets, "tuple_id", "x"), x_new.select(*sets, "day", "x"), sets)
    return fitted.tables["model"].join(days, [*sets, "tuple_id"]).select(*fitted.units, "param_idx", "day", "step", "pred")
