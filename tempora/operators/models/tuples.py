"""Feature tuples of days as small integer ids.

A tuple is an array of features; days with equal features share it. The day matrix has one row per calendar day, so
ids are assigned there, and the observations only ever carry (and shuffle) an integer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W


def tag_days(x: DataFrame, sets: list[str]) -> DataFrame:
    """Add ``tuple_id`` 0..m-1 in the order of the tuples, per set; days with a missing feature are left out."""
    complete = x.where(~F.exists("x", lambda e: e.isNull()))
    place = F.dense_rank().over(W.partitionBy(*sets).orderBy("x")) - 1
    return complete.select(*sets, "day", "x", place.alias("tuple_id"))


def tuple_table(tagged: DataFrame, sets: list[str]) -> DataFrame:
    return tagged.groupBy(*sets, "tuple_id").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n_days"))
