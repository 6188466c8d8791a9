"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

The units are groups of equal texts. Each goes to the shard whose residual capacity has the highest dot product with
the unit's own vector, heaviest units first. Units heavier than a HEAD-th of a shard in any measure are few whatever
the input, at most 3 * HEAD * shards, and are placed together. The others are dealt by hash to tasks of about
TASK_UNITS units, each packing its units against its part of the residual capacity; they come in three waves of
falling size, so that each wave evens out what the tasks before left. Only shard loads pass through the driver.
A group of copies that outweighs a whole shard is split by a hash of the id, as no shard could hold it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tempora.llm.text import n_words, text_key
from tempora.session import materialize

SHARDS = 16
HEAD = 200
TASK_UNITS = 20_000
#: Shares of the light units up to which a wave takes them.
WAVES = (0.9, 0.99, 1.0)
SLOT_PARTS = 256
_MEASURES = ["bytes", "tokens", "rows"]


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = text_key(F.col("text"))
    return docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("bytes"), (n_words(F.col("text")) + 1).alias("tokens"),
                       F.lit(1).cast("long").alias("rows"), F.crc32(text.cast("binary")).alias("text_crc32"), k1.alias("k1"), k2.alias("k2"))


def place(units: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each unit. residual: what the shards have left, in the units' measures; shared out in proportion."""
    room = np.maximum(residual, 0.0)
    total = units.sum(0)
    room = room / np.maximum(room.sum(0), 1e-12) * total
    scale = np.maximum(total / len(room), 1e-12)
    own, room = units / scale, room / scale
    order = np.lexsort((np.arange(len(own)), -own.max(1)))
    shard = np.empty(len(own), np.int32)
    for i in order:
        u = own[i]
        score = room @ u
        fits = (room >= u - 1e-9).all(1)
        s = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else (room - u).min(1)))
        room[s] -= u
        shard[i] = s
    return shard


def _pack(units: DataFrame, loads: np.ndarray, capacity: np.ndarray) -> DataFrame:
    """(k1, k2, part, shard) of units (k1, k2, part, task, bytes, tokens, rows)."""
    left = capacity - loads

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k1", "k2", "part"])
        return pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "part": pdf["part"],
                             "shard": place(pdf[_MEASURES].to_numpy(float), left)})

    return units.groupBy("task").applyInPandas(run, "k1 long, k2 long, part int, shard int")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, bytes, tokens, text_crc32, k1, k2, shard) of every row.

    NULL text counts as empty and groups with empty texts. Repeated rows are rows each. Other columns are not read.
    """
    rows = materialize(_measured(docs), "measures")
    total = rows.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in _MEASURES], F.approx_count_distinct("k1").alias("units")).first()
    capacity = np.array([max(1, total[m]) for m in _MEASURES], float) / shards
    sums = [F.sum(m).alias(m) for m in _MEASURES]
    weight = F.greatest(*[F.col(m) / float(c) for m, c in zip(_MEASURES, capacity)])
    groups = rows.groupBy("k1", "k2").agg(*sums)
    over = materialize(groups.where(weight > 1).select("k1", "k2", F.ceil(weight * 4).cast("int").alias("parts")), "oversize")
    rows = rows.join(over, ["k1", "k2"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    units = materialize(
        rows.groupBy("k1", "k2", "part").agg(*sums).withColumn("heavy", weight > 1 / HEAD)
        .withColumn("draw", F.pmod(F.xxhash64(F.lit(3), "k1"), F.lit(1000)) / 1000.0)
        .withColumn("task", F.pmod(F.xxhash64(F.lit(5), "k1"), F.lit(max(1, -(-total["units"] // TASK_UNITS)))).cast("int")), "units")
    loads, placed = np.zeros((shards, len(_MEASURES))), []
    edges = (0.0, *WAVES)
    steps = [units.where("heavy").withColumn("task", F.lit(0))] + [
        units.where(~F.col("heavy") & (F.col("draw") >= a) & (F.col("draw") < b)) for a, b in zip(edges, edges[1:])]
    for step in steps:
        done = materialize(_pack(step, loads, capacity), "placed")
        placed.append(done)
        for s, *load in done.join(step, ["k1", "k2", "part"]).groupBy("shard").agg(*[F.sum(m) for m in _MEASURES]).collect():
            loads[s] += load
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    return rows.join(every, ["k1", "k2", "part"]).select("doc_id", "bytes", "tokens", "text_crc32", "k1", "k2", "shard")


def number(rows: DataFrame) -> DataFrame:
    """A gapless ``slot`` from 0 within each shard, numbered in parts whose counts set where they begin."""
    own = rows.withColumn("sub", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(SLOT_PARTS)).cast("int"))
    begin = own.groupBy("shard", "sub").agg(F.count("*").alias("n")).select("shard", "sub", F.coalesce(
        F.sum("n").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    within = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "k1", "k2"))
    return own.withColumn("at", within).join(begin, ["shard", "sub"]).withColumn("slot", F.col("begin") + F.col("at") - 1).drop("at", "begin", "sub")


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    placed = materialize(assign(docs, shards), "shards")
    return number(placed).select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard",
                                 F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
