"""Joins beyond a plain equi-join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import dot, norm, unit
from ..session import materialize


def left_join_all(frames: Sequence[DataFrame], key: str = "ts") -> DataFrame:
    """LEFT JOIN of all tables on one key, then duplicate rows are dropped; shared non-key names are an error."""
    seen: set[str] = set()
    for frame in frames:
        names = set(frame.columns) - {key}
        clash = names & seen
        if clash:
            raise ValueError(f"columns occur in more than one table: {sorted(clash)}")
        seen |= names
    return reduce(lambda left, right: left.join(right, key, "left"), frames).dropDuplicates()


def common_times(obs: DataFrame, preds: DataFrame, n_models: int | None = None) -> DataFrame:
    """Timestamps present in the observations and in every model's predictions.

    ``preds`` is long (model, ts, ...). The pairs (model, ts) are reduced map-side before the shuffle, and the
    result has one row per time step whatever the number of series.
    """
    pairs = preds.select("model", "ts").distinct()
    if n_models is None:
        needed = preds.select(F.count_distinct("model").alias("n")).scalar()
    else:
        needed = F.lit(n_models)
    shared = pairs.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == needed).select("ts")
    return shared.join(obs.select("ts").distinct(), "ts", "left_semi")


def grouped_ids(df: DataFrame, keys: Sequence[str], value: str, target: str) -> DataFrame:
    """Sorted, comma separated ids per group of a dimension table."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)), ",").alias(target))


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of ``left`` with no partner, one row each: the report of failed links."""
    return left.select(*on).distinct().join(right.select(*on), list(on), "left_anti")


_SIM_DIGITS = 12  # similarities equal to this many digits are ties
_ANGLE_SLACK = 4e-6  # covers the angle between similarities that are equal to _SIM_DIGITS, and acos near 1
_NO_FLOOR = -2.0  # below every similarity
_ASKED = 16384  # queries that meet a chunk of keys at once
_TILE = 1 << 22  # cells of a product that a task holds at once
_EXACT = 1 << 20  # numbers of the vector pairs whose similarity is counted in full at once


def _angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For every length the places of the vectors of that length, and the vectors."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    ends = np.cumsum(sizes)
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out[d] = rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]
    return out


def _in_order(products: np.ndarray) -> np.ndarray:
    """Sums of the rows, added from the left as ``dot`` and ``norm`` do."""
    return 0.0 + np.add.accumulate(products, axis=1)[:, -1]


def _units(v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return v / np.sqrt(_in_order(v * v))[:, None]


def _meet(asked: pa.Table, keys: pa.Table, schema: pa.Schema) -> pa.Table:
    """(id, sim, k) for each query (id, q, floor) and key that may be its nearest, of equal similarities the smallest key.

    A product in single precision finds the keys that come within its error of the query's largest value, and of the
    floor. Only their similarities are counted in full, as the column expressions count them. Values that are not
    finite have no order: such a key is given out where no other is, such a query gets its smallest key.
    """
    ids, floors = asked["id"].to_numpy(), asked["floor"].to_numpy()
    key_of = _matrices(keys["k"])
    found_id, found_sim, found_key = [], [], []
    for d, (at, q) in _matrices(asked["q"]).items():
        if d not in key_of:
            continue
        rows, k = key_of[d]
        order = np.lexsort(k.T[::-1])  # the smallest key of a tie comes first
        rows, k = rows[order], k[order]
        qu, ku = _units(q), _units(k)
        q_fine, k_fine = np.isfinite(qu).all(axis=1), np.isfinite(ku).all(axis=1)
        odd = np.arange(len(at)) if not k_fine.any() else np.flatnonzero(~q_fine)
        odd = odd[floors[at[odd]] == _NO_FLOOR]
        found_id.append(ids[at[odd]])
        found_sim.append(np.full(len(odd), np.nan))
        found_key.append(np.full(len(odd), rows[0]))
        if not k_fine.any():
            continue
        at, qu, rows, ku = at[q_fine], qu[q_fine], rows[k_fine], ku[k_fine]
        q32, k32 = qu.astype(np.float32), ku.astype(np.float32).T.copy()
        error = 2 * (d + 4) * 2.0 ** -24  # of both values that are compared
        step = max(1, _TILE // len(rows))
        for a in range(0, len(at), step):
            near = q32[a:a + step] @ k32
            low = np.maximum(near.max(axis=1), floors[at[a:a + step]]) - error - 2 * 10.0 ** -_SIM_DIGITS
            i, j = np.nonzero(near >= low.astype(np.float32)[:, None] - np.float32(2.0 ** -23))
            many = max(1, _EXACT // d)
            for b in range(0, len(i), many):
                x, y = i[b:b + many], j[b:b + many]
                sim = _in_order(qu[a + x] * ku[y])
                take = np.lexsort((y, sim, x))
                x, y, sim = x[take], y[take], sim[take]
                first = np.ones(len(x), bool)
                first[1:] = (x[1:] != x[:-1]) | (sim[1:] != sim[:-1])
                found_id.append(ids[at[a + x[first]]])
                found_sim.append(sim[first])
                found_key.append(rows[y[first]])
    chosen = np.concatenate([np.empty(0, np.int64), *found_key]).astype(np.int64)
    return pa.Table.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found_id]), pa.int64()),
                                 pa.array(np.concatenate([np.empty(0), *found_sim]), pa.float64()),
                                 keys["k"].combine_chunks().take(pa.array(chosen))], schema=schema)


def nearest_vectors(queries: DataFrame, keys: DataFrame, n_cells: int = 32, chunk: int = 32768,
                    sets: Sequence[str] = ()) -> DataFrame:
    """For each distinct query vector the key vector of its set with the largest cosine similarity.

    Input columns ``q`` and ``k`` are ARRAY<DOUBLE>, ``sets`` are integer columns of both; output is
    (sets, q, k, similarity). Ties go to the smallest key in lexicographic order; a zero vector has no similarity and
    comes last, as do vectors of another length than the query. A query whose set has no keys gets a NULL key.

    The angle is a metric, so the keys are put into cells around ``n_cells`` of them. A query first meets the cell with
    the closest centre; the angle found there and the triangle inequality then rule out every cell that cannot hold a
    nearer key, so the result is exact. A cell's keys are dealt to chunks of about ``chunk`` and the queries that visit it
    to blocks; a task takes the matrix product of one block and one chunk, and only keys that can be a query's nearest
    leave it. A cell holding most keys is spread over many tasks.
    """
    own = F.array(*[F.col(s).cast("long") for s in sets]).cast("array<long>").alias("own")
    q = queries.select(*sets, own, "q").distinct()
    k = keys.select(own, "k").distinct()
    k_unit = k.where(norm(F.col("k")) > 0).withColumn("ku", unit(F.col("k")))

    centre = F.struct(F.md5(F.to_json(F.struct("k"))).alias("h"), F.col("ku").alias("u"))
    centres = k_unit.select(centre.alias("c")).distinct().orderBy("c").limit(n_cells)
    centre_list = centres.agg(F.array_sort(F.collect_list("c")).alias("list")).scalar()

    placed = materialize(
        k_unit.withColumn("cs", centre_list)
        .withColumn("best", F.array_min(F.transform(
            F.col("cs"), lambda c, i: F.struct(_angle(c["u"], F.col("ku")).alias("a"), i.alias("cell")))))
        .select("own", "k", F.col("best.cell").alias("cell"), F.col("best.a").alias("a"),
                F.element_at("cs", F.col("best.cell") + 1)["u"].alias("u")), "placed")
    cells = materialize(placed.groupBy("own", "cell").agg(
        F.min("a").alias("near"), F.max("a").alias("far"), F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("long").alias("parts"),
        F.first("u").alias("u")), "cells")
    cell_list = cells.agg(F.collect_list(F.struct("own", "cell", "near", "far", "u")).alias("list")).scalar()

    reach = F.transform(F.filter(F.col("cells"), lambda c: c["own"] == F.col("own")), lambda c: F.struct(
        _angle(c["u"], F.col("qu")).alias("a"), c["cell"].alias("cell"), c["near"].alias("near"), c["far"].alias("far")))
    asked = materialize(q.where(norm(F.col("q")) > 0).withColumn("qu", unit(F.col("q"))).withColumn("cells", cell_list)
                        .select(F.monotonically_increasing_id().alias("id"), "own", "q", reach.alias("reach"))
                        .withColumn("home", F.array_min("reach")), "asked")
    vectors = asked.select("id", "q")
    found_schema = "id long, sim double, k array<double>"
    arrow = pa.schema([("id", pa.int64()), ("sim", pa.float64()), ("k", pa.list_(pa.float64()))])

    def best_of(visits: DataFrame) -> DataFrame:
        """(id, best) over the visits (id, own, cell, floor)."""
        blocks = F.ceil(F.count(F.lit(1)) / F.lit(_ASKED)).cast("long").alias("blocks")
        met = materialize(visits.groupBy("own", "cell").agg(blocks).join(cells.select("own", "cell", "parts"), ["own", "cell"]), "met")
        left = (visits.join(met, ["own", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
                .select("id", "floor", "own", "cell", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
                .join(vectors, "id"))
        right = (placed.join(met, ["own", "cell"]).withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")))
                 .select("k", "own", "cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")))
        by = ["own", "cell", "part", "block"]
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: _meet(a, b, arrow), found_schema)
        rank = F.struct((-F.round("sim", _SIM_DIGITS)).alias("minus_sim"), F.col("k"))
        return found.groupBy("id").agg(F.min(rank).alias("best"))

    first = materialize(best_of(asked.select("id", "own", F.col("home.cell").alias("cell"), F.lit(_NO_FLOOR).alias("floor"))), "first")

    sim = F.when(~F.isnan("best.minus_sim"), -F.col("best.minus_sim"))
    found = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(sim, F.lit(-1.0))))) + F.lit(_ANGLE_SLACK)
    others = asked.join(first, "id", "left").withColumn("found", found).withColumn("c", F.explode(F.filter(
        F.col("reach"), lambda c: (c["cell"] != F.col("home.cell")) & (c["a"] - c["far"] <= F.col("found"))
        & (c["near"] - c["a"] <= F.col("found"))))).select("id", "own", "c.cell", F.coalesce(sim, F.lit(_NO_FLOOR)).alias("floor"))
    best = first.unionByName(best_of(materialize(others, "visits"))).groupBy("id").agg(F.min("best").alias("best"))
    best = asked.select("id", "own", "q").join(best, "id").drop("id")

    lows = k.groupBy("own").agg(F.min("k").alias("k")).agg(F.collect_list(F.struct("own", "k")).alias("list")).scalar()
    smallest = F.try_element_at(F.filter(F.col("lows"), lambda c: c["own"] == F.col("own")), F.lit(1))["k"]
    return q.join(best, ["own", "q"], "left").withColumn("lows", lows).select(
        *sets, "q", F.coalesce(F.col("best.k"), smallest).alias("k"), (-F.col("best.minus_sim")).alias("similarity"))
