"""Positions, lags and leads, folds and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import materialize


def with_position(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", chunk: Column | None = None) -> DataFrame:
    """Add ``_pos`` (0-based place of the row in its series) and ``_rows`` (length of the series).

    Rows are numbered inside chunks (default: a day) and shifted by the running count of the earlier chunks, so a
    series holding most of the table is never sorted by one task.
    """
    keys = list(keys)
    chunk = F.to_date(F.col(ts)) if chunk is None else chunk
    cut = df.withColumn("_chunk", chunk)
    counts = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                            F.sum("_n").over(W.partitionBy(*keys)).alias("_rows"))
    inside = F.row_number().over(W.partitionBy(*keys, "_chunk").orderBy(ts))
    return (cut.withColumn("_in", inside).join(offsets, [*keys, "_chunk"])
            .withColumn("_pos", F.col("_before") + F.col("_in") - 1).drop("_in", "_before", "_chunk"))


def lag_names(feature: str, tminus: int, tplus: int) -> list[str]:
    back = [f"{feature}::t-{i}" for i in range(tminus, 0, -1)]
    ahead = [f"{feature}::t+{i}" for i in range(1, tplus + 1)]
    return back + [feature] + ahead


def lag_lead(df: DataFrame, features: Sequence[str], features_window: Sequence[str], tminus: int, tplus: int,
             targets: Sequence[str] = (), keys: Sequence[str] = (), ts: str = "ts", block: int = 4096) -> DataFrame:
    """Lag/lead features by row position; the first ``tminus`` and last ``tplus`` rows of a series are cut.

    Windowed features become ``f::t-k ... f ... f::t+k``, the others stay plain. Rows are grouped in blocks of
    consecutive positions and the few rows next to a block's border are also sent to the neighbouring block, so the
    work is split by position rather than by series.
    """
    extra = [f for f in features_window if f not in features]
    if extra:
        raise ValueError(f"windowed features are not among the features: {extra}")
    keys = list(keys)
    block = max(block, tminus + tplus + 1)
    placed = with_position(df.select(*keys, ts, *dict.fromkeys([*features, *targets])), keys, ts)
    first = F.floor(F.greatest(F.col("_pos") - tplus, F.lit(0)) / F.lit(block))
    last = F.floor((F.col("_pos") + tminus) / F.lit(block))
    copies = placed.withColumn("_block", F.explode(F.sequence(first, last)))
    w = W.partitionBy(*keys, "_block").orderBy("_pos")
    columns: list[Column] = [F.col(c) for c in (*keys, ts)] + [F.col(c) for c in targets if c not in features]
    for f in features:
        if f not in features_window:
            columns.append(F.col(f))
            continue
        shifts = range(-tminus, tplus + 1)
        for name, shift in zip(lag_names(f, tminus, tplus), shifts):
            value = F.col(f) if shift == 0 else (F.lag(f, -shift).over(w) if shift < 0 else F.lead(f, shift).over(w))
            columns.append(value.alias(name))
    own = (F.floor(F.col("_pos") / F.lit(block)) == F.col("_block")) & (F.col("_pos") >= tminus) & (
        F.col("_pos") < F.col("_rows") - tplus)
    return copies.select(*columns, own.alias("_own")).where("_own").drop("_own")


def appearance_codes(df: DataFrame, column: str, ts: str = "ts", target: str = "code") -> DataFrame:
    """Code table: the values of ``column`` numbered 0..k-1 by the time of their first row (k clock times at most)."""
    firsts = df.groupBy(column).agg(F.min(ts).alias("_first"))
    return firsts.select(column, (F.row_number().over(W.orderBy("_first", column)) - 1).alias(target))


def appearance_code(df: DataFrame, column: str, ts: str = "ts", target: str = "code") -> DataFrame:
    return df.join(appearance_codes(df, column, ts, target), column)


def place_in_order(df: DataFrame, columns: Sequence[str], target: str = "place") -> DataFrame:
    """Append the place 1..n of each row in the order of ``columns``, without one task that holds all rows.

    Rows are range-partitioned and written; a slot's first place is the number of rows in the slots before it.
    """
    sorted_ = materialize(df.repartitionByRange(*columns).withColumn("_slot", F.spark_partition_id()), "ordered")
    counts = sorted_.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))  # one row per slot
    before = counts.select("_slot", (F.sum("_n").over(W.orderBy("_slot")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_slot").orderBy(*columns))
    return sorted_.withColumn("_row", within).join(before, "_slot").withColumn(target, F.col("_row") + F.col("_before")).drop("_slot", "_row", "_before")


def ordinal_index(df: DataFrame, column: str, order: Sequence[str], target: str = "__index__") -> DataFrame:
    """Position of each value in a given list."""
    names = F.array(*[F.lit(v) for v in order])
    return df.withColumn(target, (F.array_position(names, F.col(column)) - 1).cast("int"))


def kfold(days: DataFrame, n_splits: int, shuffle: bool = False, seed: int = 0, day: str = "day") -> DataFrame:
    """Fold 0..k-1 per distinct day: consecutive blocks, or blocks of a seeded order. One row per calendar day."""
    order = F.md5(F.concat_ws("|", F.col(day).cast("string"), F.lit(str(seed)))) if shuffle else F.col(day)
    tile = F.ntile(n_splits).over(W.orderBy(order))
    return days.select(day).distinct().select(day, (tile - 1).alias("fold"))


def training_folds(folds: DataFrame, n_splits: int, day: str = "day") -> DataFrame:
    """(day, fold) of the days used for training when ``fold`` is held out."""
    others = F.filter(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda k: k != F.col("fold"))
    return folds.select(day, F.explode(others).alias("fold"))


def count_days(df: DataFrame, start: str | None, end: str | None, day: str = "day") -> DataFrame:
    """Number of distinct days whose midnight label lies in the range."""
    from ..functions.dates import day_start, label_between
    return df.where(label_between(day_start(day), start, end)).agg(F.count_distinct(day).alias("n_days"))


def prefix_split(days: DataFrame, start: str, end: str, positional: bool = False, day: str = "day") -> DataFrame:
    """(day, is_train). Train days lie in the window; ``positional`` takes as many days from the front instead."""
    from ..functions.dates import day_start, label_between
    distinct = days.select(day).distinct()
    inside = label_between(day_start(day), start, end)
    if not positional:
        return distinct.select(day, inside.alias("is_train"))
    n = F.sum(F.when(inside, 1).otherwise(0)).over(W.partitionBy())
    return distinct.select(day, (F.row_number().over(W.orderBy(day)) <= n).alias("is_train"))
