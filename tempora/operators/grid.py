"""Regular time grids and filling over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from ..functions.dates import day_start, from_epoch_seconds, seconds, timestamp_list


def clock_seconds(clock: str) -> int:
    hour, minute, second = (int(p) for p in clock.split(":"))
    return hour * 3600 + minute * 60 + second


def steps_per_day(start_time: str, end_time: str, step_seconds: int) -> int:
    """Number of stamps of one day, counting the one that overshoots when the step does not divide the span."""
    span = clock_seconds(end_time) - clock_seconds(start_time)
    return max(0, -(-span // step_seconds)) + 1


def time_range(spark: SparkSession, start_second: int, end_second: int, step_seconds: int) -> DataFrame:
    """A grid between two epoch seconds as a distributed range (column ``ts``)."""
    n = max(0, -(-(end_second - start_second) // step_seconds)) + 1
    return spark.range(n).select(from_epoch_seconds(F.lit(start_second) + F.col("id") * step_seconds).alias("ts"))


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """Spread rows that are about to be exploded, so that few input rows do not mean few tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


def day_grid(days: DataFrame, start_time: str = "00:00:00", end_time: str = "23:45:00", step_seconds: int = 900,
             day: str = "day") -> DataFrame:
    """Rows of ``days`` exploded to the day's stamps: adds ``step`` and ``ts``."""
    first = day_start(day) + seconds(clock_seconds(start_time))
    last = day_start(day) + seconds(clock_seconds(end_time))
    rest = [F.col(c) for c in days.columns]
    return days.select(*rest, F.posexplode(timestamp_list(first, last, step_seconds)).alias("step", "ts"))


def densify(obs: DataFrame, start_time: str = "00:00:00", end_time: str = "23:45:00", step_seconds: int = 900,
            keys: Sequence[str] = ("series_id",), value: str = "value", fill: float = 0.0) -> DataFrame:
    """Every series gets every step of every day that occurs for any series; missing values become ``fill``.

    Rows off the grid vanish and absent days are not created. The day list enters as one array value (its length
    is a number of calendar days), so series and days meet without a cross join; the observations are shuffled
    once, on (series, ts). ``obs`` is read three times, so it should be a stored table.
    """
    keys = list(keys)
    day_list = obs.agg(F.collect_set(F.to_date("ts")).alias("days")).scalar()
    cells = obs.select(*keys).distinct().select(*keys, F.explode(day_list).alias("day"))
    grid = day_grid(_spread(cells, *keys, "day"), start_time, end_time, step_seconds)
    return (grid.join(obs.select(*keys, "ts", value), [*keys, "ts"], "left")
            .select(*keys, "ts", "day", "step", F.coalesce(F.col(value), F.lit(fill)).alias(value)))


def fill_forward_backward(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), ts: str = "ts",
                          chunk: Column | None = None) -> DataFrame:
    """Forward fill, then backward fill, in time order across days.

    The order runs over the whole table, yet no task holds more than one chunk (default: a day): each chunk is
    summarised by its first and last known values, the summaries (one row per chunk) are filled over all chunks,
    and every chunk then only needs its own rows and two carried values.
    """
    keys, columns = list(keys), list(columns)
    chunk = F.to_date(F.col(ts)) if chunk is None else chunk
    cut = df.withColumn("_chunk", chunk)

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(ts))

    ends = []
    for c in columns:
        ends += [F.max_by(F.col(c), known(c)).alias(f"_last_{c}"), F.min_by(F.col(c), known(c)).alias(f"_first_{c}")]
    summary = cut.groupBy(*keys, "_chunk").agg(*ends)
    over_chunks = W.partitionBy(*keys).orderBy("_chunk")
    before = over_chunks.rowsBetween(W.unboundedPreceding, -1)
    after = over_chunks.rowsBetween(1, W.unboundedFollowing)
    carried = summary.select(
        *keys, "_chunk",
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns],
        *[F.first(f"_first_{c}", ignorenulls=True).over(after).alias(f"_out_{c}") for c in columns])

    inside = W.partitionBy(*keys, "_chunk").orderBy(ts)
    up_to = inside.rowsBetween(W.unboundedPreceding, 0)
    from_here = inside.rowsBetween(0, W.unboundedFollowing)
    joined = cut.join(carried, [*keys, "_chunk"])
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(up_to), F.col(f"_in_{c}"),
                            F.first(c, ignorenulls=True).over(from_here), F.col(f"_out_{c}")) for c in columns}
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])
