"""Readers of delimited files and writers of results, models and manifests."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import format_padded, parse_timestamp
from ..operators.joins import left_join_all
from ..operators.reshape import long_to_wide, wide_to_long


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV with a stated schema: no inference pass over the data."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, enforceSchema=False)


def read_joined(spark: SparkSession, paths: Sequence[str], schemas: Sequence[str], key: str = "ts",
                sep: str = ",") -> DataFrame:
    """LEFT JOIN of several files on one key; duplicate rows are dropped."""
    return left_join_all([read_delimited(spark, p, s, sep) for p, s in zip(paths, schemas)], key)


def wide_columns(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names from the header line; no data is read."""
    return spark.read.csv(path, header=True, sep=sep).columns


def read_wide(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, index: str = "Datetime",
              text: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """Wide files with one row per ``index`` label, joined: (ts, columns...).

    Columns are numbers unless listed in ``text``; ``columns`` selects and orders them.
    """
    schemas = [", ".join(f"`{c}` {'STRING' if c == index or c in text else 'DOUBLE'}" for c in wide_columns(spark, p, sep))
               for p in paths]
    joined = read_joined(spark, paths, schemas, index, sep)
    columns = [c for c in joined.columns if c != index] if columns is None else list(columns)
    return joined.select(parse_timestamp(index).alias("ts"), *[F.col(f"`{c}`") for c in columns])


def read_observations(spark: SparkSession, paths: Sequence[str], series: Sequence[str] | None = None,
                      index: str = "Datetime", sep: str = ",") -> DataFrame:
    """Wide observation or prediction files as (series_id, ts, value)."""
    return wide_to_long(read_wide(spark, paths, series, index, sep=sep), "ts", series)


def write_wide(df: DataFrame, path: str, series: Sequence[str], force: bool = False, index: str = "Datetime") -> str:
    """(series_id, ts, value) as CSV with one column per series and padded time labels."""
    wide = long_to_wide(df, series)
    return write_table(wide.select(format_padded("ts").alias(index), *[F.col(f"`{s}`") for s in series]), path, force, "csv")


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """One ISO date per line, no header."""
    return spark.read.csv(path, schema="day DATE", header=False)


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """``start;end`` per line, both inclusive, no header."""
    return spark.read.csv(path, schema="start_day DATE, end_day DATE", sep=";", header=False)


def read_tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in names]


def write_table(df: DataFrame, path: str, force: bool = False, fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> str:
    """Write a table; an existing one is an error unless ``force``."""
    writer = df.write.mode("overwrite" if force else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def finished_folders(spark: SparkSession, folder: str) -> list[str]:
    """Folders below ``folder`` whose write was committed, in order of name; half-written ones are not listed."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    return sorted(f.getPath().getParent().toString() for f in found)


def write_predictions(preds: DataFrame, folder: str, start: str, end: str, force: bool = False,
                      fmt: str = "parquet") -> str:
    """``<folder>/<start>_<end>``, one directory per model."""
    return write_table(preds, f"{folder}/{start[:10]}_{end[:10]}", force, fmt, ["model"])


def write_report(errors: DataFrame, path: str, force: bool = False, decimals: int = 2, fmt: str = "csv") -> str:
    """Error table with its numbers rounded half-even."""
    rounded = [F.bround(c, decimals).alias(c) if t == "double" else F.col(c) for c, t in errors.dtypes]
    return write_table(errors.select(*rounded), path, force, fmt)


def write_manifest(spark: SparkSession, path: str, infos: dict, force: bool = False) -> str:
    """Run description as a one-row JSON table of text values."""
    row = {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in infos.items()}
    df = spark.createDataFrame([(row,)], "infos map<string,string>")
    return write_table(df.coalesce(1), path, force, "json")


def read_manifest(spark: SparkSession, path: str) -> dict[str, str]:
    return spark.read.schema("infos map<string,string>").json(path).first()["infos"]
