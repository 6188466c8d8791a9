"""One-hot encoding with the category list fixed before the plan is built."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F


def categories(df: DataFrame, columns: Sequence[str], limit: int = 10_000) -> dict[str, list]:
    """Sorted distinct values of each column, found in one pass.

    They are about to become columns, so their number is checked; the rows fetched are bounded by that check.
    """
    columns = list(columns)
    if not columns:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v"))
                                for i, c in enumerate(columns)]))
    rows = df.select(cells.alias("c")).select("c.i", "c.v").distinct().limit((limit + 1) * len(columns)).collect()
    found: dict[str, list] = {c: [] for c in columns}
    for i, v in rows:
        if v is not None:
            found[columns[i]].append(v)
    types = dict(df.dtypes)
    for column, values in found.items():
        if len(values) > limit:
            raise ValueError(f"{column} has more than {limit} values; too many for one-hot columns")
        if types[column] in ("tinyint", "smallint", "int", "bigint"):
            found[column] = [int(v) for v in values]
        elif types[column] in ("float", "double"):
            found[column] = [float(v) for v in values]
        found[column].sort()
    return found


def one_hot(df: DataFrame, columns: Sequence[str], drop_last: bool = True, keep_source: bool = False,
            values: dict[str, list] | None = None, name: Callable[[str, object], str] | None = None) -> DataFrame:
    """Append 0/1 columns per category, in sorted order; NULL gives all zeros.

    Names are ``column=category`` unless ``name`` says otherwise. ``values`` supplies known category lists.
    """
    name = name or (lambda column, value: f"{column}={value}")
    out = df
    known = dict(values or {})
    known.update(categories(df, [c for c in columns if c not in known]))
    for column in columns:
        values_of = known[column]
        kept = values_of[:-1] if drop_last else values_of
        flags = {name(column, v): F.when(F.col(column) == F.lit(v), 1).otherwise(0) for v in kept}
        clash = set(flags) & set(out.columns)
        if clash:
            raise ValueError(f"one-hot names already in use: {sorted(clash)}")
        out = out.withColumns(flags)
    return out if keep_source else out.drop(*columns)
