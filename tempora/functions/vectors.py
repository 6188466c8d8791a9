"""Expressions on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, where plain nesting in a lambda would compute it per element."""
    return F.transform(F.array(value), body)[0]


def unit(v: Column) -> Column:
    """The vector divided by its length."""
    return bind(norm(v), lambda length: F.transform(v, lambda e: e / length))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NULL when either vector is all zeros."""
    return bind(norm(a) * norm(b), lambda scale: F.when(scale > 0, dot(a, b) / scale))
