"""Registered queries over the given tables, each with the SQL it is checked against."""

from importlib import import_module

from .base import ORACLES, QUERIES

for _name in ("dates", "shaping", "scaling", "averages", "evaluations", "datasets", "regression", "solutions", "jobs"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
