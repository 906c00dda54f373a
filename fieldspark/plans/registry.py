"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is its equivalent on the same tables, where one exists."""
    def add(fn):
        if name in RUN:
            raise ValueError(f"query {name} is registered twice")
        RUN[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def load() -> None:
    import importlib
    for module in ("captures", "rasters", "regions", "flights", "inspections", "corpora", "fleets", "expressions", "files", "streams"):
        try:
            importlib.import_module(f"fieldspark.plans.{module}")
        except ModuleNotFoundError as err:
            if err.name != f"fieldspark.plans.{module}":
                raise
