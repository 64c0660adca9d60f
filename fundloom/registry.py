"""Queries by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import Tables, VIEWS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under the name. sql may use the fund-shaped views; null: not expressible, tested otherwise."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            text = sql.strip()
            low = text.lower()
            recursive = low.startswith("with recursive")
            body = text[len("with recursive") :] if recursive else text[len("with") :] if low.startswith("with ") else None
            ORACLES[name] = f"WITH {'RECURSIVE ' * recursive}{VIEWS_SQL}" + (f", {body.strip()}" if body else f" {text}")
        return f

    return add
