"""Query registry: name -> Spark function and, where SQL can state it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def cents_sql(x: str) -> str:
    """Half-up rounding to cents on the shortest decimal form of a double."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE)"


def words_sql(text: str) -> str:
    r"""Words of more than two characters."""
    return rf"list_filter(string_split_regex({text}, '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2)"
