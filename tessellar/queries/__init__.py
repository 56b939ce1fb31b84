"""The engine's named queries over the bound tables, and their oracle SQL.

A query's oracle is written independently of its DataFrame code. Values are quantised with
the same expression on both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.bindings import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "entity_signal_clusters"
#: Date the queries look back from; later rows never count.
AS_OF = "1998-12-31"


def as_of_day() -> Column:
    """:data:`AS_OF` as a date column (made when asked for: columns need a session)."""
    return F.lit(AS_OF).cast("date")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle if SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return put


for _name in ("lists", "aggregates", "temporal", "writes", "theme_queries", "ranking_queries", "graphs", "texts", "more", "learned"):
    importlib.import_module(f"tessellar.queries.{_name}")
