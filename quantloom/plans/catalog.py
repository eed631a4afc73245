"""Catalog of queries: each is an operator applied to the driver's tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
#: Added before rounding, so that exact halves go the same way in two engines.
NUDGE = 1e-9


def present(df: DataFrame) -> DataFrame:
    """Doubles to six digits and instants without a zone, so that two engines' results can be compared."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query; ``doubles`` names the columns of ``sql`` to round as ``present`` does."""

    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: present(f(spark, sf_dir))
        if sql is not None:
            parts = ", ".join(f"round({c} + {NUDGE}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            ORACLES[name] = f"SELECT * REPLACE ({parts}) FROM ({sql})" if parts else sql
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from quantloom.plans import (  # noqa: F401
        company_queries,
        comparative_queries,
        foundation_queries,
        graph_queries,
        market_queries,
        record_queries,
        source_queries,
        store_queries,
        stream_queries,
    )

    return QUERIES, ORACLES
