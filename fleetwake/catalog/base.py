"""Registry of the queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(c, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0.

    The double is scaled, rounded to a whole number and scaled back, as the SQL's ``round`` does. Spark's own
    ``round`` to digits goes by the decimal text instead and differs where that text ends in a five (311.5/3200).
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(float(10**digits))
    return F.round(c.cast("double") * scale) / scale + F.lit(0.0)


def us(c) -> Column:
    """Microseconds since the epoch, so that both engines compare one integer."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)
