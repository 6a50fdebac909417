"""Collects the registered queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return add


def _nudge(digits: int) -> float:
    """A fixed offset far below the last kept digit, so that exact decimal ties fall the same way in both engines."""
    return 1.2345678 * 10.0 ** -(digits + 1)


def settle(column: str, digits: int) -> Column:
    """One double column rounded so that summation order cannot show; adding 0.0 turns -0.0 into 0.0."""
    return (F.round(F.col(f"`{column}`") + F.lit(_nudge(digits)), digits) + F.lit(0.0)).alias(column)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """``settle`` on every double column."""
    return df.select([settle(n, digits) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def rnd(expr: str, digits: int = 6) -> str:
    """The same rounding, as SQL text."""
    return f"(round(({expr}) + {_nudge(digits)!r}::double, {digits}) + 0.0::double)"
