"""The register of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerwise.session import carry_code

carry_code()

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its name.

    ``oracle`` is the equivalent SQL for the same tables; none where SQL cannot
    express the operator.
    """

    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def ts(name: str) -> Column:
    """Second-precision text: the same in every engine."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def big(value: str | Column, name: str | None = None) -> Column:
    """As BIGINT, the width every engine counts in."""
    col = F.col(value) if isinstance(value, str) else value
    return col.cast("bigint").alias(name or value)
