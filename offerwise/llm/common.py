"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwise.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Most rows of a side that is broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 200_000


#: Rows that a Python worker gets at a time, as texts may be long.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Keep the record batches of Python workers short, unless the session has them shorter."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Lineage ends there, so a lost executor costs a reread, and columns that no one
    reads are pruned. ``options`` are the writer's.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted and found to have few rows.

    ``df`` must be staged, as it is counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")).cast("string")


def lower_ascii(value: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(value, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once per row.

    Without it the optimiser may put a costly expression into a lambda function, where it
    would be evaluated for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
