"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwise.params import Params
from offerwise.session import staged

# Key tables up to this many narrow rows are broadcast (about 10 MB).
BROADCAST_ROWS = 100_000
# Rows of a bucket, on average, of tables that are dealt by key.
BUCKET_ROWS = 500_000


class Dealt(NamedTuple):
    """Rows whose keys are whole in one part."""

    rows: DataFrame
    buckets: int | None  # bucketed by the key; None: not, as the keys are hot


def deal(
    rows: DataFrame,
    key: str,
    params: Params,
    shape: Callable[[DataFrame], DataFrame] = lambda dealt: dealt,
    same: str | None = None,
    late: bool = False,
    unit: int = 1,
) -> list[Dealt]:
    """``shape(rows)`` written once for many steps by ``key``, in parts that share no key.

    The first part is bucketed by key, so that grouping and joining by it need no shuffle. Keys
    that are hot as in ``split_join`` would dominate a bucket and are a part without buckets,
    which is there only if such keys are. Counting them reads the key alone, or ``same``, a cheaper
    column that is equal where keys are. ``shape`` keeps ``key`` and works on rows that are dealt
    already, so narrow rows are shuffled. ``late``: buckets hold the narrow rows too, and each step
    that reads them shapes the columns it uses; for a ``shape`` that is cheaper than its result is
    to write and to read. The number of buckets is a multiple of ``unit``.
    """
    spark = rows.sparkSession
    by = same or key
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    stats = counted.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    total = stats["total"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ROWS)
    buckets = -(-buckets // unit) * unit
    threshold = max(params.hot_min_rows, total // params.hot_share)

    def bucketed(cold: DataFrame) -> Dealt:
        placed = cold.repartition(buckets, key)
        if late:
            return Dealt(shape(staged(placed, key, buckets)), buckets)
        return Dealt(staged(shape(placed), key, buckets), buckets)

    if (stats["most"] or 0) <= threshold:
        return [bucketed(rows)]
    hot = F.broadcast(staged(counted.where(F.col("n") > threshold).select(by)))
    spread_out = staged(rows.join(hot, by, "left_semi"))
    return [bucketed(rows.join(hot, by, "left_anti")), Dealt(staged(shape(spread_out)), None)]


def split_join(
    rows: DataFrame,
    keyed: DataFrame,
    key: str | list[str],
    weight: str,
    finish: Callable[[DataFrame], DataFrame],
    params: Params,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """``finish(rows join keyed)``, where ``finish`` aggregates by ``key`` or finer.

    ``keyed`` has one narrow row per key and says in ``weight`` how many rows each
    key has; it should be materialised. Small: broadcast, so the rows are combined
    map-side before any shuffle. Large: keys above ``max(hot_min_rows, total /
    hot_share)`` rows, of which there are at most ``hot_share``, are broadcast, and
    the remaining rows are joined by key, where no key can dominate a task.
    """
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    stats = keyed.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("total")).first()
    if stats["n"] <= limit:
        return finish(rows.join(F.broadcast(keyed), key))

    threshold = max(params.hot_min_rows, (stats["total"] or 0) // params.hot_share)
    hot = keyed.where(F.col(weight) > threshold)
    cold = keyed.where(F.col(weight) <= threshold)
    keys = [key] if isinstance(key, str) else key
    others = rows.join(F.broadcast(hot.select(*keys)), key, "left_anti")
    return finish(rows.join(F.broadcast(hot), key)).unionByName(
        finish(others.join(cold, key))
    )
