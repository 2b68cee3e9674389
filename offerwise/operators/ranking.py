"""Ranking of offers, best offer, groups for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerwise.functions import pricing
from offerwise.operators.pricing import with_target_analysis
from offerwise.params import Params
from offerwise.schemas import STATUSES
from offerwise.session import staged


def status_rank() -> Column:
    """valid 0 ... expired 4; validity dominates every other signal."""
    return F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")) - 1


def rank_order() -> list[Column]:
    """Validity, payable price (not applicable last), effective discount, proof,
    confidence, freshness, independent sources, then the code in locale order."""
    c = F.col
    return [
        status_rank().asc(),
        F.coalesce(c("final_price_at_target"), F.lit(float("inf"))).asc(),
        c("effective_discount_at_target").desc(),
        c("target_match").desc(),
        c("uncertain").asc(),
        c("confidence").desc(),
        F.coalesce(c("last_seen_at"), F.timestamp_micros(F.lit(0))).desc(),
        c("independent_sources").desc(),
        F.collate(F.coalesce(c("code"), c("title"), F.lit("")), "UNICODE").asc(),
        c("dedupe_key").asc(),
    ]


def rank_offers(offers: DataFrame, params: Params) -> DataFrame:
    """Offers with their analysis, globally sorted by a range shuffle."""
    return with_target_analysis(offers, params).orderBy(*rank_order())


def numbered(ranked: DataFrame, name: str = "position") -> DataFrame:
    """Append the 1-based position of a sorted frame without gathering it.

    The sorted rows are materialised; a row's position is its index inside its
    partition plus the sizes of the partitions before it (one row per partition).
    """
    held = staged(ranked.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    return (
        held.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_row") - F.shiftleft("_part", 33) + 1)
        .drop("_part", "_row", "_start")
    )


def best_offer(ranked: DataFrame, statuses: tuple[str, ...] = ("valid",)) -> DataFrame:
    """The first offer of the wanted statuses."""
    return ranked.where(F.col("status").isin(*statuses)).orderBy(*rank_order()).limit(1)


def target_matches(ranked: DataFrame, potential: bool = False) -> DataFrame:
    """Offers that reach the target, provably or (``potential``) under assumptions."""
    return ranked.where(F.col("potential_target_match" if potential else "target_match"))


def near_misses(ranked: DataFrame, limit: int = 10) -> DataFrame:
    """The best potential matches."""
    return target_matches(ranked, potential=True).orderBy(*rank_order()).limit(limit)


def top_per_status(ranked: DataFrame, limit: int = 20) -> DataFrame:
    """The first offers of each status with their place and the overflow count.

    The limit is applied on both sides of the shuffle; group sizes come from a
    five-row count.
    """
    place = F.row_number().over(Window.partitionBy("status").orderBy(*rank_order()))
    top = ranked.withColumn("place", place).where(F.col("place") <= limit)
    sizes = ranked.groupBy("status").agg(F.count(F.lit(1)).alias("group_size"))
    more = F.greatest(F.lit(0), F.col("group_size") - limit)
    return top.join(F.broadcast(sizes), "status").withColumn("overflow", more)


def count_by_status(offers: DataFrame) -> DataFrame:
    """Offers per status, zero-filled, and the total."""
    counts = offers.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    shown = F.explode(F.array(*map(F.lit, (*STATUSES, "total"))))
    listed = offers.sparkSession.range(1).select(shown.alias("status"))
    total = counts.agg(F.lit("total").alias("status"), F.sum("n").alias("n"))
    return listed.join(counts.unionByName(total), "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("offers")
    )


def scan_summary(ranked: DataFrame, params: Params) -> DataFrame:
    """The 25 best valid or manual offers; when there are none, the 15 best of all."""
    c = F.col
    actionable = c("status").isin("valid", "manual_validation_required")
    front = (
        ranked.where(actionable)
        .orderBy(*rank_order())
        .limit(25)
        .unionByName(ranked.where(~actionable).orderBy(*rank_order()).limit(15))
    )
    # at most 40 rows from here on
    ordered = Window.partitionBy(F.lit(1)).orderBy(*rank_order())
    whole = Window.partitionBy(F.lit(1))
    proven = F.max(actionable).over(whole)
    shown = (
        front.withColumns({"_proven": proven, "place": F.row_number().over(ordered)})
        .where(actionable | (~c("_proven") & (c("place") <= 15)))
    )
    minimum = F.when(
        c("minimum_order_known") & c("minimum_order").isNotNull(),
        pricing.format_rupees(c("minimum_order")),
    ).otherwise("?")
    return shown.select(
        "place",
        F.coalesce("code", F.lit("(no code)")).alias("code"),
        F.concat(
            pricing.offer_label(), F.when(c("target_match"), " *TARGET*").otherwise("")
        ).alias("offer"),
        minimum.alias("minimum"),
        pricing.format_rupees(c("final_price_at_target")).alias("payable"),
        F.upper("status").alias("status"),
        c("confidence").cast("bigint").alias("confidence"),
    )
