"""Pricing operators over offers: ladders, target analysis, cached derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwise.functions import pricing
from offerwise.operators.evidence import confidence_factors, confidence_score
from offerwise.params import Params


def price_ladder(offers: DataFrame, params: Params) -> DataFrame:
    """One row per offer and cart value."""
    return offers.select(
        "dedupe_key", F.inline(pricing.ladder(params))
    )


def with_target_analysis(offers: DataFrame, params: Params) -> DataFrame:
    """Append the analysis at the target cart.

    A strict match needs published terms; a hit that rests on an assumption is only
    a potential match.
    """
    target = F.lit(float(params.target_cart))
    at = F.col("_at")
    hit = (at["discount"] >= params.target_discount) & (
        at["final_price"] <= params.target_cart - params.target_discount
    )
    return (
        offers.withColumns({"_at": pricing.breakdown(target)})
        .withColumn("uncertainty_reason", pricing.uncertainty_reason())
        .withColumns(
            {
                "uncertain": F.col("uncertainty_reason").isNotNull(),
                "applicable_at_target": at["applicable"],
                "discount_at_target": at["discount"],
                # no payable price when the offer cannot apply
                "final_price_at_target": F.when(at["applicable"], at["final_price"]),
                "effective_discount_at_target": at["effective_discount"],
                "refusal_reason": at["reason"],
                "target_match": hit & F.col("uncertainty_reason").isNull(),
                "potential_target_match": hit & F.col("uncertainty_reason").isNotNull(),
            }
        )
        .drop("_at")
    )


ANALYSIS_ONLY = [
    "uncertainty_reason",
    "uncertain",
    "applicable_at_target",
    "refusal_reason",
    "potential_target_match",
]


def refresh_derived(offers: DataFrame, params: Params) -> DataFrame:
    """Recompute the confidence and the cached target columns of offers with evidence."""
    return (
        with_target_analysis(offers, params)
        .drop(*ANALYSIS_ONLY)
        .withColumn("confidence", confidence_score(confidence_factors(params)))
    )
