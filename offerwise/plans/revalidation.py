"""One validation cycle: queue, budgeted checks, cascade, outcome, statistics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwise.operators import history, validation
from offerwise.operators.evidence import attach_evidence
from offerwise.operators.pricing import refresh_derived
from offerwise.params import Params
from offerwise.schemas import OFFERS, STATUSES, conform

KEY = "dedupe_key"


class Validated(NamedTuple):
    offers: DataFrame  # the validated offers, new state
    observations: DataFrame
    outcomes: DataFrame


def judge(queue: DataFrame, checks: DataFrame, params: Params) -> DataFrame:
    """Queued offers (with evidence) and their outcome.

    ``checks`` holds messages of the coupon field per code; only the budgeted codes
    use theirs.
    """
    budget = validation.check_budget(queue, params).select(KEY, F.lit(True).alias("checked"))
    verdicts = validation.check_verdicts(checks)
    used = budget.join(queue.select(KEY, "code"), KEY).join(verdicts, "code").drop("code")
    return validation.cascade(queue.join(used, KEY, "left"), params)


def revalidate(
    offers: DataFrame, sources: DataFrame, checks: DataFrame, params: Params
) -> Validated:
    """Validate what is due. The queue is bounded, so its evidence is gathered for it only."""
    queue = validation.validation_queue(offers, params)
    of_queue = sources.join(F.broadcast(queue.select(KEY)), KEY, "left_semi")
    judged = judge(attach_evidence(queue, of_queue, params), checks, params)
    applied = refresh_derived(validation.apply_outcome(judged, params), params)
    observations = history.observe(
        applied,
        params,
        previous_status=F.when(F.col("event") == "status_changed", F.col("previous_status")),
        validation_method=F.col("outcome_method"),
    )
    return Validated(conform(applied, OFFERS), observations, judged)


def validation_stats(outcomes: DataFrame) -> DataFrame:
    """Outcomes per status, zero-filled, with the attempts and the checks used."""
    c = F.col
    statuses = outcomes.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, STATUSES))).alias("outcome_status")
    )
    counted = outcomes.groupBy("outcome_status").agg(
        F.count(F.lit(1)).alias("offers"),
        F.count(F.when(c("checked"), 1)).alias("checks_used"),
    )
    return statuses.join(counted, "outcome_status", "left").select(
        c("outcome_status").alias("status"),
        F.coalesce("offers", F.lit(0)).alias("offers"),
        F.coalesce("checks_used", F.lit(0)).alias("checks_used"),
    )
