"""Report assembly over a snapshot of offers and their sources."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from offerwise.operators import ranking, report
from offerwise.operators.evidence import attach_evidence
from offerwise.params import Params


class Report(NamedTuple):
    ranked: DataFrame
    groups: dict[str, DataFrame]
    target_matches: DataFrame
    potential_target_matches: DataFrame
    best: DataFrame
    counts: DataFrame


def build(offers: DataFrame, sources: DataFrame, params: Params) -> Report:
    """Everything a report shows. Reads only; statuses are never mixed."""
    ranked = ranking.rank_offers(attach_evidence(offers, sources, params), params)
    groups = {s: offers_of(ranked, s) for s in ranking.STATUSES}
    return Report(
        ranked,
        groups,
        ranking.target_matches(ranked),
        ranking.target_matches(ranked, potential=True),
        ranking.best_offer(ranked),
        ranking.count_by_status(ranked),
    )


def offers_of(offers: DataFrame, status: str) -> DataFrame:
    return offers.where(offers["status"] == status)


def publish(offers: DataFrame, sources: DataFrame, params: Params, folder: str) -> None:
    """Write the report files."""
    ranked = ranking.rank_offers(attach_evidence(offers, sources, params), params)
    report.write_reports(ranked, sources, params, folder)
