"""Run parameters. ``now`` is mandatory, so every run is deterministic."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    now: dt.datetime

    # who and where: one retail brand in one country
    brand: str = "acme"
    country: str = "India"
    country_code: str = "in"
    currency: str = "INR"
    robots_agent: str = "offerwise"

    # pricing
    target_cart: float = 1000.0
    target_discount: float = 800.0
    ladder: tuple[float, ...] = (999.0, 1000.0, 1099.0, 1199.0, 1299.0, 1499.0, 1999.0)

    # freshness rules
    revalidate_valid_hours: float = 24
    revalidate_unverified_hours: float = 6
    revalidate_invalid_hours: float = 72
    third_party_recent_days: float = 30
    official_recent_days: float = 7
    cart_evidence_hours: float = 48
    official_current_hours: float = 48
    expiry_report_days: float = 14

    # limits that are part of the results
    max_candidates_per_source: int = 60
    max_validations: int = 40
    max_cart_checks: int = 5
    search_pages_to_open: int = 5
    max_discovered_links: int = 4
    cart_checks_enabled: bool = True

    # off unless set: at most so many codes or texts of one page
    max_candidates_per_page: int | None = None

    # identity of offers without a code: whole texts unless set, else so many first characters
    # of the cleaned title (in the dedupe key) and of the text (within a page or document)
    title_key_chars: int | None = None
    text_key_chars: int | None = None

    # execution: a key is hot above max(hot_min_rows, total / hot_share) rows, so
    # there are never more than ``hot_share`` hot keys and they may be broadcast
    hot_share: int = 4096
    hot_min_rows: int = 1_000_000
    # written reports: offers with at most so many sources also nest them in their row;
    # off unless set, as the lineage table next to each report holds all sources as rows
    max_nested_sources: int | None = None

    extra_source_urls: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.now is None:
            raise ValueError("now is mandatory")

    @property
    def full_ladder(self) -> tuple[float, ...]:
        """The cart ladder, ascending, always holding the target."""
        return tuple(sorted({*map(float, self.ladder), float(self.target_cart)}))

    @property
    def now_utc(self) -> dt.datetime:
        if self.now.tzinfo is None:
            return self.now.replace(tzinfo=dt.timezone.utc)
        return self.now.astimezone(dt.timezone.utc)

    def now_col(self) -> Column:
        """``now`` as a TIMESTAMP literal, whatever the session time zone."""
        micros = (self.now_utc - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(
            microseconds=1
        )
        return F.timestamp_micros(F.lit(micros))
