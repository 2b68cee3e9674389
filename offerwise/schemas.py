"""Table schemas and the row constraints that go with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISCOUNT_TYPES = ("flat", "percentage", "sale", "cashback", "unknown")
STATUSES = ("valid", "manual_validation_required", "unverified", "invalid", "expired")
SOURCE_TYPES = ("official", "coupon-site", "social", "community", "other")
EVENTS = (
    "discovered",
    "rediscovered",
    "terms_changed",
    "validated",
    "status_changed",
    "expired",
    "confidence_changed",
)

_TERMS = """
    discount_type STRING, discount_value DOUBLE, minimum_order DOUBLE, maximum_discount DOUBLE,
    is_up_to BOOLEAN, minimum_order_known BOOLEAN,
    new_users_only BOOLEAN, first_order_only BOOLEAN, app_only BOOLEAN,
    selected_users_only BOOLEAN, selected_products_only BOOLEAN, existing_users_allowed BOOLEAN
"""

# One claim: one offer as one page published it. ``seq`` is the arrival order.
CLAIMS = f"""
    seq BIGINT, dedupe_key STRING, code STRING, title STRING, raw_text STRING, {_TERMS},
    reported_expired BOOLEAN, expiry_date TIMESTAMP,
    source_name STRING, source_url STRING, source_type STRING, source_domain STRING,
    discovered_at TIMESTAMP, last_seen_at TIMESTAMP, snippet STRING
"""

# One row per real-world offer.
OFFERS = f"""
    dedupe_key STRING, code STRING, title STRING, {_TERMS}, expiry_date TIMESTAMP,
    currency STRING, country STRING, status STRING, confidence INT,
    source_count BIGINT, has_official_source BOOLEAN, conflicting_sources BOOLEAN,
    independent_sources BIGINT,
    target_match BOOLEAN, discount_at_target DOUBLE, final_price_at_target DOUBLE,
    effective_discount_at_target DOUBLE,
    first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, last_validated_at TIMESTAMP,
    validation_method STRING, validation_notes STRING, validation_attempts INT,
    cart_accepted_at TIMESTAMP, official_confirmed_at TIMESTAMP,
    created_at TIMESTAMP, updated_at TIMESTAMP
"""

# One row per (offer, publishing page). Kept apart from the offer, so an offer
# that a third of all pages publish never becomes one giant row.
SOURCES = """
    dedupe_key STRING, source_name STRING, source_url STRING, source_type STRING,
    source_domain STRING, discovered_at TIMESTAMP, last_seen_at TIMESTAMP, snippet STRING,
    claim_type STRING, claim_value DOUBLE, claim_minimum DOUBLE, claim_cap DOUBLE,
    reported_expired BOOLEAN, arrived_at TIMESTAMP, first_seq BIGINT
"""

OBSERVATIONS = """
    dedupe_key STRING, code STRING, event STRING, status STRING, previous_status STRING,
    source_name STRING, source_url STRING, source_type STRING,
    discount_type STRING, discount_value DOUBLE, minimum_order DOUBLE, maximum_discount DOUBLE,
    confidence INT, validation_result STRING, validation_method STRING,
    changes ARRAY<STRING>, observed_at TIMESTAMP
"""


def names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.replace("\n", " ").split(",") if part.strip()]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the schema's columns: missing ones null, others cast."""
    cols = []
    for part in ddl.replace("\n", " ").split(","):
        if part.strip():
            name, kind = part.split()
            value = F.col(name) if name in df.columns else F.lit(None)
            cols.append(value.cast(kind.lower()).alias(name))
    return df.select(*cols)


def offer_rules() -> dict[str, Column]:
    """Named rules an offer row must satisfy."""
    c = F.col
    money = ("discount_value", "minimum_order", "maximum_discount")
    return {
        "dedupe_key required": c("dedupe_key").isNotNull(),
        "known discount type": c("discount_type").isin(*DISCOUNT_TYPES),
        "known status": c("status").isin(*STATUSES),
        "confidence 0..100": c("confidence").between(0, 100),
        "amounts not negative": reduce(
            lambda a, b: a & b, (F.coalesce(c(m) >= 0, F.lit(True)) for m in money)
        ),
        "code trimmed upper case": F.coalesce(
            c("code") == F.upper(F.trim(c("code"))), F.lit(True)
        ),
        "hedge and minimum flags set": c("is_up_to").isNotNull()
        & c("minimum_order_known").isNotNull(),
    }


def violations(offers: DataFrame) -> DataFrame:
    """Offers that break a rule, with the names of the broken rules."""
    broken = F.filter(
        F.array(
            *(
                F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
                for name, ok in offer_rules().items()
            )
        ),
        lambda name: name.isNotNull(),
    )
    return offers.select("dedupe_key", broken.alias("broken_rules")).where(
        F.size("broken_rules") > 0
    )
