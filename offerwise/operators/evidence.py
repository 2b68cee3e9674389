"""Evidence per offer from its sources, and the confidence score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.functions.text import days_since, hours_since
from offerwise.functions.urls import normalise_domain
from offerwise.params import Params

KEY = "dedupe_key"


def by_domain(sources: DataFrame, params: Params) -> DataFrame:
    """Evidence per (offer, domain); sources whose domain does not matter have none.

    Only recent third-party publications and recent reports count by domain, and only recent
    official pages are quoted, so other sources of an offer are combined into one row, by a hash
    aggregation over numbers. Those that are left keep an offer with very many sources spread
    over tasks by domain, and counting distinct domains this way needs no distinct aggregate.
    """
    c, now = F.col, params.now_col()
    official = c("source_type") == "official"
    reports = F.coalesce(c("reported_expired"), F.lit(False))
    recent_report = reports & (
        hours_since(c("last_seen_at"), now) <= 24 * params.expiry_report_days
    )
    current = (
        official
        & ~reports
        & (hours_since(c("last_seen_at"), now) <= params.official_current_hours)
    )
    recent = ~official & (days_since(c("last_seen_at"), now) <= params.third_party_recent_days)
    # arrival order; negated so that the earliest wins among equally recent ones
    arrived = F.unix_micros("arrived_at").alias("arrived")
    is_current = F.coalesce(current, F.lit(False)).alias("current")
    quoted = F.struct(is_current, arrived, "first_seq", "last_seen_at", "source_url")
    quoted = F.when((recent_report & official) | current, quoted).alias("quoted")
    concrete = c("claim_value").isNotNull() & c("claim_type").isNotNull()
    claim = {
        "claim_type": F.xxhash64("claim_type"),  # only whether types differ matters
        "claim_value": c("claim_value"),
        "claim_minimum": c("claim_minimum"),
    }
    domain = normalise_domain(F.coalesce("source_domain", "source_url"))
    domain = F.when(F.coalesce(recent | recent_report, F.lit(False)), domain).alias("domain")
    combined = sources.groupBy(KEY, domain, quoted).agg(
        F.count(F.lit(1)).alias("sources"),
        F.max(F.when(official, c("last_seen_at"))).alias("official_seen"),
        F.max(F.coalesce(recent, F.lit(False))).alias("recent"),
        F.count(F.when(reports, 1)).alias("expired_reports"),
        F.count(F.when(recent_report, 1)).alias("recent_reports"),
        *(F.min(F.when(concrete, v)).alias(f"{n}_min") for n, v in claim.items()),
        *(F.max(F.when(concrete, v)).alias(f"{n}_max") for n, v in claim.items()),
    )
    at = c("quoted")
    order = F.when(~at["current"], F.struct(at["arrived"], at["first_seq"]))
    newest = F.when(at["current"], F.struct(at["last_seen_at"], -at["arrived"], -at["first_seq"]))
    return combined.groupBy(KEY, "domain").agg(
        F.sum("sources").alias("sources"),
        F.max("official_seen").alias("official_seen"),
        F.max("recent").alias("recent"),
        F.sum("expired_reports").alias("expired_reports"),
        F.sum("recent_reports").alias("recent_reports"),
        F.min(order).alias("report_order"),
        F.min_by(at["source_url"], order).alias("report_url"),
        F.max(newest).alias("current_order"),
        F.max_by(at["source_url"], newest).alias("current_url"),
        *(F.min(f"{n}_min").alias(f"{n}_min") for n in claim),
        *(F.max(f"{n}_max").alias(f"{n}_max") for n in claim),
    )


def evidence(sources: DataFrame, params: Params) -> DataFrame:
    """One row per offer: everything scoring and validation read from the sources."""
    c = F.col
    differs = [
        F.coalesce(F.min(f"{n}_min") != F.max(f"{n}_max"), F.lit(False))
        for n in ("claim_type", "claim_value", "claim_minimum")
    ]
    return (
        by_domain(sources, params)
        .groupBy(KEY)
        .agg(
            F.sum("sources").alias("source_count"),
            F.max("official_seen").alias("official_last_seen_at"),
            F.count(F.when(c("recent") & (c("domain") != ""), 1)).alias("independent_sources"),
            (F.sum("expired_reports") > 0).alias("any_reported_expired"),
            F.sum("recent_reports").alias("recent_expiry_reports"),
            F.count(F.when(c("recent_reports") > 0, 1)).alias("reporting_domains"),
            F.min_by("report_url", "report_order").alias("official_report_url"),
            F.max_by("current_url", "current_order").alias("current_official_url"),
            F.max("current_order")["last_seen_at"].alias("current_official_seen_at"),
            (differs[0] | differs[1] | differs[2]).alias("conflicting_sources"),
        )
        .withColumn("has_official_source", c("official_last_seen_at").isNotNull())
    )


EVIDENCE_COLUMNS = [
    "source_count",
    "official_last_seen_at",
    "independent_sources",
    "any_reported_expired",
    "recent_expiry_reports",
    "reporting_domains",
    "official_report_url",
    "current_official_url",
    "current_official_seen_at",
    "conflicting_sources",
    "has_official_source",
]


def attach_evidence(offers: DataFrame, sources: DataFrame, params: Params) -> DataFrame:
    """Offers with fresh evidence columns, replacing stored ones."""
    base = offers.drop(*EVIDENCE_COLUMNS)
    return base.join(evidence(sources, params), KEY, "left").fillna(
        {
            "source_count": 0,
            "independent_sources": 0,
            "recent_expiry_reports": 0,
            "reporting_domains": 0,
            "any_reported_expired": False,
            "conflicting_sources": False,
            "has_official_source": False,
        }
    )


def independent_sources(sources: DataFrame, params: Params) -> DataFrame:
    """Distinct third-party domains that published an offer recently."""
    c = F.col
    domain = normalise_domain(F.coalesce("source_domain", "source_url")).alias("domain")
    recent = (
        days_since(c("last_seen_at"), params.now_col()) <= params.third_party_recent_days
    ) & (c("source_type") != "official")
    return (
        sources.groupBy(KEY, domain)
        .agg(F.max(recent).alias("recent"))
        .groupBy(KEY)
        .agg(F.count(F.when(c("recent") & (c("domain") != ""), 1)).alias("independent_sources"))
    )


def expiry_reports(sources: DataFrame, params: Params) -> DataFrame:
    """Whether reports that an offer expired are reliable, and why."""
    c = F.col
    found = evidence(sources, params).where(c("recent_expiry_reports") > 0)
    return found.select(
        KEY,
        "recent_expiry_reports",
        "reporting_domains",
        report_is_reliable().alias("reliable"),
        report_detail().alias("detail"),
    )


def report_is_reliable() -> Column:
    """An official page, or two independent domains, report the expiry."""
    return F.col("official_report_url").isNotNull() | (F.col("reporting_domains") >= 2)


def report_detail() -> Column:
    c = F.col
    return (
        F.when(
            c("official_report_url").isNotNull(),
            F.concat(
                F.lit("official page lists this offer as expired ("),
                c("official_report_url"),
                F.lit(")"),
            ),
        )
        .when(
            c("reporting_domains") >= 2,
            F.concat(
                c("reporting_domains").cast("string"),
                F.lit(" independent sources report this offer as expired"),
            ),
        )
        .when(
            c("recent_expiry_reports") > 0,
            F.lit("1 source reports this offer as expired (not sufficient on its own)"),
        )
        .otherwise(F.lit(""))
    )


def confidence_factors(params: Params) -> Column:
    """The factors that apply, as array<struct<label, points>>."""
    c, now = F.col, params.now_col()
    official = F.least(
        days_since(c("official_last_seen_at"), now), days_since(c("official_confirmed_at"), now)
    )
    seen = hours_since(c("last_seen_at"), now)
    past_expiry = F.coalesce(c("expiry_date") < now, F.lit(False))
    rules = [
        (
            hours_since(c("cart_accepted_at"), now) <= params.cart_evidence_hours,
            "accepted by legitimate cart validation",
            50,
        ),
        (
            official <= params.official_recent_days,
            f"current official {params.brand.upper()} source",
            35,
        ),
        (c("independent_sources") >= 2, "second independent recent source", 10),
        (c("independent_sources") >= 3, "third independent recent source", 5),
        (seen <= 24, "seen within 24 hours", 10),
        ((seen > 24) & (seen <= 24 * 7), "seen within 7 days", 5),
        (
            days_since(c("last_seen_at"), now) > params.third_party_recent_days,
            f"not seen for over {params.third_party_recent_days:g} days",
            -20,
        ),
        (c("conflicting_sources"), "sources disagree on the offer terms", -20),
        (c("any_reported_expired"), "reported expired by a source", -50),
        (~c("any_reported_expired") & past_expiry, "past its published expiry date", -50),
    ]
    listed = F.array(
        *(
            F.when(cond, F.struct(F.lit(label).alias("label"), F.lit(points).alias("points")))
            for cond, label, points in rules
        )
    )
    return F.filter(listed, lambda f: f.isNotNull())


def confidence_score(factors: Column) -> Column:
    """Sum of the points, kept within 0..100."""
    total = F.aggregate(factors, F.lit(0), lambda acc, f: acc + f["points"])
    return F.least(F.lit(100), F.greatest(F.lit(0), total)).cast("int")
