"""Freshness rules, work queues, the evidence cascade and its outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.functions import messages
from offerwise.functions.text import hours_since, iso_ms
from offerwise.operators.evidence import report_detail, report_is_reliable
from offerwise.params import Params

KEY = "dedupe_key"


def is_past_expiry(params: Params) -> Column:
    return F.coalesce(F.col("expiry_date") < params.now_col(), F.lit(False))


def is_due(params: Params) -> Column:
    """The validity information is stale: age against the status's threshold."""
    c = F.col
    age = hours_since(c("last_validated_at"), params.now_col())
    limit = (
        F.when(c("status") == "valid", params.revalidate_valid_hours)
        .when(c("status") == "invalid", params.revalidate_invalid_hours)
        .otherwise(params.revalidate_unverified_hours)
    )
    return (c("status") != "expired") & (is_past_expiry(params) | (age >= limit))


def queue_order() -> list[Column]:
    """Most promising first; offers without a payable price come first among equals."""
    c = F.col
    return [
        c("target_match").desc(),
        c("final_price_at_target").asc_nulls_first(),
        c("confidence").desc(),
        c("last_seen_at").desc(),
        c(KEY).asc(),
    ]


def validation_queue(offers: DataFrame, params: Params, limit: int | None = None) -> DataFrame:
    """Offers to revalidate now: of all that are due, the n most promising."""
    n = params.max_validations if limit is None else limit
    due = offers.where((F.col("status") != "expired") & is_due(params))
    return due.orderBy(*queue_order()).limit(n)


def check_eligible(params: Params) -> Column:
    """The cascade would reach the coupon-field check."""
    return (
        F.lit(params.cart_checks_enabled)
        & ~is_past_expiry(params)
        & F.col("current_official_url").isNull()
        & F.col("code").isNotNull()
    )


def check_budget(queue: DataFrame, params: Params) -> DataFrame:
    """The queued offers whose codes are checked: the first B eligible, in queue order."""
    return (
        queue.where(check_eligible(params))
        .orderBy(*queue_order())
        .limit(params.max_cart_checks)
    )


def check_verdicts(checks: DataFrame) -> DataFrame:
    """Verdict, detail and disclosed terms per checked code."""
    c = F.col
    judged = checks.withColumn("verdict", messages.verdict(c("message")))
    discloses = c("verdict").isin("accepted", "conditional")
    terms = {
        name: F.when(discloses, value)
        for name, value in messages.terms_in_message(c("message")).items()
    }
    return judged.withColumns(
        {"detail": messages.verdict_detail(c("verdict"), c("message"), c("code")), **terms}
    ).drop("message")


def _note_for_unverified(params: Params) -> Column:
    c = F.col
    coded = (
        "the customer-facing coupon field could not be reached (empty guest cart, sign-in wall "
        "or anti-bot protection)"
        if params.cart_checks_enabled
        else "cart validation is disabled"
    )
    return F.concat_ws(
        "; ",
        F.when(c("code").isNotNull(), F.lit(coded)).otherwise(
            F.lit("promotion has no coupon code, so there is nothing to test in a cart")
        ),
        F.concat(
            c("independent_sources").cast("string"),
            F.lit(" independent recent third-party source(s) publish it"),
        ),
        F.lit("copies between coupon sites are not treated as confirmation"),
        F.when(
            c("is_up_to"), F.lit('advertised as an "up to" offer, so the real value is unknown')
        ),
        F.when(c("selected_users_only"), F.lit("published as a selected-users offer")),
        F.when(c("app_only"), F.lit("published as an app-only offer")),
        F.when(
            c("selected_products_only"),
            F.lit("published as applying to selected products only"),
        ),
        F.nullif(report_detail(), F.lit("")),
    )


def cascade(offers: DataFrame, params: Params) -> DataFrame:
    """Append outcome_status, outcome_method, outcome_notes and accepted_by_cart.

    Reads evidence columns, and ``verdict``/``detail`` of a check (null: not checked).
    The first proof wins: past expiry, current official publication, the coupon
    field, reliable expiry reports. Third-party claims alone never make an offer valid.
    """
    c = F.col
    checked = check_eligible(params)
    rules = [
        (
            is_past_expiry(params),
            "expired",
            "expiry-date",
            F.concat(F.lit("published expiry "), iso_ms(c("expiry_date")), F.lit(" has passed")),
        ),
        (
            c("current_official_url").isNotNull(),
            "valid",
            "official-publication",
            F.concat(
                F.lit(
                    f"still published on an official {params.brand.upper()} {params.country} page ("
                ),
                c("current_official_url"),
                F.lit(", last seen "),
                iso_ms(c("current_official_seen_at")),
                F.lit(")"),
            ),
        ),
        (checked & (c("verdict") == "accepted"), "valid", "cart-coupon-field", c("detail")),
        (checked & (c("verdict") == "rejected"), "invalid", "cart-coupon-field", c("detail")),
        (
            checked & (c("verdict") == "conditional"),
            "manual_validation_required",
            "cart-coupon-field",
            F.concat(c("detail"), F.lit(" - a qualifying cart is required to confirm")),
        ),
        (
            checked & (c("verdict") == "blocked"),
            "manual_validation_required",
            "cart-coupon-field",
            F.concat(c("detail"), F.lit("; validation stops here by policy")),
        ),
        (report_is_reliable(), "invalid", "source-expiry-reports", report_detail()),
    ]
    status = F.lit("unverified")
    method = F.lit("public-sources-only")
    notes = _note_for_unverified(params)
    for cond, to_status, by_method, note in reversed(rules):
        hit = F.coalesce(cond, F.lit(False))
        status = F.when(hit, to_status).otherwise(status)
        method = F.when(hit, by_method).otherwise(method)
        notes = F.when(hit, note).otherwise(notes)
    accepted = F.coalesce(checked & (c("verdict") == "accepted"), F.lit(False)) & (
        status == "valid"
    ) & (method == "cart-coupon-field")
    return offers.withColumns(
        {
            "outcome_status": status,
            "outcome_method": method,
            "outcome_notes": notes,
            "accepted_by_cart": accepted,
        }
    )


def apply_expiry_state(offers: DataFrame, params: Params) -> DataFrame:
    """Past its published expiry an offer becomes expired and stays so."""
    c = F.col
    moves = is_past_expiry(params) & (c("status") != "expired")
    note = F.concat(F.lit("published expiry "), iso_ms(c("expiry_date")), F.lit(" has passed"))
    return offers.withColumns(
        {
            "status": F.when(moves, "expired").otherwise(c("status")),
            "validation_method": F.when(moves, "expiry-date").otherwise(c("validation_method")),
            "validation_notes": F.when(moves, note).otherwise(c("validation_notes")),
        }
    )


def apply_outcome(judged: DataFrame, params: Params) -> DataFrame:
    """Write the cascade's outcome onto the offers; terms the field disclosed win.

    ``previous_status`` and ``event`` are appended for the history. Derived columns
    are refreshed by the caller.
    """
    c, now = F.col, params.now_col()
    told = c("outcome_method") == "cart-coupon-field"
    known_minimum = told & c("observed_minimum").isNotNull()
    changed = judged.withColumn("previous_status", c("status")).withColumns(
        {
            "status": c("outcome_status"),
            "last_validated_at": now,
            "validation_method": c("outcome_method"),
            "validation_notes": c("outcome_notes"),
            "validation_attempts": (c("validation_attempts") + 1).cast("int"),
            "cart_accepted_at": F.when(c("accepted_by_cart"), now).otherwise(
                c("cart_accepted_at")
            ),
            "minimum_order": F.when(known_minimum, c("observed_minimum")).otherwise(
                c("minimum_order")
            ),
            "minimum_order_known": known_minimum | c("minimum_order_known"),
            "discount_value": F.when(
                told & c("observed_value").isNotNull(), c("observed_value")
            ).otherwise(c("discount_value")),
            "discount_type": F.when(
                told & c("observed_type").isNotNull(), c("observed_type")
            ).otherwise(c("discount_type")),
        }
    )
    result = F.concat_ws(": ", "outcome_status", "outcome_notes")
    return apply_expiry_state(changed, params).withColumns(
        {
            "event": F.when(c("previous_status") == c("status"), "validated").otherwise(
                "status_changed"
            ),
            "validation_result": result,
        }
    )


def expire_sweep(offers: DataFrame, params: Params) -> DataFrame:
    """Only the offers that just passed their expiry, moved to expired."""
    due = offers.where(is_past_expiry(params) & (F.col("status") != "expired"))
    return apply_expiry_state(due.withColumn("previous_status", F.col("status")), params)


def rescore(offers: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Offers whose confidence moved by 5 or more between two snapshots."""
    before = offers.select(KEY, F.col("confidence").alias("previous_confidence"))
    moved = F.abs(F.col("confidence") - F.col("previous_confidence")) >= 5
    return refreshed.join(before, KEY).where(moved)
