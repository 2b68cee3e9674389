"""What a shopper would pay: discount on a cart value, doubts, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerwise.functions.text import RUPEE, number_text
from offerwise.params import Params


def round2(value: Column) -> Column:
    """Half-up at two decimals in double arithmetic."""
    return F.floor(value * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def _refusal(cart: Column) -> Column:
    """Why no discount can be promised; null when one can."""
    c = F.col
    below = c("minimum_order_known") & (cart < c("minimum_order"))
    return (
        F.when(~(cart > 0), F.lit("cart value must be positive"))
        .when(
            below,
            F.concat(
                F.lit("cart below published minimum order of "), number_text(c("minimum_order"))
            ),
        )
        .when(
            c("is_up_to"),
            F.lit('advertised as "up to" - no guaranteed discount for a specific cart'),
        )
        .when(
            (c("discount_type") == "flat") & c("discount_value").isNull(),
            F.lit("flat discount value unknown"),
        )
        .when(
            (c("discount_type") == "percentage") & c("discount_value").isNull(),
            F.lit("percentage value unknown"),
        )
        .when(
            c("discount_type") == "sale",
            F.lit("store-wide sale, not a cart-level coupon discount"),
        )
        .when(
            c("discount_type") == "cashback",
            F.lit("cashback is paid after purchase and does not reduce the amount payable"),
        )
        .when(
            ~F.coalesce(c("discount_type"), F.lit("unknown")).isin("flat", "percentage"),
            F.lit("offer terms could not be parsed"),
        )
    )


def _discount(cart: Column) -> Column:
    """Discount before rounding, 0 when refused; capped and never above the cart."""
    c = F.col
    applies = (
        (cart > 0)
        & ~F.coalesce(c("minimum_order_known") & (cart < c("minimum_order")), F.lit(False))
        & ~c("is_up_to")
    )
    raw = F.when(c("discount_type") == "flat", c("discount_value")).when(
        c("discount_type") == "percentage", cart * c("discount_value") / F.lit(100.0)
    )
    capped = F.greatest(F.lit(0.0), F.least(raw, c("maximum_discount"), cart))
    return F.coalesce(F.when(applies & raw.isNotNull(), capped), F.lit(0.0))


def breakdown(cart: Column) -> Column:
    """Struct for one cart value, read off the offer's term columns."""
    discount = _discount(cart)
    return F.struct(
        cart.alias("cart_value"),
        round2(discount).alias("discount"),
        round2(cart - discount).alias("final_price"),
        F.when(cart > 0, round2(discount / cart)).otherwise(F.lit(0.0)).alias("effective_discount"),
        (discount > 0).alias("applicable"),
        _refusal(cart).alias("reason"),
    )


def ladder(params: Params) -> Column:
    """One breakdown per cart value, ascending."""
    return F.array(*(breakdown(F.lit(v)) for v in params.full_ladder))


def uncertainty_reason() -> Column:
    """First reason the numbers cannot be fully trusted; null when they can."""
    c = F.col
    return (
        F.when(c("is_up_to"), F.lit('advertised as "up to" - guaranteed value unknown'))
        .when(c("discount_type") == "sale", F.lit("store-wide sale rather than a cart coupon"))
        .when(c("discount_type") == "unknown", F.lit("offer terms could not be parsed"))
        .when(c("discount_type") == "cashback", F.lit("cashback, not a checkout discount"))
        .when(c("discount_value").isNull(), F.lit("discount value not published"))
        .when(
            ~c("minimum_order_known"),
            F.lit("minimum order not published - applicability assumed"),
        )
        .when(
            (c("discount_type") == "percentage") & c("maximum_discount").isNull(),
            F.lit("percentage offer without a published cap"),
        )
    )


def format_amount(value: Column) -> Column:
    """Indian digit grouping (12,34,567); two decimals only when fractional."""
    whole = value == F.floor(value)
    digits = F.regexp_replace(
        F.floor(value).cast("string"), r"(?<=\d)(?=(\d\d)+\d$)", ","
    )
    return F.when(whole, digits).when(value.isNotNull(), F.format_string("%.2f", value))


def format_rupees(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(RUPEE), format_amount(value)), F.lit("-"))


def _trim_number(value: Column) -> Column:
    return F.when(value == F.floor(value), F.floor(value).cast("string")).when(
        value.isNotNull(), F.format_string("%.1f", value)
    )


def offer_label() -> Column:
    """``₹800 OFF``, ``UP TO 80% SALE``, ... from the term columns."""
    c = F.col
    value = c("discount_value")
    prefix = F.when(c("is_up_to"), F.lit("UP TO ")).otherwise(F.lit(""))
    money = F.concat(prefix, F.lit(RUPEE), format_amount(value))
    percent = F.concat(prefix, _trim_number(value))
    kind = c("discount_type")
    return (
        F.when(
            kind == "flat",
            F.coalesce(F.concat(money, F.lit(" OFF")), F.lit("FLAT OFF (value unknown)")),
        )
        .when(
            kind == "percentage",
            F.coalesce(F.concat(percent, F.lit("% OFF")), F.lit("PERCENT OFF (value unknown)")),
        )
        .when(kind == "sale", F.coalesce(F.concat(percent, F.lit("% SALE")), F.lit("SALE")))
        .when(
            kind == "cashback",
            F.coalesce(F.concat(money, F.lit(" CASHBACK")), F.lit("CASHBACK")),
        )
        .otherwise(F.lit("UNKNOWN OFFER"))
    )


def describe_discount() -> Column:
    """Wording of the discount for reports."""
    c = F.col
    prefix = F.when(c("is_up_to"), F.lit("up to ")).otherwise(F.lit(""))
    text = F.when(
        c("discount_type").isin("percentage", "sale"),
        F.concat(prefix, number_text(c("discount_value")), F.lit("%")),
    ).otherwise(F.concat(prefix, format_rupees(c("discount_value"))))
    return F.when(c("discount_value").isNull(), offer_label()).otherwise(text)


def yes_no(flag: Column) -> Column:
    return F.when(flag, "YES").when(~flag, "NO").otherwise("UNKNOWN")
