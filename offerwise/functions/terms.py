"""Promotion text -> typed offer terms, as staged built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.functions.expiry import expiry_matches, nearest_date
from offerwise.functions.text import (
    BOUNDARY,
    RUPEE,
    WORD_END,
    WORD_START,
    normalise_text,
)

# Wording of amounts, minimums, caps and eligibility. All patterns
# run on normalised lower-case text.
_AMT = r"([0-9,]+)"
COMBINED = (
    rf"{RUPEE}\s*{_AMT}\s*(?:off|discount)\s*(?:on|above|over|for|upwards of|"
    rf"orders? (?:of|above|over))?\s*{RUPEE}\s*{_AMT}"
)
ANY_PERCENT = r"[0-9]{1,2}(?:\.[0-9])?\s*%"
UP_TO = rf"{WORD_START}up\s*to\s*(?:flat\s*)?(?:{RUPEE}\s*{_AMT}|([0-9]{{1,2}}(?:\.[0-9])?)\s*%)"
MAXIMUM = (
    rf"{WORD_START}max(?:imum)?\.?\s*(?:discount|cashback|savings?)?\s*(?:of|is|:)?\s*"
    rf"{RUPEE}\s*{_AMT}"
)
PERCENT = r"([0-9]{1,2}(?:\.[0-9])?)\s*%"
FLAT = (
    rf"{RUPEE}\s*{_AMT}\s*(?:off|discount)",
    rf"(?:flat|save|get)\s*{RUPEE}\s*{_AMT}",
    rf"{BOUNDARY}([0-9,]{{3,7}})\s*(?:rupees\s*)?off{WORD_END}",
)
CASHBACK = rf"{WORD_START}cash\s?back{WORD_END}"
SALE = (
    rf"{WORD_START}(?:sale|clearance|end of season|flash sale|mega sale|deals?|storewide|"
    rf"store wide){WORD_END}"
)
MINIMUM = (
    rf"{WORD_START}min(?:imum)?\.?\s*(?:order|purchase|spend|cart|bill|transaction|txn|value|"
    rf"amount|shopping)?\s*(?:value|amount|of|is|:)?\s*{RUPEE}\s*{_AMT}",
    rf"{WORD_START}(?:on|above|over|orders? (?:above|over|of)|purchase of|spend|"
    rf"shopping (?:of|above)|carts? (?:of|above))\s*{RUPEE}\s*{_AMT}",
    rf"{RUPEE}\s*{_AMT}\s*(?:or (?:more|above)|and above|\+)",
)
FLAGS = {
    "new_users_only": (
        "new user|new users|new customer|new customers|new account|new shopper|newcomer|"
        "first[- ]time (?:user|customer|buyer)|first order|first purchase|1st order"
    ),
    "first_order_only": (
        "first order|first purchase|1st order|first time order|on your first"
    ),
    "app_only": (
        "app[- ]only|only on (?:the )?app|app exclusive|exclusively on (?:the )?app|"
        "in[- ]app only|mobile app only|via (?:the )?app|download the app"
    ),
    "selected_users_only": (
        "select(?:ed)? users?|select(?:ed)? customers?|select(?:ed)? accounts?|user[- ]specific|"
        "account[- ]specific|for select members|targeted users?|not for all users"
    ),
    "selected_products_only": (
        "select(?:ed)? (?:products?|items?|styles?|categories|categor(?:y|ies)|brands?|ranges?)|"
        "on select|marked products?|participating (?:products?|items?)|"
        "specific (?:products?|items?|categories)"
    ),
    "existing_users_allowed": (
        "existing users?|existing customers?|old users?|all users?|everyone|repeat customers?"
    ),
    "reported_expired": (
        "expired|no longer (?:working|valid|available)|not working|has expired|offer ended|"
        "coupon (?:is )?dead"
    ),
}

# Fragments of which a text must hold one for the wording above to
# match. Testing them first spares most texts the search; results are the same.
HINTS = {
    "new_users_only": ("new", "first", "1st"),
    "first_order_only": ("first", "1st"),
    "app_only": ("app",),
    "selected_users_only": ("select", "specific", "targeted", "not for all"),
    "selected_products_only": ("select", "marked", "participating", "specific"),
    "existing_users_allowed": ("existing", "old user", "all user", "everyone", "repeat"),
    "reported_expired": ("expired", "no longer", "not working", "ended", "dead"),
}
SALE_HINTS = ("sale", "clearance", "season", "deal", "wide")

TERM_COLUMNS = [
    "discount_type",
    "discount_value",
    "minimum_order",
    "maximum_discount",
    "is_up_to",
    "minimum_order_known",
    *FLAGS,
    "expiry_date",
]


def _holds(low: Column, fragments: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (low.contains(f) for f in fragments))


def eligibility(low: Column) -> dict[str, Column]:
    """The seven flags: true or null, never false."""
    hit = {
        name: _holds(low, HINTS[name]) & low.rlike(f"{WORD_START}(?:{words}){WORD_END}")
        for name, words in FLAGS.items()
    }
    hit["existing_users_allowed"] = hit["existing_users_allowed"] & ~hit["new_users_only"]
    return {name: F.when(cond, F.lit(True)) for name, cond in hit.items()}


def is_empty_offer(discount_type: Column, discount_value: Column) -> Column:
    """Nothing usable was parsed."""
    return (discount_type == "unknown") & discount_value.isNull()


def _money(digits: Column) -> Column:
    """``parse_amount`` for texts already known to be digits and commas."""
    value = F.translate(digits, ",", "").try_cast("double")
    return F.when((value > 0) & (value <= 1_000_000), value)


def _monies(digits: Column) -> Column:
    return F.filter(F.transform(digits, _money), lambda v: v.isNotNull())


def parse_terms(
    df: DataFrame, text: str, now: Column, assume_coupon: Column | bool = False
) -> DataFrame:
    """Append ``TERM_COLUMNS`` parsed from ``text``.

    ``assume_coupon``: the text is known to describe a coupon, so sale wording does
    not turn it into a store-wide sale. The stages are separate projections: texts are
    searched once, behind cheap substring tests, and everything after works on the
    few characters found.
    """
    if isinstance(assume_coupon, bool):
        assume_coupon = F.lit(assume_coupon)
    c = F.col
    kept = [F.col(f"`{n}`") for n in df.columns if n not in TERM_COLUMNS]
    texted = df.select(
        *kept, normalise_text(F.col(text)).alias("_text"), assume_coupon.alias("_coupon")
    ).withColumn("_low", F.lower("_text"))

    low = c("_low")
    rupee, percent = low.contains(RUPEE), low.contains("%")
    off = low.contains("off") | low.contains("discount")
    found = {
        # discount and minimum in one match, parted by a bar
        "_combined": F.when(
            rupee & off,
            F.regexp_replace(
                F.regexp_extract(low, f"({COMBINED})", 1), f"^{COMBINED}$", "$1|$2"
            ),
        ),
        "_any_pct": percent & low.rlike(ANY_PERCENT),
        "_up": F.when(
            low.contains("up") & (rupee | percent),
            F.regexp_extract_all(low, F.lit(UP_TO), F.lit(0)),
        ),
        "_max": F.when(
            low.contains("max") & rupee, F.regexp_extract_all(low, F.lit(MAXIMUM), F.lit(1))
        ),
        "_pct": F.when(percent, F.regexp_extract(low, PERCENT, 1)),
        # the first pattern that matches decides, valid amount or not
        "_flat": F.coalesce(
            F.when(rupee & off, F.nullif(F.regexp_extract(low, FLAT[0], 1), F.lit(""))),
            F.when(rupee, F.nullif(F.regexp_extract(low, FLAT[1], 1), F.lit(""))),
            F.when(low.contains("off"), F.regexp_extract(low, FLAT[2], 1)),
        ),
        "_min1": F.when(rupee & low.contains("min"), F.regexp_extract(low, MINIMUM[0], 1)),
        "_min2": F.when(rupee, F.regexp_extract(low, MINIMUM[1], 1)),
        "_min3": F.when(
            rupee & (low.contains("or ") | low.contains("above") | low.contains("+")),
            F.regexp_extract(low, MINIMUM[2], 1),
        ),
        "_cashback": low.contains("cash") & low.rlike(CASHBACK),
        "_sale": _holds(low, SALE_HINTS) & low.rlike(SALE),
        **eligibility(low),
        "_dates": expiry_matches(low),
    }
    searched = texted.select(
        *kept, "_coupon", *(value.alias(name) for name, value in found.items())
    )

    is_pct = lambda m: m.endswith("%")
    counted = searched.withColumns(
        {
            "_up_pct": F.get(
                F.transform(
                    F.filter("_up", is_pct), lambda m: F.regexp_extract(m, PERCENT + "$", 1)
                ),
                F.lit(0),
            ).try_cast("double"),
            "_up_amt": F.get(
                _monies(
                    F.transform(
                        F.filter("_up", lambda m: ~is_pct(m)),
                        lambda m: F.regexp_extract(m, _AMT + "$", 1),
                    )
                ),
                F.lit(0),
            ),
            "_c1": _money(F.split_part("_combined", F.lit("|"), F.lit(1))),
            "_c2": _money(F.split_part("_combined", F.lit("|"), F.lit(2))),
            "_max": F.array_min(_monies(c("_max"))),
            "_pct": c("_pct").try_cast("double"),
            "_flat": _money(c("_flat")),
            "_min1": _money(c("_min1")),
            "_min2": _money(c("_min2")),
            "_min3": _money(c("_min3")),
            "expiry_date": nearest_date(c("_dates"), now),
        }
    )

    combined = F.coalesce(c("_c2") >= c("_c1"), F.lit(False))
    hedged_pct = c("_up_pct").isNotNull()
    hedged_amt = ~c("_any_pct") & c("_up_amt").isNotNull()
    exact_pct = F.coalesce((c("_pct") > 0) & (c("_pct") <= 95), F.lit(False))
    base_type = (
        F.when(combined, "flat")
        .when(hedged_pct, "percentage")
        .when(hedged_amt, "flat")
        .when(exact_pct, "percentage")
        .when(c("_flat").isNotNull(), "flat")
        .otherwise("unknown")
    )
    value = (
        F.when(combined, c("_c1"))
        .when(hedged_pct, c("_up_pct"))
        .when(hedged_amt, c("_up_amt"))
        .when(exact_pct, c("_pct"))
        .otherwise(c("_flat"))
    )
    is_sale = (
        ~c("_coupon")
        & c("is_up_to")
        & c("_type").isin("percentage", "unknown")
        & c("_sale")
        & ~c("_cashback")
    )
    typed = counted.withColumns(
        {
            "_is_combined": combined,
            "_type": base_type,
            "discount_value": value,
            "maximum_discount": F.least(c("_up_amt"), c("_max")),
            "is_up_to": hedged_pct | hedged_amt,
        }
    ).withColumn(
        "discount_type",
        F.when(c("_cashback"), "cashback").when(is_sale, "sale").otherwise(c("_type")),
    )

    # a minimum below a flat value is a misparse, so the next wording is tried
    def fits(amount: Column) -> Column:
        too_small = (c("discount_type") == "flat") & (amount < c("discount_value"))
        return F.when(amount.isNotNull() & ~F.coalesce(too_small, F.lit(False)), amount)

    return (
        typed.withColumn(
            "minimum_order",
            F.when(c("_is_combined"), c("_c2")).otherwise(
                F.coalesce(fits(c("_min1")), fits(c("_min2")), fits(c("_min3")))
            ),
        )
        .withColumn("minimum_order_known", c("minimum_order").isNotNull())
        .select(*kept, *TERM_COLUMNS)
    )
