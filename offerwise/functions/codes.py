"""Coupon codes: normalising, plausibility, and codes named in a phrase."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerwise.functions.text import BOUNDARY, SPACE
from offerwise.params import Params

# Words that look like codes but never are. The brand and the
# country are added from the parameters.
NEVER_CODES = (
    "OFFER OFFERS COUPON COUPONS CODE CODES PROMO DEAL DEALS SALE SALES DISCOUNT DISCOUNTS "
    "VOUCHER CASHBACK FREE SHIPPING DELIVERY NEW USER USERS FIRST ORDER ORDERS TODAY VERIFIED "
    "WORKING EXCLUSIVE LIMITED TERMS CONDITIONS COPY COPIED SHOW SHOP NOW CLICK HERE GET SAVE "
    "MORE HTTP HTTPS WWW COM HTML JSON NULL TRUE FALSE UNDEFINED AND THE FOR ALL ONLY MIN MAX "
    "UPTO FLAT OFF APP ANDROID IOS AMAZON FLIPKART MYNTRA AJIO GRABON COUPONDUNIA CASHKARO "
    "DESIDIME REDDIT FASHION WOMEN MEN KIDS HOME CURATED TRENDING POPULAR EXPIRED ACTIVE VALID "
    "INVALID"
).split()

# The phrases that name a code, tried in this order.
_CODE = r"([A-Za-z0-9][A-Za-z0-9_-]{3,23})" + BOUNDARY
_MARKS = "[:\\-–\"'“]*"
CODE_PHRASES = (
    rf"(?i)(?:use|apply|enter|with){SPACE}+(?:the{SPACE}+)?(?:coupon|promo|discount|voucher)?"
    rf"{SPACE}*code{SPACE}*{_MARKS}{SPACE}*{_CODE}",
    rf"(?i)(?:coupon|promo|discount|voucher){SPACE}*code{SPACE}*{_MARKS}{SPACE}*{_CODE}",
    rf"(?i)(?<![A-Za-z0-9_])code{SPACE}*[:\-–]{SPACE}*{_CODE}",
)


def normalise_code(code: Column) -> Column:
    """Upper case without any whitespace; null when nothing is left."""
    # nullif by pattern: one reference to the text instead of two
    plain = F.regexp_replace(F.upper(code), SPACE + "+", "")
    return F.get(F.regexp_extract_all(plain, F.lit("^.+$"), F.lit(0)), F.lit(0))


def is_plausible_code(token: Column, strong: bool, params: Params) -> Column:
    """Shape test for a code. ``strong``: an explicit phrase or attribute named it,
    so a digit is not required."""
    code = F.upper(F.regexp_replace(token, f"^{SPACE}+|{SPACE}+$", ""))
    blocked = sorted({*NEVER_CODES, params.brand.upper(), params.country.upper()})
    ok = (
        code.rlike("^[A-Z0-9][A-Z0-9_-]{3,23}$")
        & code.rlike("[A-Z]")
        & ~code.isin(blocked)
        & (F.size(F.split(code, "[-_]", -1)) <= 4)
    )
    if not strong:
        ok = ok & code.rlike("[0-9]")
    return F.coalesce(ok, F.lit(False))


def code_from_text(text: Column, params: Params) -> Column:
    """The code named by the first phrase that yields an upper-case plausible token."""
    letters = lambda t: F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    capitals = lambda t: F.length(F.regexp_replace(t, "[^A-Z]", ""))

    def is_code(token: Column) -> Column:
        shouted = (letters(token) == 0) | (capitals(token) >= letters(token) * F.lit(0.6))
        return (token != "") & shouted & is_plausible_code(token, True, params)

    tokens = F.array(*(F.regexp_extract(text, pattern, 1) for pattern in CODE_PHRASES))
    # a cheap test spares most texts the three searches
    return F.when(
        F.lower(text).contains("code"), F.upper(F.get(F.filter(tokens, is_code), F.lit(0)))
    )
