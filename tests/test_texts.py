import datetime as dt

import pytest
from conftest import NOW
from pyspark.sql import functions as F

from offerwise.functions import codes, text, urls
from offerwise.functions.expiry import expiry_date
from offerwise.functions.terms import is_empty_offer, parse_terms


def evaluate(spark, values, expr):
    """One column expression over texts, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalise(spark):
    nbsp = " "
    given = ["Rs.800 off", "Rs 800 off", "INR 800 off", "800/- off", f" 80%{nbsp}  off\n\nsale ", "a – b"]
    assert evaluate(spark, given, text.normalise_text) == [
        "₹800 off", "₹800 off", "₹800 off", "800 off", "80% off sale", "a - b",
    ]


def test_amounts(spark):
    given = ["1,000", "999", "12.5", None, "", "abc", "0", "99999999", "-5"]
    assert evaluate(spark, given, text.parse_amount) == [1000, 999, 12.5] + [None] * 6


TERMS = [
    # text, type, value, minimum, cap, hedged
    ("Flat Rs.800 off on orders above Rs.1,000", "flat", 800, 1000, None, False),
    ("Rs.800 off Rs.1,000", "flat", 800, 1000, None, False),
    ("Get Rs.500 off on ACME India", "flat", 500, None, None, False),
    ("Rs.800 off. Minimum Rs.100 cart? no.", "flat", 800, None, None, False),
    ("Rs.300 off, min order value Rs.1499", "flat", 300, 1499, None, False),
    ("Rs.300 off on purchase of Rs.1499", "flat", 300, 1499, None, False),
    ("Rs.300 off on Rs.1499 or more", "flat", 300, 1499, None, False),
    ("Rs.300 off minimum purchase Rs.1499", "flat", 300, 1499, None, False),
    ("UP TO 80% OFF SALE", "sale", 80, None, None, True),
    ("Up to 80% off for new users", "percentage", 80, None, None, True),
    ("70% OFF up to Rs.700, min purchase Rs.999", "percentage", 70, 999, 700, False),
    ("60% off, maximum discount Rs.300 on selected items", "percentage", 60, None, 300, False),
    ("Save up to Rs.800 off your order", "flat", 800, None, 800, True),
    ("Flat 70% off on ACME India, min Rs.999", "percentage", 70, 999, None, False),
    ("Flat Rs.200 cashback on orders above Rs.999", "cashback", 200, 999, None, False),
    ("Take 1,500 off today", "flat", 1500, None, None, False),
    # kept as they are: the first two digits of 120, and nothing for a worded currency
    ("only 120% off", "percentage", 20, None, None, False),
    ("99% off then 50% off", "unknown", None, None, None, False),
    ("Shop the latest styles now", "unknown", None, None, None, False),
]


def test_terms(spark, params):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TERMS)], "i int, t string")
    rows = parse_terms(df, "t", params.now_col()).orderBy("i").collect()
    for row, (given, kind, value, minimum, cap, hedged) in zip(rows, TERMS, strict=True):
        found = (
            row.discount_type, row.discount_value, row.minimum_order,
            row.maximum_discount, row.is_up_to, row.minimum_order_known,
        )
        assert found == (kind, value, minimum, cap, hedged, minimum is not None), given


def test_assumed_coupon_is_no_sale(spark, params):
    df = spark.createDataFrame([("UP TO 80% OFF SALE",)], "t string")
    row = parse_terms(df, "t", params.now_col(), True).first()
    assert (row.discount_type, row.is_up_to) == ("percentage", True)


def test_flags(spark, params):
    given = [
        "New users only: 80% off on your first order, app only, on selected products. Selected users.",
        "Rs.500 off exclusively on the app",
        "Rs.500 off for existing users",
        "Rs.500 off for new users, all users",
        "This coupon has expired",
        "Rs.800 off Rs.1000",
    ]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    rows = parse_terms(df, "t", params.now_col()).orderBy("i").collect()
    first = rows[0]
    assert first.new_users_only and first.first_order_only and first.app_only
    assert first.selected_users_only and first.selected_products_only
    assert rows[1].app_only is True
    assert rows[2].existing_users_allowed is True and rows[2].new_users_only is None
    assert rows[3].existing_users_allowed is None
    assert rows[4].reported_expired is True
    assert rows[5].reported_expired is None
    empty = parse_terms(df, "t", params.now_col()).select(
        is_empty_offer(F.col("discount_type"), F.col("discount_value")).alias("e")
    )
    assert sum(r.e for r in empty.collect()) == 1


@pytest.mark.parametrize(
    "given, day",
    [
        ("Offer valid till 31 August 2026", (2026, 8, 31)),
        ("valid till 31st of August, 2026", (2026, 8, 31)),
        # kept as it is: "Aug 26" is also read as the 26th, which is nearer
        ("valid till 31st of Aug 26", (2026, 8, 26)),
        ("Expires August 31, 2026", (2026, 8, 31)),
        ("Valid until 30/09/2026", (2026, 9, 30)),
        ("ends 31-12-26", (2026, 12, 31)),
        ("valid till 25 Aug", (2026, 8, 25)),
        ("valid till 14 Aug", (2026, 8, 14)),
        ("valid till 1 Aug", (2027, 8, 1)),
        ("valid till 31 Feb 2027", (2027, 3, 3)),
        ("valid 1 Sep 2026 or until 25 Aug 2026", (2026, 8, 25)),
        ("expired 1 May 2026, before 1 June 2026", (2026, 6, 1)),
        ("Published on 1 January 2026", None),
        ("valid till 31 August 1999", None),
        ("ends august 2026", None),
    ],
)
def test_expiry(spark, params, given, day):
    expr = lambda t: expiry_date(text.normalise_text(t), params.now_col())
    expected = dt.datetime(*day, 23, 59, 59) if day else None
    assert evaluate(spark, [given], expr) == [expected]
    assert NOW.year == 2026


def test_codes(spark, params):
    plausible = ["ACME800", "SALE50", "NEW70", "IN800OFF", "acme800"]
    no = ["ACME", "OFFER", "HTTPS", "1000", "800", "AB1", "A" * 30, "ACME 800", "FREESHIP"]
    weak = lambda t: codes.is_plausible_code(t, False, params)
    strong = lambda t: codes.is_plausible_code(t, True, params)
    assert evaluate(spark, plausible + no, weak) == [True] * 5 + [False] * 9
    assert evaluate(spark, ["FREESHIP", "GET-80-OFF-NOW-TODAY"], strong) == [True, False]
    assert evaluate(spark, [" acme800 ", "new 70", "  ", None], codes.normalise_code) == [
        "ACME800", "NEW70", None, None,
    ]


def test_code_from_text(spark, params):
    given = {
        "Use code ACME800 to get Rs.800 off": "ACME800",
        "Coupon code: NEW70": "NEW70",
        "Apply promo code SAVE30 at bag": "SAVE30",
        "code - FIRST500": "FIRST500",
        "use code at checkout to save": None,
        "Use code freeship now": None,
        "Use code Acme800": None,
        "USE CODE ACME800 NOW": "ACME800",
        "Great discounts today": None,
    }
    expr = lambda t: codes.code_from_text(t, params)
    assert evaluate(spark, list(given), expr) == list(given.values())


def test_brand_and_region(spark, params):
    given = ["ACME India coupon", "ACME Rs.800 off", "ACME US coupon $20", "Other India coupon"]
    expr = lambda t: text.brand_and_region(t, params)
    assert evaluate(spark, given, expr) == [True, True, False, False]


def test_domains_and_urls(spark):
    given = ["https://www.a.in/x", "m.a.in", "AMP.A.in", "mobile.a.in", None, "https://a.in"]
    assert evaluate(spark, given, urls.normalise_domain) == ["a.in"] * 4 + ["", "a.in"]
    assert evaluate(spark, ["not a url", "HTTPS://WWW.A.in/"], urls.host_of) == [
        "unknown", "www.a.in",
    ]
    links = ["/p#x", "p", "../q", "?a=1", "//b.in/z", "https://c.in", "#top"]
    resolve = lambda t: urls.resolve_url(t, F.lit("https://a.in/d/e"))
    assert evaluate(spark, links, resolve) == [
        "https://a.in/p#x", "https://a.in/d/p", "https://a.in/q", "https://a.in/d/e?a=1",
        "https://b.in/z", "https://c.in/", "https://a.in/d/e#top",
    ]
    pages = ["https://a.in/checkout", "https://a.in/pay", "https://a.in/payless", "https://a.in/"]
    assert evaluate(spark, pages, urls.is_safe_url) == [False, False, True, True]


def test_times(spark, params):
    df = spark.range(1).select(
        text.ist_label(params.now_col()).alias("label"),
        text.ist_label(F.lit(None).cast("timestamp")).alias("never"),
        text.hours_since(F.lit(None).cast("timestamp"), params.now_col()).alias("age"),
    )
    row = df.first()
    assert (row.label, row.never, row.age) == ("2026-08-19 20:30 IST", "never", float("inf"))
