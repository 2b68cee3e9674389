"""Text helpers: normalising, brand relevance, titles, labels of time and age."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerwise.params import Params

RUPEE = "₹"

# The whitespace set and word boundary the rules are written for.
# Java's \s misses Unicode spaces and its \b is Unicode-aware, so both are spelled out.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# a run of whitespace that is not already one plain blank
_LOOSE_SPACE = SPACE.replace(" ", "", 1) + SPACE + "*| " + SPACE + "+"
WORD_START = "(?<![A-Za-z0-9_])"
WORD_END = "(?![A-Za-z0-9_])"
BOUNDARY = (
    "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
)

MIN_OFFER_TEXT = 12
MAX_OFFER_TEXT = 600


def squeeze(text: Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(text, _LOOSE_SPACE, " "))


def normalise_text(text: Column) -> Column:
    """One spelling for quotes, dashes, rupee amounts and whitespace."""
    text = F.translate(text, "\u00a0\u2018\u2019\u201c\u201d\u2013\u2014", " ''''--")
    for spelling in (r"rs\.?", "inr", "rupees?"):
        text = F.regexp_replace(text, f"(?i){WORD_START}{spelling}{SPACE}?", RUPEE)
    return squeeze(F.regexp_replace(text, rf"([0-9]){SPACE}*/-", "$1"))


def parse_amount(raw: Column) -> Column:
    """``1,499`` -> 1499.0; null unless a plain number in (0, 1,000,000]."""
    plain = F.trim(F.regexp_replace(raw, ",", ""))
    value = F.when(plain.rlike(r"^[0-9]+(\.[0-9]+)?$"), plain).try_cast("double")
    return F.when((value > 0) & (value <= 1_000_000), value)


def mentions_brand(text: Column, params: Params) -> Column:
    """The brand name occurs anywhere (any case)."""
    return F.coalesce(F.lower(text).contains(params.brand.lower()), F.lit(False))


def brand_and_region(text: Column, params: Params) -> Column:
    """The text names the brand as a word and shows a sign of the country."""
    low = F.lower(text)
    brand, country = re.escape(params.brand.lower()), re.escape(params.country.lower())
    cc = re.escape(params.country_code.lower())
    money = re.escape(params.currency.lower())
    region = "|".join(
        [
            f"{WORD_START}{country}n?{WORD_END}",
            f"{WORD_START}{cc}{WORD_END}{SPACE}*store",
            rf"{brand}\.{cc}",
            RUPEE,
            f"{WORD_START}rs{WORD_END}",
            f"{WORD_START}{money}{WORD_END}",
        ]
    )
    return low.rlike(f"{WORD_START}{brand}{WORD_END}") & low.rlike(region)


def title_of(text: Column) -> Column:
    """At most 120 characters; longer text is cut to 117 and dotted."""
    return F.when(F.length(text) <= 120, text).otherwise(
        F.concat(F.substring(text, 1, 117), F.lit("..."))
    )


def number_text(value: Column) -> Column:
    """Shortest decimal text: ``800.0`` reads ``800``, ``12.5`` stays."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def iso_ms(ts: Column) -> Column:
    """ISO-8601 text in UTC with milliseconds (the session runs in UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ist_label(ts: Column) -> Column:
    """``2026-08-19 20:30 IST`` (fixed offset of 330 minutes), ``never`` for null."""
    shifted = ts + F.expr("INTERVAL 330 MINUTES")
    text = F.concat(F.date_format(shifted, "yyyy-MM-dd HH:mm"), F.lit(" IST"))
    return F.coalesce(text, F.lit("never"))


def hours_since(ts: Column, now: Column) -> Column:
    """Hours from ``ts`` to ``now``; infinitely old when there is no ``ts``."""
    hours = (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(3.6e9)
    return F.coalesce(hours, F.lit(float("inf")))


def days_since(ts: Column, now: Column) -> Column:
    days = (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86.4e9)
    return F.coalesce(days, F.lit(float("inf")))
