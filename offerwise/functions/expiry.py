"""Expiry dates named in promotion text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerwise.functions.text import BOUNDARY, WORD_START

# Expiry wording, month spellings and the three date shapes.
TRIGGER = "valid|expires?|expiry|expiring|ends?|ending|till|until|last date|offer ends"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = f"({'|'.join(MONTHS)})[a-z]*"
DAY_FIRST = rf"{WORD_START}([0-9]{{1,2}})(?:st|nd|rd|th)?\s*(?:of\s*)?{_MONTH},?\s*([0-9]{{2,4}})?"
MONTH_FIRST = (
    rf"{WORD_START}{_MONTH}\s+([0-9]{{1,2}})(?![0-9])(?:st|nd|rd|th)?,?\s*([0-9]{{2,4}})?"
)
NUMERIC = rf"{WORD_START}([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]([0-9]{{2,4}}){BOUNDARY}"



# fragments of which a text must hold one for the wording to match
_TRIGGER_HINTS = ("valid", "expir", "end", "till", "until", "last date")


def expiry_matches(low: Column) -> Column:
    """Dates printed in a normalised lower-case text with expiry wording.

    An array of matched texts; null when there is no such wording.
    """
    hinted = reduce(lambda a, b: a | b, (low.contains(h) for h in _TRIGGER_HINTS))
    shapes = (DAY_FIRST, MONTH_FIRST, NUMERIC)
    found = F.concat(*(F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in shapes))
    return F.when(hinted & low.rlike("[0-9]") & low.rlike(TRIGGER), found)


def _end_of_day(year: Column, month: Column, day: Column) -> Column:
    """23:59:59 of that day; days past the month's end roll over."""
    ok = year.between(1900, 2200) & month.between(1, 12) & day.between(1, 31)
    first = F.make_date(F.when(ok, year), F.when(ok, month), F.lit(1))
    midnight = F.date_add(first, (day - 1).cast("int")).cast("timestamp")
    return midnight + F.expr("INTERVAL 86399 SECONDS")


def _parts(match: Column) -> Column:
    """struct(day, month, year) of one matched text; year null when not printed."""
    number = r"[0-9]+"
    numbers = F.regexp_extract_all(match, F.lit(number), F.lit(0))
    name = F.regexp_extract(match, "(" + "|".join(MONTHS) + ")", 1)
    named = name != ""
    month_at = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    at = lambda i: F.get(numbers, F.lit(i))
    year = F.when(named, at(1)).otherwise(at(2))
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.struct(
        at(0).try_cast("int").alias("day"),
        F.when(named, month_at).otherwise(at(1).try_cast("int")).cast("int").alias("month"),
        full.try_cast("int").alias("year"),
    )


def _resolve(parts: Column, now: Column) -> Column:
    """The date; without a year this year's, or next year's when over 7 days past."""
    this_year = _end_of_day(F.year(now), parts["month"], parts["day"])
    recent = this_year >= now - F.expr("INTERVAL 7 DAYS")
    next_year = _end_of_day(F.year(now) + 1, parts["month"], parts["day"])
    return F.when(
        parts["year"].isNotNull(), _end_of_day(parts["year"], parts["month"], parts["day"])
    ).otherwise(F.when(recent, this_year).otherwise(next_year))


def nearest_date(matches: Column, now: Column) -> Column:
    """Nearest plausible future date, else the latest plausible past one."""
    dates = F.transform(F.transform(matches, _parts), lambda p: _resolve(p, now))
    plausible = F.filter(
        dates,
        lambda d: (d > now - F.expr("INTERVAL 730 DAYS")) & (d < now + F.expr("INTERVAL 1095 DAYS")),
    )
    # smallest first: future dates by distance, then past dates by distance
    ranked = F.transform(
        plausible,
        lambda d: F.struct(
            (d < now).alias("past"),
            F.abs(F.unix_micros(d) - F.unix_micros(now)).alias("away"),
            d.alias("date"),
        ),
    )
    return F.when(F.size(matches) > 0, F.array_min(ranked)["date"])


def expiry_date(normalised: Column, now: Column) -> Column:
    """The expiry date a normalised text names, null without expiry wording."""
    return nearest_date(expiry_matches(F.lower(normalised)), now)
