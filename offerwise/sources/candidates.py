"""What every source shares: keeping texts that are offers, and claim rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.functions.terms import is_empty_offer, parse_terms
from offerwise.functions.text import title_of
from offerwise.functions.urls import host_of
from offerwise.params import Params


def offers_only(df: DataFrame, params: Params) -> DataFrame:
    """Parse ``raw_text``; keep rows with a ``code`` or usable terms.

    A plain filter would be moved below the parsing with all of it written out in the
    condition, so every text would be searched many times over; an exploded list of the
    row, empty where it is no offer, is read after the parsing.
    """
    parsed = parse_terms(df, "raw_text", params.now_col(), F.col("code").isNotNull())
    row = F.array(F.struct(*(F.col(f"`{n}`") for n in parsed.columns)))
    offers = F.filter(
        row,
        lambda o: o["code"].isNotNull() | ~is_empty_offer(o["discount_type"], o["discount_value"]),
    )
    kept = parsed.select(F.explode(offers).alias("_offer")).select("_offer.*")
    return kept.withColumn("title", title_of(F.col("raw_text")))


def arrival(ordinal: Column, page_ord: Column, pos: Column) -> Column:
    """Arrival order inside a cycle as one BIGINT: source, page, position.

    7 bits of source ordinal, 32 of page, 24 of position.
    """
    return (
        F.shiftleft(ordinal.cast("bigint"), 56)
        + F.shiftleft(page_ord.cast("bigint"), 24)
        + pos.cast("bigint")
    )


def with_source(
    df: DataFrame,
    params: Params,
    name: Column,
    url: Column,
    kind: Column,
    discovered_at: Column | None = None,
) -> DataFrame:
    """Append the publication a candidate was read from."""
    now = params.now_col()
    return df.withColumns(
        {
            "source_name": name,
            "source_url": url,
            "source_type": kind,
            "source_domain": host_of(url),
            "discovered_at": now if discovered_at is None else discovered_at,
            "last_seen_at": now,
            "snippet": F.col("raw_text"),
        }
    )
