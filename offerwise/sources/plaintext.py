"""Plain text -> sentence chunks -> candidates (snippets, posts, bare pages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.functions.codes import code_from_text
from offerwise.functions.text import (
    MAX_OFFER_TEXT,
    MIN_OFFER_TEXT,
    mentions_brand,
    normalise_text,
)
from offerwise.operators.dedupe import text_key
from offerwise.params import Params
from offerwise.sources.candidates import offers_only

# Fixed value: sentence ends and separators.
SPLIT = r"(?<=[.!?\n])\s+|\s{2,}|\||•"


def chunks(text: Column) -> Column:
    """The sentence-like chunks of 12 to 600 characters."""
    parts = F.transform(F.split(normalise_text(text), SPLIT, -1), F.trim)
    return F.filter(parts, lambda p: F.length(p).between(MIN_OFFER_TEXT, MAX_OFFER_TEXT))


def text_candidates(
    docs: DataFrame, params: Params, text: str = "text", keys: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Candidates of documents ``(keys, text, about_brand)``, first occurrence per key.

    Chunks stay with their document until parsed; the dedupe is a map-side combined
    aggregation.
    """
    c = F.col
    split = docs.select(*keys, "about_brand", F.posexplode(chunks(c(text))).alias("pos", "raw_text"))
    named = (
        split.where(c("about_brand") | mentions_brand(c("raw_text"), params))
        .withColumn("code", code_from_text(c("raw_text"), params))
        .drop("about_brand")
    )
    offers = offers_only(named, params).withColumn(
        "_key", text_key(chars=params.text_key_chars)
    )
    fields = [f for f in offers.columns if f not in (*keys, "_key")]
    first = F.min_by(F.struct(*fields), c("pos"))
    return (
        offers.groupBy(*keys, "_key").agg(first.alias("_first")).select(*keys, "_first.*")
    )
