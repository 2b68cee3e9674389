"""Search listings: hits of several engines, scored result pages, candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.functions.text import RUPEE, WORD_END, WORD_START, mentions_brand
from offerwise.functions.urls import unwrap_redirect
from offerwise.params import Params
from offerwise.sources.candidates import with_source
from offerwise.sources.html import results
from offerwise.sources.plaintext import text_candidates

# The two JSON payload shapes.
BRAVE = "web struct<results:array<struct<title:string,url:string,description:string>>>"
SERPAPI = "organic_results array<struct<title:string,link:string,snippet:string>>"
# Wording and hosts that make a result page promising.
OFFER_WORD = "coupon|promo ?code|offer"
SOCIAL_HOST = r"pinterest|facebook|instagram|youtube|twitter|x\.com"


def _hits(payloads: DataFrame, engine: str, items: Column, link: str, snippet: str) -> DataFrame:
    c = F.col
    rows = payloads.where(c("engine") == engine).select(
        "payload_id", "engine", F.posexplode(items).alias("pos", "hit")
    )
    return rows.where(F.coalesce(c("hit")[link], F.lit("")) != "").select(
        "payload_id",
        "pos",
        "engine",
        F.coalesce(c("hit")["title"], F.lit("")).alias("title"),
        c("hit")[link].alias("url"),
        F.coalesce(c("hit")[snippet], F.lit("")).alias("snippet"),
    )


def api_hits(payloads: DataFrame) -> DataFrame:
    """Hits of ``payloads(payload_id, engine, json)`` of the two documented APIs."""
    brave = F.from_json("json", BRAVE)["web"]["results"]
    serpapi = F.from_json("json", SERPAPI)["organic_results"]
    return _hits(payloads, "brave", brave, "url", "description").unionByName(
        _hits(payloads, "serpapi", serpapi, "link", "snippet")
    )


def html_hits(pages: DataFrame) -> DataFrame:
    """Hits of HTML result pages, outbound redirects unwrapped."""
    return results(pages).select(
        F.col("page_id").alias("payload_id"),
        "pos",
        F.lit("duckduckgo").alias("engine"),
        "title",
        unwrap_redirect(F.col("href")).alias("url"),
        "snippet",
    )


def hit_score(params: Params) -> Column:
    """How promising a result page is."""
    c = F.col
    brand = re.escape(params.brand.lower())
    cc = re.escape(params.country_code.lower())
    low = F.lower(F.concat_ws(" ", "title", "snippet", "url"))
    rules = [
        (low.contains(params.brand.lower()), 3),
        (low.rlike(OFFER_WORD), 2),
        (low.rlike(f"{RUPEE}|{WORD_START}rs{WORD_END}|{params.currency.lower()}"), 1),
        (low.rlike(rf"{params.country.lower()}|\.{cc}{WORD_END}"), 1),
        (c("url").rlike(rf"{brand}\.({cc}|com)"), 3),
        (c("url").rlike(SOCIAL_HOST), -3),
    ]
    score = F.lit(0)
    for cond, points in rules:
        score = score + F.when(cond, points).otherwise(0)
    return score


def rank_hits(hits: DataFrame, params: Params, order: str = "seq") -> DataFrame:
    """The most promising distinct result pages to open.

    The first hit of a URL counts; repeats are dropped by a map-side combined minimum.
    """
    c = F.col
    fields = [f for f in hits.columns if f not in ("url", order)]
    first = F.min_by(F.struct(*fields), c(order))
    distinct = (
        hits.where(c("url").rlike("(?i)^https?://"))
        .groupBy("url")
        .agg(first.alias("_first"), F.min(order).alias(order))
        .select("url", order, "_first.*")
    )
    return (
        distinct.withColumn("score", hit_score(params))
        .where(c("score") > 0)
        .orderBy(c("score").desc(), c(order).asc())
        .limit(params.search_pages_to_open)
    )


def hit_candidates(hits: DataFrame, params: Params) -> DataFrame:
    """Candidates straight from titles and snippets."""
    c = F.col
    text = F.concat("title", F.lit(". "), "snippet")
    docs = hits.withColumn("text", text).withColumn(
        "about_brand", mentions_brand(text, params) | mentions_brand(c("url"), params)
    )
    keys = ("payload_id", "engine", "hit_ord", "url")
    found = text_candidates(docs.withColumnRenamed("pos", "hit_ord"), params, keys=keys)
    return with_source(
        found, params, F.concat(F.lit("search:"), c("engine")), c("url"), F.lit("other")
    )
