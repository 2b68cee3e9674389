"""Promotion links of official pages and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerwise.functions.urls import is_safe_url, resolve_url
from offerwise.params import Params
from offerwise.sources.html import anchors

# Wording of promotion links, and listing pages that only look alike.
PROMO_HINT = "(?i)coupon|promo|voucher|new[-_ ]?user|first[-_ ]?order|campaign"
NOT_PROMO = (
    "(?i)-sc-|-p-|/hotsale/|/recommend/|/sale/|/daily-new|/goods|[?&](ici|adp|src_identifier)="
)


def promo_links(
    pages: DataFrame,
    hosts: list[str] | None,
    hint: str = PROMO_HINT,
    schemes: tuple[str, ...] = ("https",),
) -> DataFrame:
    """Distinct promotion links per page, in document order, on the allowed hosts.

    ``hosts`` None: the page's own host. The parts of a URL are taken by pattern, since
    links in the wild hold characters that strict URL parsing refuses.
    """
    c = F.col
    hinted = anchors(pages).where(c("href").rlike(hint) | F.trim("text").rlike(hint))
    resolved = hinted.withColumn("absolute", resolve_url(c("href"), c("url")))
    host_pattern = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
    host = F.lower(F.regexp_extract("absolute", host_pattern, 1))
    own = F.lower(F.regexp_extract("url", host_pattern, 1))
    scheme = F.lower(F.regexp_extract("absolute", "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    target = F.regexp_extract("absolute", "^[^/]*//[^/?#]*([^#]*)", 1)
    on_host = (host == own) if hosts is None else host.isin(*hosts)
    kept = resolved.where(
        scheme.isin(*schemes) & on_host & ~target.rlike(NOT_PROMO)
    ).withColumn("link", F.regexp_replace("absolute", "#.*$", ""))
    return kept.groupBy("page_id", "page_ord", "source_name", "link").agg(
        F.min("pos").alias("pos")
    )


def frontier_step(links: DataFrame, visited: DataFrame, params: Params) -> DataFrame:
    """The next URLs to open: unseen links in discovery order, a few per run."""
    c = F.col
    fresh = (
        links.where(is_safe_url(c("link")))
        .groupBy(c("link").alias("url"))
        .agg(F.min(F.struct("page_ord", "pos")).alias("found"))
        .join(visited.select("url"), "url", "left_anti")
    )
    return fresh.orderBy("found", "url").limit(params.max_discovered_links)


def frontier_by_source(links: DataFrame, visited: DataFrame, params: Params) -> DataFrame:
    """As ``frontier_step`` for many crawls at once: the limit holds per source."""
    c = F.col
    fresh = (
        links.where(is_safe_url(c("link")))
        .groupBy(c("source_name").alias("source"), c("link").alias("url"))
        .agg(F.min(F.struct("page_ord", "pos")).alias("found"))
        .join(visited.select("url"), "url", "left_anti")
    )
    rank = F.row_number().over(Window.partitionBy("source").orderBy("found", "url"))
    return fresh.withColumn("place", rank).where(c("place") <= params.max_discovered_links)
