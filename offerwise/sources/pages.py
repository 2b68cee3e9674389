"""Fetched pages: registry join, choice of copy, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.functions.codes import code_from_text, is_plausible_code, normalise_code
from offerwise.functions.messages import challenge_reason
from offerwise.functions.text import (
    MAX_OFFER_TEXT,
    MIN_OFFER_TEXT,
    RUPEE,
    mentions_brand,
    normalise_text,
)
from offerwise.operators.dedupe import page_dedupe
from offerwise.params import Params
from offerwise.schemas import names
from offerwise.session import staged
from offerwise.sources.candidates import offers_only
from offerwise.sources.html import PAGE, raw_parts
from offerwise.sources.jsonld import published_date
from offerwise.sources.plaintext import text_candidates

PAGE_COLUMNS = names(PAGE)
OFFER_HINT = rf"(?i)coupon|discount|% off|{RUPEE}"


def about_brand(params: Params) -> Column:
    """The page's own flag, else its title or URL names the brand."""
    c = F.col
    told = mentions_brand(c("title"), params) | mentions_brand(c("url"), params)
    return F.coalesce(c("page_about_brand"), told)


def _first_plausible(values: str, strong: bool, params: Params) -> Column:
    fitting = F.filter(F.col(values), lambda v: is_plausible_code(v, strong, params))
    return normalise_code(F.get(fitting, F.lit(0)))


def structured_candidates(parts: DataFrame, params: Params) -> DataFrame:
    """JSON-LD nodes and offer containers -> candidates, parsed in one projection.

    The code of a container: own attributes, nested attributes, a phrase in the text, a
    code-like chip; the first that is plausible. A JSON-LD node names its code and may
    publish an end date, which overrides a parsed one.
    """
    c = F.col
    is_node = c("kind") == "node"
    short_chips = F.filter(
        F.transform("chips", normalise_text), lambda t: (t != "") & (F.length(t) <= 24)
    )
    normal = normalise_text(c("text"))
    texts = parts.where(c("kind").isin("node", "jsonld")).withColumns(
        {
            "raw_text": normal,
            "chips": F.when(is_node, short_chips),
        }
    )
    of_offer_size = F.length("raw_text").between(MIN_OFFER_TEXT, MAX_OFFER_TEXT)
    found_in_node = F.coalesce(
        _first_plausible("own_codes", True, params),
        _first_plausible("nested_codes", True, params),
        code_from_text(c("raw_text"), params),
        _first_plausible("chips", False, params),
    )
    published = F.when(is_plausible_code(c("code"), True, params), normalise_code(c("code")))
    named = texts.where(
        (~is_node | of_offer_size) & (about_brand(params) | mentions_brand(c("raw_text"), params))
    ).select(
        *PAGE_COLUMNS,
        "pos",
        "raw_text",
        F.when(is_node, found_in_node).otherwise(published).alias("code"),
        "valid_through",
    )
    offers = offers_only(named, params)
    return offers.withColumns(
        {
            "expiry_date": F.coalesce(
                F.when(c("valid_through").isNotNull(), published_date(c("valid_through"))),
                c("expiry_date"),
            ),
            "raw_text": F.when(c("raw_text") != "", c("raw_text")).otherwise(
                F.concat(F.lit("coupon "), c("code"))
            ),
        }
    ).drop("valid_through")


def page_candidates(pages: DataFrame, params: Params) -> DataFrame:
    """All candidates of ``pages(PAGE columns, html)``, deduplicated per page.

    Pages are tokenised once and offers parsed once; both results are materialised,
    because the dedupe and the search for bare pages read them again.
    """
    c = F.col
    page = ["page_id", "via"]
    parts = staged(raw_parts(pages))
    found = staged(structured_candidates(parts, params))
    # pages without any structured candidate are read as text
    body = parts.where(c("kind") == "body").withColumn("text", normalise_text(c("text")))
    bare = body.where(about_brand(params) | mentions_brand(c("text"), params)).join(
        found.select(*page).distinct(), page, "left_anti"
    )
    bare = bare.withColumn("about_brand", F.coalesce(c("page_about_brand"), F.lit(False)))
    loose = text_candidates(bare, params, keys=tuple(PAGE_COLUMNS))
    structured = page_dedupe(found, params, page)
    return structured.unionByName(loose.select(*structured.columns))


def pick_rendered(candidates: DataFrame) -> DataFrame:
    """Per page the candidates of the direct copy, else those of the rendered one."""
    c = F.col
    direct = F.max(c("via") == "http")
    chosen = candidates.groupBy("page_id").agg(direct.alias("_direct"))
    return (
        candidates.join(chosen, "page_id")
        .where(F.when(c("_direct"), c("via") == "http").otherwise(c("via") == "chromium"))
        .drop("_direct")
    )


def pick_copy(fetched: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """One copy per URL, or per ``keys`` where pages may share one: the direct one if it
    hints at offers, else the rendered one, else the direct one."""
    c = F.col
    direct, rendered = c("via") == "http", c("via") == "chromium"
    rank = (
        F.when(direct & c("html").rlike(OFFER_HINT), 0)
        .when(rendered & c("html").isNotNull(), 1)
        .when(direct, 2)
    )
    fields = [f for f in fetched.columns if f not in keys]
    best = F.min_by(F.struct(*fields), rank)
    return fetched.groupBy(*keys).agg(best.alias("_copy")).select(*keys, "_copy.*")


def readable(fetched: DataFrame) -> DataFrame:
    """Fetched pages that are no challenge or block pages."""
    return fetched.where(challenge_reason(F.col("html"), F.col("status")).isNull())


def scan_pages(pages: DataFrame, registry_pages: DataFrame) -> DataFrame:
    """Pages of registered sources with the source's settings.

    ``registry_pages`` is configuration, one row per page to scan; Spark broadcasts it
    when its size allows and shuffles by URL otherwise.
    """
    return pages.join(registry_pages, "url")
