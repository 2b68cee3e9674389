"""The source registry and the source adapters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwise.functions.urls import host_label
from offerwise.params import Params

REGISTRY = """
    ordinal INT, name STRING, source_type STRING, urls ARRAY<STRING>,
    page_about_brand BOOLEAN, enabled BOOLEAN
"""

# The known publishers in arrival order, official first.
# ``{b}`` is the brand and ``{cc}`` the country code.
SOURCES = (
    (
        "official",
        "official",
        (
            "https://www.{b}.{cc}/",
            "https://www.{b}.{cc}/coupon-a-1035.html",
            "https://www.{b}.{cc}/promotion",
            "https://www.{b}.{cc}/campaign/new-in",
            "https://{cc}.{b}.com/",
            "https://{cc}.{b}.com/coupon-a-1035.html",
            "https://{cc}.{b}.com/promotion",
        ),
        True,
    ),
    ("searchEngine", "other", (), None),
    ("grabon", "coupon-site", ("https://www.grabon.in/{b}-coupons/",), True),
    (
        "coupondunia",
        "coupon-site",
        ("https://www.coupondunia.in/{b}", "https://www.coupondunia.in/{b}/coupons"),
        True,
    ),
    (
        "cashkaro",
        "coupon-site",
        ("https://cashkaro.com/stores/{b}", "https://cashkaro.com/coupons/{b}"),
        True,
    ),
    (
        "desidime",
        "community",
        (
            "https://www.desidime.com/stores/{b}",
            "https://www.desidime.com/search?utf8=%E2%9C%93&q={b}+coupon",
        ),
        True,
    ),
    ("reddit", "community", (), True),
    ("generic", "other", (), False),
)


def official_hosts(params: Params) -> list[str]:
    """The brand's own hosts in this country; links never leave them."""
    b, cc = params.brand.lower(), params.country_code.lower()
    return [f"{b}.{cc}", f"www.{b}.{cc}", f"{cc}.{b}.com"]


def source_registry(spark: SparkSession, params: Params) -> DataFrame:
    """All known sources; ad-hoc pages from the parameters follow as ``generic``."""
    rows = []
    for ordinal, (name, kind, urls, about) in enumerate(SOURCES):
        filled = [
            u.format(b=params.brand.lower(), cc=params.country_code.lower()) for u in urls
        ]
        if name == "generic":
            filled = list(params.extra_source_urls)
        enabled = name != "generic" or bool(filled)
        rows.append((ordinal, name, kind, filled, about, enabled))
    return spark.createDataFrame(rows, REGISTRY)


def registry_pages(registry: DataFrame) -> DataFrame:
    """One row per page to scan, in order; ad-hoc pages are labelled by their host."""
    c = F.col
    pages = registry.where("enabled").select(
        "ordinal",
        "name",
        "source_type",
        "page_about_brand",
        F.posexplode("urls").alias("page_ord", "url"),
    )
    label = F.when(
        c("name") == "generic", F.concat(F.lit("generic:"), host_label(c("url")))
    ).otherwise(c("name"))
    return pages.withColumn("label", label)


def ad_hoc_registry(pages: DataFrame) -> DataFrame:
    """Registry rows of ad-hoc pages: one per host, brand required in each snippet."""
    host = host_label(F.col("url"))
    return pages.select(
        F.concat(F.lit("generic:"), host).alias("label"),
        F.lit("other").alias("source_type"),
        F.lit(False).alias("page_about_brand"),
        "url",
    )


Adapter = Callable[[SparkSession, Params], DataFrame]


def union_candidates(spark: SparkSession, params: Params, adapters: list[Adapter]) -> DataFrame:
    """All adapters' candidates. An adapter is any function that returns claim rows
    whose ``seq`` starts with its place in the registry."""
    frames = [adapter(spark, params) for adapter in adapters]
    return reduce(lambda a, b: a.unionByName(b), frames)
