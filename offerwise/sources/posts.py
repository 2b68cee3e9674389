"""Community posts: nested listings -> candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwise.functions.text import mentions_brand
from offerwise.params import Params
from offerwise.sources.candidates import with_source
from offerwise.sources.plaintext import text_candidates

POST = """struct<title:string,selftext:string,permalink:string,subreddit:string,
created_utc:double,url:string>"""
LISTING = f"data struct<children:array<struct<data:{POST}>>>".replace("\n", "")
SITE = "https://www.reddit.com"


def posts(payloads: DataFrame, params: Params) -> DataFrame:
    """One row per post that names the brand: text, link, label and time."""
    c = F.col
    listing = F.from_json("json", LISTING)
    child = (
        payloads.select("payload_id", F.posexplode(listing["data"]["children"]))
        .where(c("col.data").isNotNull())
        .select("payload_id", c("pos").alias("post_ord"), "col.data.*")
    )
    return child.select(
        "payload_id",
        "post_ord",
        F.concat(
            F.coalesce("title", F.lit("")),
            F.lit(". "),
            F.coalesce("selftext", F.lit("")),
        ).alias("text"),
        F.when(
            F.coalesce("permalink", F.lit("")) != "", F.concat(F.lit(SITE), "permalink")
        )
        .otherwise(F.coalesce("url", F.lit(f"{SITE}/")))
        .alias("url"),
        F.concat(F.lit("reddit:"), F.coalesce("subreddit", F.lit("unknown"))).alias("label"),
        F.when(
            F.coalesce(c("created_utc") != 0, F.lit(False)),
            F.timestamp_micros((c("created_utc") * 1_000_000).cast("bigint")),
        )
        .otherwise(params.now_col())
        .alias("posted_at"),
    ).where(mentions_brand(c("text"), params))


def post_candidates(payloads: DataFrame, params: Params) -> DataFrame:
    """Candidates of posts; discovered when the post was written."""
    c = F.col
    keys = ("payload_id", "post_ord", "url", "label", "posted_at")
    docs = posts(payloads, params).withColumn("about_brand", F.lit(True))
    found = text_candidates(docs, params, keys=keys)
    return with_source(
        found, params, c("label"), c("url"), F.lit("community"), discovered_at=c("posted_at")
    )
