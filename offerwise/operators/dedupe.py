"""Identity of an offer and removal of repeated claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerwise.functions.codes import normalise_code
from offerwise.functions.text import number_text, title_of
from offerwise.operators.skew import split_join
from offerwise.params import Params
from offerwise.session import staged


def _points(cond: Column, points: int) -> Column:
    return F.when(cond, points).otherwise(0)


def information_score() -> Column:
    """How well specified a candidate is, within one page."""
    c = F.col
    return (
        cycle_score()
        + _points(c("maximum_discount").isNotNull(), 1)
        + _points(c("discount_type") != "unknown", 1)
    )


def cycle_score() -> Column:
    """How well specified a candidate is, within one cycle."""
    c = F.col
    return (
        _points(c("code").isNotNull(), 4)
        + _points(c("discount_value").isNotNull(), 2)
        + _points(c("minimum_order_known"), 2)
        + _points(c("expiry_date").isNotNull(), 1)
    )


def dedupe_key(chars: int | None = None) -> Column:
    """``CODE:<code>``, or ``OFFER:`` and a fingerprint of the terms when there is no code.

    The cleaned title is one of the terms, or the whole text where the title is its cut form.
    With ``chars`` only so many characters of the title count.
    """
    c = F.col
    code = normalise_code(c("code"))
    title = F.coalesce(c("title"), c("raw_text"))
    if chars is None:
        cut_title = (c("title") != c("raw_text")) & (c("title") == title_of(c("raw_text")))
        title = F.when(cut_title, c("raw_text")).otherwise(title)
    title = F.trim(
        F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9%₹ ]", ""), " +", " ")
    )
    if chars is not None:
        title = F.substring(title, 1, chars)
    numbers = [
        F.coalesce(number_text(c(n)), F.lit(""))
        for n in ("discount_value", "minimum_order", "maximum_discount")
    ]
    canonical = F.concat_ws(
        "|",
        c("discount_type"),
        *numbers,
        F.when(c("is_up_to"), "upto").otherwise("exact"),
        F.coalesce(title, F.lit("")),
    )
    return F.coalesce(
        F.concat(F.lit("CODE:"), code),
        F.concat(F.lit("OFFER:"), F.substring(F.sha1(canonical), 1, 20)),
    )


def text_key(text: str = "raw_text", chars: int | None = None) -> Column:
    """Identity of a candidate inside one document: its code, or else the hash of its text.

    With ``chars`` only so many first characters of the text count.
    """
    whole = F.col(text)
    told = F.sha2(F.lower(whole), 256) if chars is None else F.lower(F.substring(whole, 1, chars))
    return F.coalesce(F.col("code"), F.concat(F.lit("TXT:"), told))


def _best(df: DataFrame, keys: list[str], score: Column, order: str) -> DataFrame:
    """Per group the best row, the earliest on ties, at the group's first position.

    ``max_by`` combines map-side, so a hot group costs one row per task.
    """
    fields = [c for c in df.columns if c not in keys]
    best = F.max_by(
        F.struct(*(F.col(c) for c in fields)), F.struct(score, -F.col(order))
    )
    return (
        df.groupBy(*keys)
        .agg(best.alias("_best"), F.min(order).alias("_first"))
        .select(
            *keys,
            *(F.col(f"_best.{c}").alias(c) for c in fields if c != order),
            F.col("_first").alias(order),
        )
    )


def page_dedupe(df: DataFrame, params: Params, page: list[str], pos: str = "pos") -> DataFrame:
    """Per page one candidate per code or text, the best specified first.

    With ``max_candidates_per_page`` set, a page holds at most so many keys; once full,
    everything further down the page is dropped, better duplicates too.
    """
    c = F.col
    keyed = df.withColumn("_key", text_key(chars=params.text_key_chars))
    if params.max_candidates_per_page is None:
        return _best(keyed, [*page, "_key"], information_score(), pos).drop("_key")
    firsts = keyed.groupBy(*page, "_key").agg(
        F.min(pos).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # position of the last key that fits: the limit-th smallest first occurrence
    rank = F.row_number().over(Window.partitionBy(*page).orderBy("_first"))
    limit = params.max_candidates_per_page
    closing = (
        firsts.select(*page, "_first")
        .withColumn("_rank", rank)
        .where(c("_rank") <= limit)
        .groupBy(*page)
        .agg(F.max("_first").alias("_max"), F.count(F.lit(1)).alias("_keys"))
        .select(*page, F.when(c("_keys") == limit, c("_max")).alias("_last"))
    )
    sizes = firsts.groupBy(*page).agg(F.sum("_rows").alias("_rows"))
    ends = staged(sizes.join(closing, page))

    def finish(rows: DataFrame) -> DataFrame:
        kept = rows.where(c("_last").isNull() | (c(pos) <= c("_last"))).drop("_last", "_rows")
        return _best(kept, [*page, "_key"], information_score(), pos)

    return split_join(keyed, ends, page, "_rows", finish, params).drop("_key")


def cycle_dedupe(claims: DataFrame) -> DataFrame:
    """Per (offer, publisher, page) the best-specified claim of this cycle."""
    return _best(claims, ["dedupe_key", "source_name", "source_url"], cycle_score(), "seq")


def source_cap(claims: DataFrame, params: Params, source: str = "source_label") -> DataFrame:
    """The first candidates of each source, in arrival order.

    ``row_number() <= n`` is pushed below the shuffle, so each task sends at most n
    rows of a source however many it holds.
    """
    rank = F.row_number().over(Window.partitionBy(source).orderBy("seq"))
    return (
        claims.withColumn("_rank", rank)
        .where(F.col("_rank") <= params.max_candidates_per_source)
        .drop("_rank")
    )
