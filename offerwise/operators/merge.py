"""Resolving many publishers' claims to one record per offer.

The rules depend on arrival order (``seq``): official claims replace, others only
tighten. Each rule has a closed form over plain aggregates, so nothing is ever
collected per offer:

* pass 1 is one map-side combined aggregation over numbers only, so it needs no sort. It
  holds every field that needs no order beyond min/max, the ``seq`` of the last official
  claim per field, and that of each claim whose texts the offer takes;
* pass 2 joins the claims with these marks by key, aggregates from the marks on and takes
  the texts where ``seq`` says so, again by a hash aggregation over numbers. The marks are broadcast when their number is small;
  otherwise hot offers (bounded in number by construction) are broadcast and the rest is
  joined by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.operators.skew import split_join
from offerwise.params import Params
from offerwise.session import staged

KEY = "dedupe_key"
FLAGS = [
    "new_users_only",
    "first_order_only",
    "app_only",
    "selected_users_only",
    "selected_products_only",
]


def _official() -> Column:
    return F.col("source_type") == "official"


def _known_type() -> Column:
    return F.coalesce(F.col("discount_type") != "unknown", F.lit(False))


def _minimum() -> Column:
    """The minimum order where the claim states it as known."""
    return F.when(F.col("minimum_order_known"), F.col("minimum_order"))


def _pass1(claims: DataFrame, params: Params) -> DataFrame:
    c, seq = F.col, F.col("seq")
    value, minimum = c("discount_value"), _minimum()
    official, known = _official(), _known_type()
    past = c("expiry_date") < params.now_col()
    new = F.when(seq >= 0, seq)
    aggs = {
        "claims": F.count(F.lit(1)),
        "first_minimum": F.min_by("minimum_order", seq),
        "first_discovered": F.min_by("discovered_at", seq),
        "first_official": F.min_by(F.coalesce(official, F.lit(False)), seq),
        "first_minimum_order_known": F.min_by("minimum_order_known", seq),
        **{f"first_{f}": F.min_by(f, seq) for f in FLAGS},
        "title_at": F.min(F.when(c("title") != "", seq)),
        "type_at": F.max(F.when(official & known, seq)),
        "value_official": F.max_by(value, F.when(official & known & value.isNotNull(), seq)),
        "value_typed": F.min_by(value, F.when(known & value.isNotNull(), seq)),
        "value_any": F.min_by(value, F.when(value.isNotNull(), seq)),
        "typed_at": F.min(F.when(known, seq)),
        "untyped_values": F.count(F.when(~known & value.isNotNull(), 1)),
        "minimum_max": F.max(minimum),
        "minimum_mark": F.max(F.when(official & minimum.isNotNull(), seq)),
        "cap_min": F.min("maximum_discount"),
        "cap_mark": F.max(F.when(official & c("maximum_discount").isNotNull(), seq)),
        "hedge_any": F.max("is_up_to"),
        "hedge_mark": F.max(F.when(official, seq)),
        "expiry_min": F.min("expiry_date"),
        "expiry_mark": F.max(F.when(official & c("expiry_date").isNotNull(), seq)),
        # stored offers take part as a claim with seq -1; they are judged together with
        # the first new claim, which may be an official one that resets the expiry
        "expired_by": F.min_by("expiry_date", F.when(past & (seq >= 0), seq)),
        "stored_past": F.max(F.when(past & (seq < 0), c("expiry_date"))),
        "opens_with_reset": F.min_by(official & c("expiry_date").isNotNull(), new),
        "opening_at": F.min(new),
        "closing_at": F.max(new),
        "existing_official": F.max_by(
            "existing_users_allowed",
            F.when(official & c("existing_users_allowed").isNotNull(), seq),
        ),
        "existing_first": F.min_by(
            "existing_users_allowed", F.when(c("existing_users_allowed").isNotNull(), seq)
        ),
        "last_seen_at": F.max("last_seen_at"),
        "official_seen": F.max(F.when(official, c("last_seen_at"))),
        **{f"any_{f}": F.max(f) for f in FLAGS},
    }
    return claims.groupBy(KEY).agg(*(agg.alias(name) for name, agg in aggs.items()))


def _pass2(
    claims: DataFrame, marks: DataFrame, params: Params, buckets: int | None, publishers: bool
) -> DataFrame:
    """Fields from their mark on, and the texts of the claims that pass 1 chose.

    Texts ride in the grouping key of the few chosen claims, so all claims are combined by a
    hash aggregation over numbers, and what is left, a few rows per offer, is grouped by offer.
    """
    c, seq = F.col, F.col("seq")
    texts = {"title": "title_at", "type_official": "type_at", "type_first": "typed_at"}
    if publishers:
        texts |= {"opening_source": "opening_at", "closing_source": "closing_at"}
    source = F.struct("source_name", "source_url", "source_type")
    text_of = {"title": c("title"), "type_official": c("discount_type"), "type_first": c("discount_type")}
    narrow = claims.select(
        KEY,
        "seq",
        "title",
        "discount_type",
        "discount_value",
        _minimum().alias("known_minimum"),
        "maximum_discount",
        "is_up_to",
        "expiry_date",
        *(("source_name", "source_url", "source_type") if publishers else ()),
    )

    def finish(marked: DataFrame) -> DataFrame:
        chosen = reduce(Column.__or__, (seq == c(mark) for mark in sorted(set(texts.values()))))
        held = F.struct(
            *(F.when(seq == c(mark), text_of.get(name, source)).alias(name) for name, mark in texts.items())
        )
        later = (seq >= c("typed_at")) & c("discount_value").isNotNull()
        combined = marked.groupBy(KEY, F.when(chosen, held).alias("texts")).agg(
            F.max(F.when(seq >= c("minimum_mark"), c("known_minimum"))).alias("minimum_late"),
            F.min(F.when(seq >= c("cap_mark"), c("maximum_discount"))).alias("cap_late"),
            F.max(F.when(seq >= c("hedge_mark"), c("is_up_to"))).alias("hedge_late"),
            F.min(F.when(seq >= c("expiry_mark"), c("expiry_date"))).alias("expiry_late"),
            F.min(F.when(later, seq)).alias("value_at"),
            F.min_by("discount_value", F.when(later, seq)).alias("value_late"),
        )
        return combined.groupBy(KEY).agg(
            F.max("minimum_late").alias("minimum_late"),
            F.min("cap_late").alias("cap_late"),
            F.max("hedge_late").alias("hedge_late"),
            F.min("expiry_late").alias("expiry_late"),
            F.min_by("value_late", "value_at").alias("value_late"),
            *(F.max(c("texts")[name]).alias(name) for name in texts),
        )

    if buckets is not None:
        return finish(narrow.join(marks.hint("shuffle_hash"), KEY))
    return split_join(narrow, marks, KEY, "claims", finish, params)


def merge_terms(
    claims: DataFrame, params: Params, buckets: int | None = None, publishers: bool = True
) -> DataFrame:
    """One row per offer: the terms after merging all claims in arrival order.

    ``buckets``: claims are bucketed by offer, none of which is hot (``skew.deal``).
    ``publishers``: with the sources of the first and the last new claim.
    """
    c = F.col
    first_pass = staged(_pass1(claims, params), KEY, buckets)
    marks = first_pass.select(
        KEY, "claims", "typed_at", "type_at", "title_at", "opening_at", "closing_at",
        "minimum_mark", "cap_mark", "hedge_mark", "expiry_mark",
    )
    merged = first_pass.join(_pass2(claims, marks, params, buckets, publishers), KEY, "left")

    later_value = F.when(
        c("untyped_values") == 0, c("value_typed")
    ).when(c("typed_at").isNull(), c("value_any")).otherwise(c("value_late"))
    return merged.select(
        KEY,
        "claims",
        F.when(c(KEY).startswith("CODE:"), F.substring(c(KEY), 6, 1_000_000)).alias("code"),
        "title",
        F.coalesce("type_official", "type_first", F.lit("unknown")).alias("discount_type"),
        F.coalesce(c("value_official"), later_value).alias("discount_value"),
        F.coalesce(c("minimum_late"), c("minimum_max"), "first_minimum").alias(
            "minimum_order"
        ),
        F.coalesce("cap_late", "cap_min").alias("maximum_discount"),
        F.coalesce("hedge_late", "hedge_any").alias("is_up_to"),
        (c("minimum_max").isNotNull() | c("first_minimum_order_known")).alias(
            "minimum_order_known"
        ),
        *(
            F.when(c(f"any_{f}"), F.lit(True)).otherwise(c(f"first_{f}")).alias(f)
            for f in FLAGS
        ),
        F.coalesce("existing_official", "existing_first").alias("existing_users_allowed"),
        F.coalesce("expiry_late", "expiry_min").alias("expiry_date"),
        # an expiry that was past when its claim arrived expires the offer for good
        F.coalesce(F.when(~c("opens_with_reset"), c("stored_past")), c("expired_by")).alias(
            "expired_by"
        ),
        *(("opening_source", "closing_source") if publishers else ()),
        c("first_discovered").alias("first_seen_at"),
        "last_seen_at",
        F.when(
            c("first_official"), F.greatest(c("official_seen"), params.now_col())
        )
        .otherwise(c("official_seen"))
        .alias("official_confirmed_at"),
    )


def merge_sources(claims: DataFrame, params: Params, buckets: int | None = None) -> DataFrame:
    """One row per (offer, publisher, page): first discovery, latest sighting and claim.

    ``claims`` may hold stored source rows as well; they carry ``arrived_at``, and ``claimed`` if it
    is wanted: whether a row of a page has it. Nearly every
    claim is a page of its own, so combining map-side would sort all claims and save nothing:
    they are dealt by page first and sorted once, by a hash of the page before the page itself, as
    texts that begin alike are slow to compare. Claims that are in ``buckets`` by offer stay there.
    """
    c = F.col
    stored = "arrived_at" in claims.columns
    # a claim without a place in the order is the earliest
    order = F.struct("arrived_at", "seq") if stored else F.coalesce("seq", F.lit(-(2**63)))
    first = ("source_type", "source_domain", "discovered_at", "seq", *(("arrived_at",) if stored else ()))
    last = F.struct(
        "discount_type",
        "discount_value",
        "minimum_order",
        "maximum_discount",
        "reported_expired",
    )
    claimed = ("claimed",) if "claimed" in claims.columns else ()
    page = (KEY, "source_name", "source_url")
    placed = claims.repartition(*page) if buckets is None else claims
    grouped = placed.groupBy(F.xxhash64(*page).alias("page_hash"), *page).agg(
        F.min_by(F.struct(*first), order).alias("first"),
        F.max_by(last, order).alias("last"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.max_by("snippet", F.when(c("snippet").isNotNull(), order)).alias("snippet"),
        *(F.max(name).alias(name) for name in claimed),
    )
    return grouped.select(
        KEY,
        "source_name",
        "source_url",
        c("first.source_type"),
        c("first.source_domain"),
        c("first.discovered_at"),
        "last_seen_at",
        "snippet",
        c("last.discount_type").alias("claim_type"),
        c("last.discount_value").alias("claim_value"),
        c("last.minimum_order").alias("claim_minimum"),
        c("last.maximum_discount").alias("claim_cap"),
        c("last.reported_expired"),
        (c("first.arrived_at") if stored else params.now_col()).alias("arrived_at"),
        c("first.seq").alias("first_seq"),
        *claimed,
    )


def conflicts(sources: DataFrame) -> DataFrame:
    """Offers whose concrete claims differ in type, value or published minimum.

    Pairwise disagreement is the same as the smallest differing from the largest.
    """
    concrete = F.col("claim_value").isNotNull() & F.col("claim_type").isNotNull()
    spread = []
    for name in ("claim_type", "claim_value", "claim_minimum"):
        held = F.when(concrete, F.col(name))
        spread.append(F.coalesce(F.min(held) != F.max(held), F.lit(False)))
    return sources.groupBy(KEY).agg(
        (spread[0] | spread[1] | spread[2]).alias("conflicting_sources")
    )
