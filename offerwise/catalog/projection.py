"""Inputs of the registered queries, derived by Spark from the given tables.

Offers are published per part, publishers are suppliers and every line item is a
claim, read at a fixed ``now``. Texts, pages and payloads are built from the same
columns by string templates, so their true terms are known.
"""

from __future__ import annotations

import datetime as dt
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerwise.functions.pricing import format_amount
from offerwise.operators.evidence import attach_evidence
from offerwise.operators.merge import merge_sources, merge_terms
from offerwise.operators.pricing import refresh_derived
from offerwise.operators.skew import Dealt, deal
from offerwise.params import Params
from offerwise.schemas import CLAIMS, OFFERS, conform
from offerwise.session import spread, staged

# the instant after the last claim, and that at which the texts and pages were read
NOW = dt.datetime(2001, 11, 5)
PARAMS = Params(now=NOW, brand="acme")
TEXT_PARAMS = Params(now=dt.datetime(1998, 6, 1), brand="acme")
# claims seen before this instant form the stored state of the upsert queries
CUTOFF = "1998-06-01"


KEY = "dedupe_key"

# the columns of a line item that make a claim
LINE_COLUMNS = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_tax",
    "l_returnflag",
    "l_shipdate",
)


@cache
def _schema(path: str) -> StructType:
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its schema is read from the file once per process."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


def offer_key(part: Column) -> Column:
    return F.concat(F.lit("CODE:PART"), _int_text(part))


def _int_text(value: Column) -> Column:
    return value.cast("bigint").cast("string")


def raw_claims(
    spark: SparkSession, sf_dir: str, lines: DataFrame | None = None
) -> DataFrame:
    """Line items as claims, in the claims schema, with part and supplier keys kept.

    ``lines``: other rows than the whole table, such as a stream of it, or with the offer's
    key, by which they are dealt then.
    """
    c = F.col
    seen = c("l_shipdate").cast("timestamp")
    given = lines is not None
    dealt = given and KEY in lines.columns
    line = lines if given else table(spark, sf_dir, "lineitem")
    line = line.select(*LINE_COLUMNS, *([KEY] if dealt else []))
    line = line if given else spread(line)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    joined = line.join(supplier, c("l_suppkey") == c("s_suppkey"))
    if dealt:  # the join by offer leaves the lines where they are
        keyed = part.withColumn(KEY, offer_key(c("p_partkey"))).hint("shuffle_hash")
        joined = joined.join(keyed, KEY)
    else:
        joined = joined.join(part, c("l_partkey") == c("p_partkey"))
    kind = c("p_partkey") % 5
    unknown = c("l_quantity") == 2
    named = (
        F.when(unknown, "unknown")
        .when(kind == 1, "percentage")
        .when(kind == 2, "sale")
        .when(kind == 3, "cashback")
        .otherwise("flat")
    )
    size = c("p_size").cast("double")
    value = F.when(kind == 1, 5 + size).otherwise(100 + 20 * size) + F.when(
        c("l_quantity") == 50, 10.0
    ).otherwise(0.0)
    known = (c("l_linenumber") <= 3) & (c("p_partkey") % 7 != 0)
    minimum = 500 + 10 * size + F.when(c("l_tax") == 0.08, 100.0).otherwise(0.0)
    prefix = F.element_at(
        F.array(F.lit(""), F.lit("www."), F.lit("m."), F.lit("amp.")),
        (c("l_suppkey") % 4 + 1).cast("int"),
    )
    domain = F.concat(prefix, F.lit("pub"), _int_text(c("l_suppkey")), F.lit(".example"))
    days = F.floor(F.unix_micros(seen) / F.lit(86.4e9)).cast("bigint")
    return joined.select(
        "l_partkey",
        "l_suppkey",
        (
            F.shiftleft(days, 44)
            + F.shiftleft(c("l_orderkey"), 4)
            + c("l_linenumber").cast("bigint")
        ).alias("seq"),
        c(KEY) if dealt else offer_key(c("p_partkey")).alias(KEY),
        F.concat(F.lit("PART"), _int_text(c("p_partkey"))).alias("code"),
        c("p_name").alias("title"),
        c("p_name").alias("raw_text"),
        named.alias("discount_type"),
        F.when(~unknown, value).alias("discount_value"),
        F.when(known, minimum).alias("minimum_order"),
        F.when((kind == 1) & (c("l_linenumber") == 4), 200 + 5 * size).alias("maximum_discount"),
        (c("l_quantity") == 1).alias("is_up_to"),
        known.alias("minimum_order_known"),
        F.when(c("l_linenumber") == 1, seen + F.make_dt_interval(200 + 60 * c("p_size"))).alias(
            "expiry_date"
        ),
        ((c("l_returnflag") == "R") & (c("l_quantity") >= 45)).alias("reported_expired"),
        F.concat(F.lit("pub"), _int_text(c("l_suppkey"))).alias("source_name"),
        F.concat(F.lit("https://"), domain, F.lit("/offers")).alias("source_url"),
        F.when(c("s_nationkey") % 5 == 0, "official").otherwise("coupon-site").alias(
            "source_type"
        ),
        domain.alias("source_domain"),
        seen.alias("discovered_at"),
        seen.alias("last_seen_at"),
        c("p_name").alias("snippet"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(raw_claims(spark, sf_dir), CLAIMS)


def claims_from(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    return conform(raw_claims(spark, sf_dir, lines), CLAIMS)


def with_offer_key(lines: DataFrame) -> DataFrame:
    """What makes a claim of line items, with the offer's key."""
    line = lines.select(*LINE_COLUMNS)
    line = line.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    return line.withColumn(KEY, offer_key(F.col("l_partkey")))


def dealt_claims(
    spark: SparkSession, sf_dir: str, params: Params = PARAMS, late: bool = False
) -> list[Dealt]:
    """The claims written once by offer, for those who merge both terms and sources.

    Merging reads neither the code nor the raw text of a claim. ``late``: line items are written,
    and become claims where they are read.
    """
    return deal(
        with_offer_key(table(spark, sf_dir, "lineitem")),
        KEY,
        params,
        lambda lines: claims_from(spark, sf_dir, lines).drop("code", "raw_text"),
        "l_partkey",
        late,
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_sources(claims(spark, sf_dir), PARAMS)


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_terms(claims(spark, sf_dir), PARAMS)


def part_of(key: Column) -> Column:
    """The part number in a dedupe key."""
    return F.substring(key, 10, 20).cast("bigint")


def offers(
    spark: SparkSession,
    sf_dir: str,
    params: Params = PARAMS,
    with_sources: bool = False,
    unread: tuple[str, ...] = ("snippet", "claim_cap"),
) -> tuple[DataFrame, DataFrame]:
    """A stored snapshot with evidence: merged terms plus a validation state that
    depends on the part number. Returns (offers, sources); ``with_sources`` stores the
    sources too, for those who read them again, without snippets and caps, which only
    ``stored`` has."""
    parts = [
        _offers_of(part, params, with_sources, unread)
        for part in dealt_claims(spark, sf_dir, params, late=True)
    ]
    return reduce(
        lambda a, b: (a[0].unionByName(b[0]), a[1].unionByName(b[1])), parts
    )


def _offers_of(
    part: Dealt, params: Params, with_sources: bool, unread: tuple[str, ...]
) -> tuple[DataFrame, DataFrame]:
    c, now = F.col, params.now_col()
    found = merge_sources(part.rows, PARAMS, part.buckets)
    if with_sources:
        found = staged(found.drop(*unread), KEY, part.buckets)
    k = part_of(c("dedupe_key"))
    hours = lambda n: now - F.make_dt_interval(hours=n)
    states = F.array(*map(F.lit, ("valid", "unverified", "manual_validation_required", "invalid")))
    state = merge_terms(part.rows, PARAMS, part.buckets, publishers=False).withColumns(
        {
            "currency": F.lit(params.currency),
            "country": F.lit(params.country),
            "status": F.when(c("expiry_date") < now, "expired").otherwise(
                F.element_at(states, (k % 4 + 1).cast("int"))
            ),
            "last_validated_at": F.when(k % 11 != 0, hours((k % 100).cast("int"))),
            "validation_method": F.when(k % 11 != 0, "public-sources-only"),
            "validation_notes": F.lit(None).cast("string"),
            "validation_attempts": (k % 4).cast("int"),
            "cart_accepted_at": F.when(k % 13 == 0, hours((k % 90).cast("int"))),
            "created_at": now,
            "updated_at": now,
        }
    )
    scored = refresh_derived(attach_evidence(state, found, params), params)
    # a snapshot is a stored table for what follows, so it is computed once
    return staged(scored, KEY, part.buckets), found


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot in the stored schemas."""
    snapshot, found = offers(spark, sf_dir, with_sources=True, unread=())
    return conform(snapshot, OFFERS), found


def choose(index: Column, options: list[Column] | tuple[Column, ...]) -> Column:
    """The option at ``index``; only that one is built."""
    chosen = F.lit(None)
    for place in range(len(options) - 1, -1, -1):
        chosen = F.when(index == place, options[place]).otherwise(chosen)
    return chosen


# --- texts -------------------------------------------------------------------


def filled(template: str, values: dict[str, Column]) -> Column:
    """``{name}`` placeholders replaced by columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        text, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(text), values[name]]
    return F.concat(*parts, F.lit(rest))


# one sentence per part number modulo 12
SENTENCES = (
    "Flat Rs.{v} off on orders above Rs.{m}",
    "{p}% off up to INR {c}, min order value Rs {m}",
    "UP TO {p}% OFF SALE on all styles",
    "Flat Rs.{v} cashback on orders above Rs.{m}",
    "Rs.{vg} off Rs.{m}",
    "Save up to Rs.{v} off your order",
    "{p}% discount, maximum discount Rs {c} for new users only",
    "Get Rs.{v} off with code PART{k}. Valid till 31 August 1998",
    "Extra {p}% off for existing users, app only. Ends December 5, 1998",
    "This coupon has expired. Rs.{v} off",
    "Free styles and  colours every day",
    "Rs.{v}/- off on first order, selected products, spend Rs.{m} or more. Expires 07/11/1998",
)


def offer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One promotion sentence per line item: ``text_id, p_partkey, text``."""
    c = F.col
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    joined = line.join(part, c("l_partkey") == c("p_partkey"))
    size = c("p_size")
    whole = lambda v: v.cast("bigint").cast("string")
    values = {
        "v": whole(100 + 20 * size),
        "vg": format_amount((100 + 20 * size).cast("double")),
        "m": whole(500 + 10 * size + 10 * c("l_linenumber")),
        "c": whole(200 + 5 * size),
        "p": whole(5 + size),
        "k": whole(c("p_partkey")),
    }
    sentence = choose(
        c("p_partkey") % len(SENTENCES), [filled(s, values) for s in SENTENCES]
    )
    return spread(
        joined.select(
            (c("l_orderkey") * 10 + c("l_linenumber")).alias("text_id"),
            "p_partkey",
            sentence.alias("text"),
        )
    )


# --- pages and payloads --------------------------------------------------------

PAGE_HTML = (
    "<html><head><title>Acme coupons {k}</title><style>li{{}}</style></head><body>"
    "<nav><ul><li class='coupon'>Rs.9 off in the menu</li></ul></nav>"
    "<div class='coupon-card' data-coupon-code='CARD{k}X'><h3>Flat Rs.{v} OFF on orders above "
    "Rs.{m9}</h3> <p>New users only.</p></div>"
    "<script>var x = '<li>Rs.7 off for all</li>';</script>"
    "<script type='application/ld+json'>"
    '{{"@graph":[{{"@type":"Offer","name":"Acme India","description":"{p}% off on all styles",'
    '"couponCode":"LD{k}Y","validThrough":"1998-12-31"}},'
    '{{"@type":"Thing","name":"Nothing to save"}}]}}</script>'
    "<ul><li>Use code LIST{k}Z for {p}% off up to Rs.{c}"
    "<li>Mega sale: up to {p}% off this week</ul></body></html>"
)
BARE_HTML = (
    "<html><head><title>Acme news {k}</title></head><body><p>Use code BARE{k}X for Rs.{v} off. "
    "Good morning everyone. Acme gives flat Rs.{c} off.</p></body></html>"
)


def braced(template: str, values: dict[str, Column]) -> Column:
    """As ``_filled`` with ``{{`` and ``}}`` standing for braces."""
    marked = template.replace("{{", "\x01").replace("}}", "\x02")
    return F.translate(filled(marked, values), "\x01\x02", "{}")


def offer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per part: two thirds with offer markup, one third bare text."""
    c = F.col
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    whole = lambda v: v.cast("bigint").cast("string")
    values = {
        "k": whole(c("p_partkey")),
        "v": whole(100 + 20 * c("p_size")),
        "m9": whole(2000 + 10 * c("p_size")),
        "c": whole(200 + 5 * c("p_size")),
        "p": whole(5 + c("p_size")),
    }
    html = F.when(c("p_partkey") % 3 == 2, braced(BARE_HTML, values)).otherwise(
        braced(PAGE_HTML, values)
    )
    site = (c("p_partkey") % 8).cast("string")
    made = part.select(
        c("p_partkey").alias("page_id"),
        c("p_partkey").alias("page_ord"),
        F.concat(
            F.lit("https://site"), site, F.lit(".example/acme/"), whole(c("p_partkey"))
        ).alias("url"),
        F.concat(F.lit("site"), site).alias("source_name"),
        F.lit("coupon-site").alias("source_type"),
        F.lit(True).alias("page_about_brand"),
        F.lit("http").alias("via"),
        html.alias("html"),
    )
    return spread(made)
