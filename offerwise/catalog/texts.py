"""Registered queries over texts: parsing scalars, codes, dates, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwise.catalog import projection as data
from offerwise.catalog.projection import TEXT_PARAMS as PARAMS
from offerwise.catalog.registry import big, query, ts
from offerwise.functions import codes as code_fn
from offerwise.functions import messages, urls
from offerwise.functions import text as text_fn
from offerwise.functions.expiry import expiry_matches, nearest_date
from offerwise.functions.terms import eligibility, is_empty_offer
from offerwise.functions.terms import parse_terms as parse
from offerwise.operators.dedupe import dedupe_key as key_of
from offerwise.session import spread
from offerwise.sources.candidates import with_source
from offerwise.sources.plaintext import text_candidates

_WS = "[\\t\\n\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _normal(x: str) -> str:
    """Text normalising in SQL."""
    out = f"translate({x}, chr(160) || '‘’“”–—', ' ''''''''--')"
    for word in ("rs\\.?", "inr", "rupees?"):
        out = f"regexp_replace({out}, '(?i)\\b{word}{_WS}?', '₹', 'g')"
    out = f"regexp_replace({out}, '([0-9]){_WS}*/-', '\\1', 'g')"
    return f"trim(regexp_replace({out}, '{_WS}+', ' ', 'g'), ' ')"


@query(
    f"""SELECT 'doc' AS origin, doc_id AS text_id, {_normal('text')} AS normal FROM documents
    UNION ALL SELECT 'turn', conv_id * 1000 + turn, {_normal('text')} FROM conversations"""
)
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents and conversation turns."""
    docs = data.table(spark, sf_dir, "documents").select(
        F.lit("doc").alias("origin"), F.col("doc_id").alias("text_id"), "text"
    )
    turns = data.table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text"
    )
    return spread(docs.unionByName(turns)).select(
        "origin", "text_id", text_fn.normalise_text(F.col("text")).alias("normal")
    )


@query(
    """WITH priced AS (SELECT l_orderkey * 10 + l_linenumber AS line_id,
      round(l_extendedprice)::BIGINT AS n, l_orderkey % 5 AS form FROM lineitem)
    SELECT line_id, CASE form WHEN 0 THEN CASE WHEN n > 0 THEN n END
      WHEN 1 THEN n * 10 + 0.5 WHEN 3 THEN CASE WHEN n * 100 <= 1000000 THEN n * 100 END END::DOUBLE
      AS amount FROM priced
    WHERE form <> 1 OR n * 10 + 0.5 <= 1000000
    UNION ALL SELECT line_id, NULL FROM priced WHERE form = 1 AND n * 10 + 0.5 > 1000000"""
)
def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written as grouped, decimal, signed, large and worded texts."""
    c = F.col
    n = F.round("l_extendedprice").cast("bigint")
    forms = [
        F.format_number(n, 0),
        F.concat((n * 10).cast("string"), F.lit(".5")),
        F.concat(F.lit("-"), n.cast("string")),
        (n * 100).cast("string"),
        F.concat(n.cast("string"), F.lit(" or so")),
    ]
    return data.table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("line_id"),
        text_fn.parse_amount(data.choose(c("l_orderkey") % 5, forms)).alias(
            "amount"
        ),
    )


# The true terms of each sentence form, straight from the columns.
_TEXTS = """WITH texts AS (
  SELECT l_orderkey * 10 + l_linenumber AS text_id, p_partkey AS k, p_partkey % 12 AS form,
    (100 + 20 * p_size)::DOUBLE AS v, (500 + 10 * p_size + 10 * l_linenumber)::DOUBLE AS m,
    (200 + 5 * p_size)::DOUBLE AS cap, (5 + p_size)::DOUBLE AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_TRUE_TYPE = """CASE WHEN form IN (1, 6, 8) THEN 'percentage' WHEN form = 2 THEN 'sale'
  WHEN form = 3 THEN 'cashback' WHEN form = 10 THEN 'unknown' ELSE 'flat' END"""
_TRUE_EXPIRY = """CASE form WHEN 7 THEN '1998-08-31 23:59:59' WHEN 8 THEN '1998-12-05 23:59:59'
  WHEN 11 THEN '1998-11-07 23:59:59' END"""


@query(
    f"""{_TEXTS} SELECT text_id, {_TRUE_TYPE} AS discount_type,
    CASE WHEN form IN (1, 2, 6, 8) THEN p WHEN form <> 10 THEN v END AS discount_value,
    CASE WHEN form IN (1, 3) THEN m WHEN form IN (0, 4, 11) AND m >= v THEN m END AS minimum_order,
    form IN (1, 3) OR (form IN (0, 4, 11) AND m >= v) AS minimum_order_known,
    CASE WHEN form IN (1, 6) THEN cap WHEN form = 5 THEN v END AS maximum_discount,
    form IN (2, 5) AS is_up_to, form = 10 AS is_empty, {_TRUE_EXPIRY} AS expiry_date FROM texts"""
)
def parse_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = data.offer_texts(spark, sf_dir)
    return parse(texts, "text", PARAMS.now_col()).select(
        "text_id",
        "discount_type",
        "discount_value",
        "minimum_order",
        "minimum_order_known",
        "maximum_discount",
        "is_up_to",
        is_empty_offer(F.col("discount_type"), F.col("discount_value")).alias("is_empty"),
        ts("expiry_date"),
    )


@query(
    f"""{_TEXTS} SELECT text_id, coalesce(form IN (6, 11), false) AS new_users_only,
    form = 11 AS first_order_only, form = 8 AS app_only, false AS selected_users_only,
    form = 11 AS selected_products_only, form = 8 AS existing_users_allowed,
    form = 9 AS reported_expired FROM texts"""
)
def eligibility_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags with null read as false."""
    low = F.lower(text_fn.normalise_text(F.col("text")))
    flags = [
        F.coalesce(value, F.lit(False)).alias(name) for name, value in eligibility(low).items()
    ]
    return data.offer_texts(spark, sf_dir).select("text_id", *flags)


_DATED = """WITH dated AS (SELECT o_orderkey, o_orderkey % 6 AS form, o_orderdate AS d FROM orders),
  shown AS (SELECT *, d::DATE + INTERVAL 86399 SECOND AS eod FROM dated)"""


@query(
    f"""{_DATED} SELECT o_orderkey, strftime(CASE
      WHEN form = 4 THEN NULL
      WHEN form = 5 THEN CASE
        WHEN month(d) = 2 AND day(d) = 29 THEN TIMESTAMP '1999-03-01 23:59:59'
        WHEN make_timestamp(1998, month(d), day(d), 23, 59, 59) >= TIMESTAMP '1998-05-25'
        THEN make_timestamp(1998, month(d), day(d), 23, 59, 59)
        ELSE make_timestamp(1999, month(d), day(d), 23, 59, 59) END
      WHEN eod > TIMESTAMP '1998-06-01' - INTERVAL 730 DAY
        AND eod < TIMESTAMP '1998-06-01' + INTERVAL 1095 DAY THEN eod END, '%Y-%m-%d %H:%M:%S')
      AS expiry_date
    FROM shown"""
)
def parse_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates printed in six ways: three shapes, two-digit years, without expiry
    wording, and without a year."""
    c = F.col
    d = c("o_orderdate").cast("timestamp")
    f = lambda pattern: F.date_format(d, pattern)
    forms = [
        F.concat(F.lit("Offer valid till "), f("d MMMM yyyy")),
        F.concat(F.lit("Expires "), f("MMM d"), F.lit("th, "), f("yyyy")),
        F.concat(F.lit("ends on "), f("dd/MM/yyyy"), F.lit(" at midnight")),
        F.concat(F.lit("last date "), f("d-M-yyyy")),
        F.concat(F.lit("Published on "), f("d MMMM yyyy")),
        F.concat(F.lit("Ending "), f("d"), F.lit(" of "), f("MMMM")),
    ]
    text = data.choose(c("o_orderkey") % 6, forms)
    printed = data.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    # matches first, dates in a second projection, so the texts are searched once
    found = spread(printed).select(
        "o_orderkey", expiry_matches(F.lower(text_fn.normalise_text(c("text")))).alias("found")
    )
    return found.select(
        "o_orderkey", nearest_date(c("found"), PARAMS.now_col()).alias("expiry_date")
    ).select("o_orderkey", ts("expiry_date"))


@query(
    f"""SELECT l_orderkey * 10 + l_linenumber AS line_id,
    l_orderkey % 8 IN (0, 1, 5, 6) AS relevant, l_orderkey % 8 <> 4 AS mentions
    FROM lineitem"""
)
def brand_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that name the brand as a word and the region, against mere mentions."""
    c = F.col
    forms = (
        "acme sale in India",
        "ACME Rs. 800 off",
        "Acme US coupon $20",
        "macmed India",
        "other India shop",
        "acme.in offers",
        "Acme INR deal",
        "acme everywhere",
    )
    text = F.concat(
        F.element_at(F.array(*map(F.lit, forms)), (c("l_orderkey") % 8 + 1).cast("int")),
        F.lit(" "),
        c("l_linestatus"),
    )
    return data.table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("line_id"),
        text_fn.brand_and_region(text, PARAMS).alias("relevant"),
        text_fn.mentions_brand(text, PARAMS).alias("mentions"),
    )


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL
      ELSE upper(replace(c_name, '#', '')) END AS code FROM customer"""
)
def normalise_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    name = F.regexp_replace("c_name", "#", "")
    forms = [
        F.concat(F.lit("  "), F.lower(name), F.lit(" ")),
        F.regexp_replace(name, "Customer", "Cus tomer "),
        F.concat(name, F.lit("\t\n")),
        F.lit("   "),
    ]
    return data.table(spark, sf_dir, "customer").select(
        "c_custkey",
        code_fn.normalise_code(data.choose(c("c_custkey") % 4, forms)).alias(
            "code"
        ),
    )


_BLOCKED = ", ".join(f"'{w}'" for w in (*code_fn.NEVER_CODES, "ACME", "INDIA"))


def _plausible(x: str, strong: bool) -> str:
    digit = "" if strong else f" AND regexp_matches({x}, '[0-9]')"
    return f"""(regexp_full_match({x}, '[A-Z0-9][A-Z0-9_-]{{3,23}}')
      AND regexp_matches({x}, '[A-Z]') AND {x} NOT IN ({_BLOCKED})
      AND length(regexp_replace({x}, '[^_-]', '', 'g')) <= 3{digit})"""


_TOKENS = "SELECT DISTINCT upper(trim(unnest(regexp_split_to_array(replace(text, 'ß', 'SS'), '[\\t\\n\\x0b\\f\\r ]+')))) AS token FROM documents"


@query(
    f"""WITH tokens AS ({_TOKENS}), cased AS (
      SELECT token FROM tokens UNION SELECT brand FROM (
        SELECT DISTINCT upper(replace(p_brand, '#', '-')) AS brand FROM part
        UNION SELECT upper(p_type) FROM part UNION SELECT unnest([{_BLOCKED}])))
    SELECT token, {_plausible('token', False)} AS weak, {_plausible('token', True)} AS strong
    FROM cased WHERE token <> ''"""
)
def plausible_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of the documents, brands and types, and the blocked words."""
    docs = data.table(spark, sf_dir, "documents")
    part = data.table(spark, sf_dir, "part")
    blocked = sorted({*code_fn.NEVER_CODES, "ACME", "INDIA"})
    words = docs.select(F.explode(F.split("text", r"[\t\n\x0B\f\r ]+")).alias("token"))
    brands = part.select(F.regexp_replace("p_brand", "#", "-").alias("token"))
    types = part.select(F.col("p_type").alias("token"))
    never = spark.range(1).select(F.explode(F.array(*map(F.lit, blocked))).alias("token"))
    tokens = (
        words.unionByName(brands)
        .unionByName(types)
        .unionByName(never)
        .select(F.upper(F.trim("token")).alias("token"))
        .where(F.col("token") != "")
        .distinct()
    )
    token = F.col("token")
    return tokens.select(
        "token",
        code_fn.is_plausible_code(token, False, PARAMS).alias("weak"),
        code_fn.is_plausible_code(token, True, PARAMS).alias("strong"),
    )


@query(
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'ORD' || o_orderkey
      WHEN 1 THEN 'NEW-' || o_orderkey WHEN 2 THEN 'SAVE' || o_orderkey
      WHEN 5 THEN 'LATE' || o_orderkey END AS code FROM orders"""
)
def code_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    key = c("o_orderkey").cast("string")
    forms = [
        F.concat(F.lit("Use code ORD"), key, F.lit(" to get Rs.800 off")),
        F.concat(F.lit("Coupon code: NEW-"), key),
        F.concat(F.lit("CODE - SAVE"), key, F.lit(", today only")),
        F.concat(F.lit("use code freeship now, order "), key),
        F.concat(F.lit("Use code Mixed"), key),
        # the first phrase names prose, the second a code
        F.concat(F.lit("apply code at checkout; promo code LATE"), key),
    ]
    text = data.choose(c("o_orderkey") % 6, forms)
    return data.table(spark, sf_dir, "orders").select(
        "o_orderkey", code_fn.code_from_text(text, PARAMS).alias("code")
    )


_CLEAN = "coalesce(trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9%₹ ]', '', 'g'), ' +', ' ', 'g'), ' '), '')"
_PLAIN = "coalesce(regexp_replace({x}::DOUBLE::VARCHAR, '\\.0$', ''), '')"
_DOC_TITLE = "CASE WHEN length({t}) <= 120 THEN {t} ELSE left({t}, 117) || '...' END"


@query(
    f"""WITH given AS (SELECT doc_id, {_normal('text')} AS raw FROM documents),
    titled AS (SELECT doc_id, {_DOC_TITLE.format(t='raw')} AS title, {_CLEAN.format(t='raw')} AS whole,
      left({_CLEAN.format(t=_DOC_TITLE.format(t='raw'))}, 90) AS opening,
      ['flat', 'percentage', 'sale', 'cashback', 'unknown'][doc_id % 5 + 1] AS kind,
      CASE WHEN doc_id % 5 < 4 THEN (doc_id % 900) / 2 END AS val,
      CASE WHEN doc_id % 3 = 0 THEN 500 + doc_id % 1000 END AS minimum,
      CASE WHEN doc_id % 7 = 0 THEN 200 END AS cap, doc_id % 4 = 1 AS hedged,
      CASE WHEN doc_id % 10 = 9 THEN 'doc ' || doc_id END AS code FROM given),
    termed AS (SELECT *, 'CODE:' || upper(replace(code, ' ', '')) AS coded,
      concat_ws('|', kind, {_PLAIN.format(x='val')}, {_PLAIN.format(x='minimum')}, {_PLAIN.format(x='cap')},
        CASE WHEN hedged THEN 'upto' ELSE 'exact' END, '') AS terms FROM titled)
    SELECT doc_id, title, coalesce(coded, 'OFFER:' || left(sha1(terms || whole), 20)) AS dedupe_key,
      coalesce(coded, 'OFFER:' || left(sha1(terms || opening), 20)) AS short_key FROM termed"""
)
def dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of offers titled by documents, with and without codes: by the whole text, and by the
    title's first 90 characters."""
    c = F.col
    k = c("doc_id")
    kinds = F.array(*map(F.lit, ("flat", "percentage", "sale", "cashback", "unknown")))
    shaped = data.table(spark, sf_dir, "documents").select(
        "doc_id",
        text_fn.normalise_text(c("text")).alias("raw_text"),
        F.element_at(kinds, (k % 5 + 1).cast("int")).alias("discount_type"),
        F.when(k % 5 < 4, (k % 900) / 2).alias("discount_value"),
        F.when(k % 3 == 0, (500 + k % 1000).cast("double")).alias("minimum_order"),
        F.when(k % 7 == 0, F.lit(200.0)).alias("maximum_discount"),
        (k % 4 == 1).alias("is_up_to"),
        F.when(k % 10 == 9, F.concat(F.lit("doc "), k.cast("string"))).alias("code"),
    )
    titled = shaped.withColumn("title", text_fn.title_of(c("raw_text")))
    return titled.select("doc_id", "title", key_of().alias("dedupe_key"), key_of(90).alias("short_key"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))"


@query(
    f"""SELECT page_id, {_HOST} AS host, regexp_replace({_HOST}, '^(www|m|amp|mobile)\\.', '')
    AS domain, regexp_replace({_HOST}, '^www\\.', '') AS label FROM pages"""
)
def domain_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return data.table(spark, sf_dir, "pages").select(
        "page_id",
        urls.host_of(url).alias("host"),
        urls.normalise_domain(url).alias("domain"),
        urls.host_label(url).alias("label"),
    )


@query(
    """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'cloudflare interstitial'
      WHEN 1 THEN 'captcha widget' WHEN 2 THEN 'http 403 with block markers'
      WHEN 4 THEN 'cloudflare block page' WHEN 5 THEN 'human verification' END AS reason
    FROM pages WHERE page_id % 7 <> 3 AND page_id % 7 <> 6"""
)
def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table as a fetch log with challenge markers put in front."""
    c = F.col
    markers = F.array(
        F.lit("<p>Just a moment...</p>"),
        F.lit("<div class='g-recaptcha'></div><p>are you a human</p>"),
        F.lit("<p>This request was BLOCKED</p>"),
        F.lit("<p>This request was blocked</p>"),
        F.lit("<title>Attention Required! | x</title>"),
        F.lit("<p>Verify you are human</p>"),
        F.lit(""),
    )
    form = c("page_id") % 7
    fetched = data.table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(form == 2, 403).otherwise(200).alias("status"),
        F.concat(F.element_at(markers, (form + 1).cast("int")), c("html")).alias("body"),
    )
    reason = messages.challenge_reason(c("body"), c("status")).alias("reason")
    return fetched.select("page_id", reason).where(c("reason").isNotNull())


@query(
    """SELECT o_orderkey, o_orderkey % 8 IN (0, 3, 6) AS safe FROM orders"""
)
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL frontier with checkout and payment links among ordinary ones."""
    c = F.col
    key = c("o_orderkey").cast("string")
    forms = (
        "https://www.acme.in/offers/",
        "https://www.acme.in/CheckOut/",
        "https://www.acme.in/order/confirm/",
        "https://www.acme.in/orders/list/",
        "https://www.acme.in/pay?order=",
        "https://api.razorpay.example/x/",
        "https://www.acme.in/payless-shoes/",
        "https://www.acme.in/purchase/",
    )
    url = F.concat(
        F.element_at(F.array(*map(F.lit, forms)), (c("o_orderkey") % 8 + 1).cast("int")), key
    )
    return data.table(spark, sf_dir, "orders").select(
        "o_orderkey", urls.is_safe_url(url).alias("safe")
    )


@query(
    """WITH turns AS (SELECT conv_id, turn, text,
      lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    lines AS (SELECT conv_id, turn, before, text,
      list_transform(regexp_split_to_array(coalesce(before, ''), '\\n|\\.[\\t\\n\\x0b\\f\\r \\x{a0}]'),
        lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS old,
      list_transform(regexp_split_to_array(text, '\\n|\\.[\\t\\n\\x0b\\f\\r \\x{a0}]'),
        lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS fresh FROM turns)
    SELECT conv_id, turn, CASE WHEN coalesce(before, '') = '' THEN text
      WHEN starts_with(text, before) THEN substr(text, length(before) + 1)
      ELSE coalesce(array_to_string(list_filter(fresh,
        lambda x: x <> '' AND NOT list_contains(old, x)), ' '), '') END AS added FROM lines"""
)
def new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn adds to the turn before it."""
    c = F.col
    told = data.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    # turns are numbered without gaps, so the one before is found by an equi-join
    # whose keys are unique, however long one conversation is
    earlier = told.select("conv_id", (c("turn") + 1).alias("turn"), c("text").alias("before"))
    turns = told.join(earlier, ["conv_id", "turn"], "left")
    return turns.select(
        "conv_id", "turn", messages.new_text(F.col("before"), F.col("text")).alias("added")
    )


@query(
    """WITH docs AS (SELECT p_partkey AS doc_id, 100 + 20 * p_size AS v, 5 + p_size AS p,
      (p_partkey % 3) AS form FROM part)
    SELECT doc_id, 0::BIGINT AS pos, 'TEXT' || doc_id AS code, 'flat' AS discount_type,
      v::DOUBLE AS discount_value, 'Use code TEXT' || doc_id || ' for ₹' || v || ' off.' AS title
      FROM docs
    UNION ALL SELECT doc_id, 2, NULL, 'sale', p::DOUBLE, 'Acme sale: up to ' || p || '% off.'
      FROM docs
    UNION ALL SELECT doc_id, 3, NULL, 'percentage', p::DOUBLE, 'Extra ' || p || '% off at Acme!'
      FROM docs WHERE form = 1"""
)
def text_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-sentence texts: a coded offer, prose, a sale, a repeated code and a late offer."""
    c = F.col
    part = spread(data.table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    values = {
        "k": c("p_partkey").cast("string"),
        "v": (100 + 20 * c("p_size")).cast("string"),
        "p": (5 + c("p_size")).cast("string"),
    }
    shared = (
        "Use code TEXT{k} for Rs.{v} off. We ship all over the country. "
        "Acme sale: up to {p}% off. "
    )
    forms = [
        data.filled(shared + "Use code TEXT{k} for Rs.{v} off again.", values),
        data.filled(shared + "Extra {p}% off at Acme! Too short.", values),
        data.filled(shared + "Nothing more to say here.", values),
    ]
    docs = part.select(
        c("p_partkey").alias("doc_id"),
        data.choose(c("p_partkey") % 3, forms).alias("text"),
        F.lit(True).alias("about_brand"),
    )
    found = with_source(
        text_candidates(docs, PARAMS), PARAMS, F.lit("texts"), F.lit("https://t.example"), F.lit("other")
    )
    return found.select(
        "doc_id", big("pos"), "code", "discount_type", "discount_value", "title"
    )
