"""Registered queries over claims and offers, with their oracle SQL."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwise.catalog import oracle_base as sql
from offerwise.catalog import projection as data
from offerwise.catalog.projection import PARAMS
from offerwise.catalog.registry import big, query, ts
from offerwise.functions import pricing
from offerwise.functions.text import days_since, hours_since
from offerwise.operators import evidence, history, merge, ranking, report, validation
from offerwise.operators.pricing import price_ladder as ladder_of
from offerwise.operators.pricing import refresh_derived as refreshed
from offerwise.operators.pricing import with_target_analysis
from offerwise.params import Params
from offerwise.plans import discovery, revalidation
from offerwise.plans import report as report_plan

# --- merging -------------------------------------------------------------------


def _term_columns() -> list:
    return [
        "dedupe_key",
        "discount_type",
        "discount_value",
        "minimum_order",
        "minimum_order_known",
        "maximum_discount",
        "is_up_to",
        ts("expiry_date"),
    ]


_TERM_SQL = f"""dedupe_key, kind AS discount_type, val AS discount_value,
  minimum AS minimum_order, minimum IS NOT NULL AS minimum_order_known, cap AS maximum_discount,
  hedged AS is_up_to, {sql.ts('expiry')} AS expiry_date"""


@query(
    f"""{sql.MERGED} SELECT {_TERM_SQL}, code, title, claims, {sql.ts('first_seen')}
    AS first_seen_at, {sql.ts('last_seen')} AS last_seen_at, ever_past AS past_on_arrival
    FROM merged"""
)
def merge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.terms(spark, sf_dir).select(
        *_term_columns(),
        "code",
        "title",
        big("claims"),
        ts("first_seen_at"),
        ts("last_seen_at"),
        F.col("expired_by").isNotNull().alias("past_on_arrival"),
    )


@query(
    f"""{sql.SOURCES} SELECT dedupe_key, source_name,
    'https://' || domain || '/offers' AS source_url,
    CASE WHEN official THEN 'official' ELSE 'coupon-site' END AS source_type,
    domain AS source_domain, {sql.ts('first_seen')} AS discovered_at,
    {sql.ts('last_seen')} AS last_seen_at, kind AS claim_type, val AS claim_value,
    minimum AS claim_minimum, cap AS claim_cap, dead AS reported_expired FROM srcs"""
)
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.sources(spark, sf_dir).select(
        "dedupe_key",
        "source_name",
        "source_url",
        "source_type",
        "source_domain",
        ts("discovered_at"),
        ts("last_seen_at"),
        "claim_type",
        "claim_value",
        "claim_minimum",
        "claim_cap",
        "reported_expired",
    )


@query(f"{sql.EVIDENCE} SELECT dedupe_key, conflict AS conflicting_sources FROM evid")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.conflicts(data.sources(spark, sf_dir))


# Stored state from the claims before the cutoff, then an upsert of the rest.


def _upserted(spark: SparkSession, sf_dir: str) -> discovery.Upserted:
    cutoff = F.lit(data.CUTOFF).cast("timestamp")
    steps = []
    for claims, buckets in data.dealt_claims(spark, sf_dir):
        early = claims.where(F.col("last_seen_at") < cutoff)
        late = claims.where(F.col("last_seen_at") >= cutoff)
        first = discovery.upsert(discovery.empty_store(spark), early, PARAMS, buckets)
        stored = discovery.Stored(first.offers, first.sources)
        steps.append(discovery.upsert(stored, late, PARAMS, buckets))
    return discovery.Upserted(*(reduce(DataFrame.unionByName, held) for held in zip(*steps)))


_CUT = f"TIMESTAMP '{data.CUTOFF} 00:00:00'"
_BOTH = sql.chain(
    sql.claims(),
    sql.merged(),
    sql.sources(),
    sql.evidence(),
    sql.claims("claims0", _CUT),
    sql.merged("merged0", "claims0"),
    sql.sources("srcs0", "claims0"),
    sql.evidence("evid0", "srcs0"),
)
# a status moves to expired when a claim's expiry was past as it arrived
_STATUS = "CASE WHEN {m}.ever_past THEN 'expired' ELSE 'unverified' END"


@query(
    f"""{_BOTH} SELECT {_TERM_SQL}, title, {sql.ts('first_seen')} AS first_seen_at,
    {sql.ts('last_seen')} AS last_seen_at, source_count, has_official AS has_official_source,
    conflict AS conflicting_sources, independent AS independent_sources,
    {_STATUS.format(m='merged')} AS status
    FROM merged JOIN evid USING (dedupe_key)"""
)
def upsert_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).offers.select(
        *_term_columns(),
        "title",
        ts("first_seen_at"),
        ts("last_seen_at"),
        big("source_count"),
        "has_official_source",
        "conflicting_sources",
        big("independent_sources"),
        "status",
    )


@query(
    f"""{sql.EVIDENCE}, {sql.merged()} SELECT dedupe_key, source_count,
    independent AS independent_sources, 'discovered' AS events,
    {_STATUS.format(m='merged')} AS status FROM merged JOIN evid USING (dedupe_key)"""
)
def discovery_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cycle over all claims: upsert, sweep, rescoring, and each offer's events."""
    step = discovery.discovery_cycle(
        discovery.empty_store(spark), data.claims(spark, sf_dir), PARAMS
    )
    told = F.array_join(F.sort_array(F.collect_set("event")), ",").alias("events")
    log = step.observations.groupBy("dedupe_key").agg(told)
    return step.offers.join(log, "dedupe_key", "left").select(
        "dedupe_key", big("source_count"), big("independent_sources"), "events", "status"
    )


def _num(x: str) -> str:
    return f"coalesce(regexp_replace({x}::VARCHAR, '\\.0$', ''), 'unknown')"


def _change(label: str, old: str, new: str, shown) -> str:
    return f"""CASE WHEN {old} IS DISTINCT FROM {new}
      THEN '{label}: ' || {shown(old)} || ' -> ' || {shown(new)} END"""


def _text(x: str) -> str:
    return f"coalesce({x}::VARCHAR, 'unknown')"


def _iso(x: str) -> str:
    return f"coalesce({sql.iso(x)}, 'unknown')"


_CHANGES = ", ".join(
    [
        _change("status", "o.status", "n.status", _text),
        _change("discountType", "o.kind", "n.kind", _text),
        _change("discountValue", "o.val", "n.val", _num),
        _change("minimumOrder", "o.minimum", "n.minimum", _num),
        _change("maximumDiscount", "o.cap", "n.cap", _num),
        _change("isUpTo", "o.hedged", "n.hedged", _text),
        _change("expiryDate", "o.expiry", "n.expiry", _iso),
        _change("sourceCount", "o.source_count", "n.source_count", _text),
    ]
)
_EVENTS = f"""{_BOTH}, old AS (
  SELECT m.*, source_count, {_STATUS.format(m='m')} AS status
  FROM merged0 m JOIN evid0 USING (dedupe_key)
), new AS (
  SELECT m.*, source_count, {_STATUS.format(m='m')} AS status
  FROM merged m JOIN evid USING (dedupe_key)
), touched AS (
  SELECT dedupe_key, arg_max(source_name, seq) AS last_source,
    arg_min(source_name, seq) AS first_source
  FROM claims WHERE seen >= {_CUT} GROUP BY dedupe_key
), diffs AS (
  SELECT n.dedupe_key, o.dedupe_key IS NULL AS is_new, o.status AS old_status,
    n.status AS new_status, n.kind, n.val,
    CASE WHEN o.dedupe_key IS NULL THEN first_source ELSE last_source END AS source_name,
    CASE WHEN o.dedupe_key IS NOT NULL THEN
      array_to_string(list_filter([{_CHANGES}], lambda x: x IS NOT NULL), '; ') END AS changes
  FROM new n JOIN touched USING (dedupe_key) LEFT JOIN old o ON o.dedupe_key = n.dedupe_key
), events AS (
  SELECT *, CASE WHEN is_new THEN 'discovered' WHEN changes = '' THEN 'rediscovered'
    WHEN old_status <> new_status THEN 'status_changed' ELSE 'terms_changed' END AS event
  FROM diffs
)"""


@query(
    f"""{_EVENTS} SELECT dedupe_key, event, new_status AS status, source_name,
    CASE WHEN event = 'status_changed' THEN old_status END AS previous_status,
    kind AS discount_type, val AS discount_value, '2001-11-05 00:00:00' AS observed_at
    FROM events"""
)
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).observations.select(
        "dedupe_key",
        "event",
        "status",
        "source_name",
        "previous_status",
        "discount_type",
        "discount_value",
        ts("observed_at"),
    )


@query(
    f"""{_EVENTS} SELECT events.dedupe_key, event, title, new_status AS current_status
    FROM events JOIN merged USING (dedupe_key)"""
)
def observed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of an upsert with the offers it speaks of."""
    step = _upserted(spark, sf_dir)
    return history.with_offer(step.observations, step.offers).select(
        "dedupe_key", "event", "title", "current_status"
    )


@query(f"{_EVENTS} SELECT dedupe_key, event, coalesce(nullif(changes, ''), 'none') AS changes FROM events")
def term_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).result.select(
        "dedupe_key",
        "event",
        F.coalesce(F.array_join("changes", "; "), F.lit("none")).alias("changes"),
    )


@query(
    f"""{_EVENTS} SELECT (SELECT count(*) FROM claims WHERE seen >= {_CUT}) AS total_candidates,
    (SELECT count(*) FROM (SELECT DISTINCT dedupe_key, source_name FROM claims
      WHERE seen >= {_CUT})) AS unique_candidates,
    count(*) FILTER (is_new) AS new_offers, count(*) FILTER (NOT is_new) AS updated_offers,
    count(*) FILTER (NOT is_new AND changes <> '') AS changed_offers,
    -- an end date that is past when it is claimed expires the offer at once
    0::BIGINT AS expired_offers FROM events"""
)
def cycle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-cycle totals; the upsert reads all claims, as duplicates within a cycle
    would otherwise hide intermediate terms from the comparison."""
    late = data.claims(spark, sf_dir).where(
        F.col("last_seen_at") >= F.lit(data.CUTOFF).cast("timestamp")
    )
    unique = discovery.claims_of(late)
    step = _upserted(spark, sf_dir)
    swept = validation.expire_sweep(step.offers, PARAMS)
    return discovery.cycle_stats(late, unique, step.result, swept)


# --- evidence ------------------------------------------------------------------


@query(f"{sql.EVIDENCE} SELECT dedupe_key, independent AS independent_sources FROM evid")
def independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.independent_sources(data.sources(spark, sf_dir), PARAMS)


_REPORTS = sql.chain(sql.claims(), sql.sources(), sql.evidence(report_days=365))


@query(
    f"""{_REPORTS} SELECT dedupe_key, reports AS recent_expiry_reports,
    report_domains AS reporting_domains,
    report_domain IS NOT NULL OR report_domains >= 2 AS reliable,
    CASE WHEN report_domain IS NOT NULL THEN
      'official page lists this offer as expired (https://' || report_domain || '/offers)'
    WHEN report_domains >= 2 THEN
      report_domains || ' independent sources report this offer as expired'
    ELSE '1 source reports this offer as expired (not sufficient on its own)' END AS detail
    FROM evid WHERE reports > 0"""
)
def expiry_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = replace(PARAMS, expiry_report_days=365)
    return evidence.expiry_reports(data.sources(spark, sf_dir), yearly)


@query(f"{sql.OFFERS} SELECT dedupe_key, confidence::BIGINT AS confidence FROM offers")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _ = data.offers(spark, sf_dir)
    return snapshot.select("dedupe_key", big("confidence"))


_FACTORS = f"""[
  CASE WHEN accepted >= {sql.NOW} - INTERVAL 48 HOUR THEN
    ('accepted by legitimate cart validation', 50) END,
  CASE WHEN official_seen >= {sql.NOW} - INTERVAL 7 DAY OR first_official THEN
    ('current official ACME source', 35) END,
  CASE WHEN independent >= 2 THEN ('second independent recent source', 10) END,
  CASE WHEN independent >= 3 THEN ('third independent recent source', 5) END,
  CASE WHEN last_seen >= {sql.NOW} - INTERVAL 24 HOUR THEN ('seen within 24 hours', 10) END,
  CASE WHEN last_seen < {sql.NOW} - INTERVAL 24 HOUR AND last_seen >= {sql.NOW} - INTERVAL 7 DAY
    THEN ('seen within 7 days', 5) END,
  CASE WHEN last_seen < {sql.NOW} - INTERVAL 30 DAY THEN ('not seen for over 30 days', -20) END,
  CASE WHEN conflict THEN ('sources disagree on the offer terms', -20) END,
  CASE WHEN dead THEN ('reported expired by a source', -50) END,
  CASE WHEN NOT dead AND expiry < {sql.NOW} THEN ('past its published expiry date', -50) END]"""


@query(
    f"""{sql.OFFERS}, factors AS (SELECT dedupe_key, unnest({_FACTORS}) AS f FROM offers)
    SELECT dedupe_key, f[1] AS label, f[2]::BIGINT AS points FROM factors WHERE f IS NOT NULL"""
)
def confidence_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _ = data.offers(spark, sf_dir)
    return snapshot.select(
        "dedupe_key", F.inline(evidence.confidence_factors(PARAMS))
    ).withColumn("points", big("points"))


@query(
    f"""{sql.SOURCES} SELECT dedupe_key, source_name AS name,
    'https://' || domain || '/offers' AS url,
    CASE WHEN official THEN 'official' ELSE 'coupon-site' END AS type,
    {sql.iso('first_seen')} AS "discoveredAt", {sql.iso('last_seen')} AS "lastSeenAt",
    dead AS "reportedExpired" FROM srcs"""
)
def source_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.source_lineage(data.sources(spark, sf_dir)).drop("arrived_at", "first_seq")


# --- pricing -------------------------------------------------------------------

_STEPS = ", ".join(str(int(v)) for v in PARAMS.full_ladder)


@query(
    f"""{sql.MERGED}, steps AS (
      SELECT *, {sql.raw_discount('cart')} AS raw
      FROM merged, (SELECT unnest([{_STEPS}]) AS cart))
    SELECT dedupe_key, cart::DOUBLE AS cart_value, {sql.round2('raw')} AS discount,
      {sql.round2('cart - raw')} AS final_price, {sql.round2('raw / cart')} AS effective_discount,
      raw > 0 AS applicable,
      CASE WHEN cart < minimum THEN 'cart below published minimum order of ' || {_num('minimum')}
        WHEN hedged THEN 'advertised as "up to" - no guaranteed discount for a specific cart'
        WHEN kind = 'flat' AND val IS NULL THEN 'flat discount value unknown'
        WHEN kind = 'percentage' AND val IS NULL THEN 'percentage value unknown'
        WHEN kind = 'sale' THEN 'store-wide sale, not a cart-level coupon discount'
        WHEN kind = 'cashback' THEN
          'cashback is paid after purchase and does not reduce the amount payable'
        WHEN kind = 'unknown' THEN 'offer terms could not be parsed' END AS reason
    FROM steps"""
)
def price_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder_of(data.terms(spark, sf_dir), PARAMS)


_ANALYSIS = f"""{sql.OFFERS} SELECT dedupe_key, discount AS discount_at_target,
    CASE WHEN applicable THEN pay END AS final_price_at_target,
    eff AS effective_discount_at_target, hits AND doubt IS NULL AS target_match"""


@query(
    f"""{_ANALYSIS}, hits AND doubt IS NOT NULL AS potential_target_match,
    doubt IS NOT NULL AS uncertain, doubt AS uncertainty_reason FROM offers"""
)
def target_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_target_analysis(data.terms(spark, sf_dir), PARAMS).select(
        "dedupe_key",
        "discount_at_target",
        "final_price_at_target",
        "effective_discount_at_target",
        "target_match",
        "potential_target_match",
        "uncertain",
        "uncertainty_reason",
    )


@query(f"{_ANALYSIS}, confidence::BIGINT AS confidence FROM offers")
def refresh_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _ = data.offers(spark, sf_dir)
    return snapshot.select(
        "dedupe_key",
        "discount_at_target",
        "final_price_at_target",
        "effective_discount_at_target",
        "target_match",
        big("confidence"),
    )


def _sql_amount(x: str) -> str:
    """Amounts up to 99,999 with Indian grouping (one comma)."""
    return f"""CASE WHEN {x} <> floor({x}) THEN printf('%.2f', {x})
      WHEN {x} >= 1000 THEN ({x}::BIGINT // 1000) || ',' || lpad(({x}::BIGINT % 1000)::VARCHAR, 3, '0')
      ELSE {x}::BIGINT::VARCHAR END"""


_LABEL = f"""CASE kind
  WHEN 'flat' THEN coalesce(up || '₹' || {_sql_amount('val')} || ' OFF', 'FLAT OFF (value unknown)')
  WHEN 'percentage' THEN coalesce(up || val::BIGINT || '% OFF', 'PERCENT OFF (value unknown)')
  WHEN 'sale' THEN coalesce(up || val::BIGINT || '% SALE', 'SALE')
  WHEN 'cashback' THEN coalesce(up || '₹' || {_sql_amount('val')} || ' CASHBACK', 'CASHBACK')
  ELSE 'UNKNOWN OFFER' END"""


@query(
    f"""{sql.MERGED}, prefixed AS (
      SELECT *, CASE WHEN hedged THEN 'UP TO ' ELSE '' END AS up FROM merged)
    SELECT dedupe_key, {_LABEL} AS label,
      coalesce('₹' || {_sql_amount('minimum')}, '-') AS minimum_label,
      '₹' || CASE length(big) WHEN 7 THEN big[1:2] || ',' || big[3:4] || ',' || big[5:7]
        WHEN 6 THEN big[1:1] || ',' || big[2:3] || ',' || big[4:6]
        WHEN 5 THEN big[1:2] || ',' || big[3:5]
        WHEN 4 THEN big[1:1] || ',' || big[2:4] ELSE big END AS large_amount_label,
      CASE WHEN val IS NULL THEN {_LABEL}
        WHEN kind IN ('percentage', 'sale') THEN lower(up) || {_num('val')} || '%'
        ELSE lower(up) || '₹' || {_sql_amount('val')} END AS discount_label
    FROM (SELECT *, (claims * 1009 * k % 10000000)::VARCHAR AS big FROM prefixed)"""
)
def offer_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    big_amount = (
        F.col("claims") * 1009 * data.part_of(F.col("dedupe_key")) % 10_000_000
    ).cast("double")
    return data.terms(spark, sf_dir).select(
        "dedupe_key",
        pricing.offer_label().alias("label"),
        pricing.format_rupees(F.col("minimum_order")).alias("minimum_label"),
        pricing.format_rupees(big_amount).alias("large_amount_label"),
        pricing.describe_discount().alias("discount_label"),
    )


# --- ranking -------------------------------------------------------------------


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _ = data.offers(spark, sf_dir)
    return ranking.rank_offers(snapshot, PARAMS)


@query(
    f"""{sql.OFFERS} SELECT row_number() OVER (ORDER BY {sql.RANKING}) AS position,
    dedupe_key, status, CASE WHEN applicable THEN pay END AS final_price_at_target,
    confidence::BIGINT AS confidence FROM offers"""
)
def rank_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global positions without gathering the sorted offers in one task."""
    ordered = _ranked(spark, sf_dir).select(
        "dedupe_key", "status", "final_price_at_target", big("confidence")
    )
    return ranking.numbered(ordered)


@query(
    f"""{sql.OFFERS} SELECT dedupe_key, code, pay AS final_price_at_target,
    confidence::BIGINT AS confidence FROM offers WHERE status = 'valid'
    ORDER BY {sql.RANKING} LIMIT 1"""
)
def best_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_offer(_ranked(spark, sf_dir)).select(
        "dedupe_key", "code", "final_price_at_target", big("confidence")
    )


@query(
    f"""{sql.OFFERS} SELECT dedupe_key, CASE WHEN doubt IS NULL THEN 'TARGET_MATCH'
    ELSE 'POTENTIAL_TARGET_MATCH' END AS tag, doubt AS uncertainty_reason FROM offers WHERE hits"""
)
def target_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysed = with_target_analysis(data.terms(spark, sf_dir), PARAMS)
    strict = ranking.target_matches(analysed).withColumn("tag", F.lit("TARGET_MATCH"))
    loose = ranking.target_matches(analysed, potential=True).withColumn(
        "tag", F.lit("POTENTIAL_TARGET_MATCH")
    )
    return strict.unionByName(loose).select("dedupe_key", "tag", "uncertainty_reason")


@query(
    f"""{sql.OFFERS} SELECT dedupe_key, doubt AS uncertainty_reason FROM offers
    WHERE hits AND doubt IS NOT NULL ORDER BY {sql.RANKING} LIMIT 10"""
)
def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.near_misses(_ranked(spark, sf_dir)).select("dedupe_key", "uncertainty_reason")


_STATUS_LIST = "(SELECT unnest(['valid','manual_validation_required','unverified','invalid','expired']) AS status)"


@query(
    f"""{sql.OFFERS}, counted AS (SELECT status, count(*) AS n FROM offers GROUP BY status)
    SELECT s.status, coalesce(n, 0)::BIGINT AS offers FROM {_STATUS_LIST} s
      LEFT JOIN counted USING (status)
    UNION ALL SELECT 'total', count(*) FROM offers"""
)
def count_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _ = data.offers(spark, sf_dir)
    return ranking.count_by_status(snapshot)


@query(
    f"""{sql.OFFERS}, placed AS (SELECT status, dedupe_key,
      row_number() OVER (PARTITION BY status ORDER BY {sql.RANKING}) AS place,
      count(*) OVER (PARTITION BY status) AS group_size FROM offers)
    SELECT status, dedupe_key, place, group_size, greatest(0, group_size - 20) AS overflow
    FROM placed WHERE place <= 20"""
)
def report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_per_status(_ranked(spark, sf_dir)).select(
        "status", "dedupe_key", big("place"), big("group_size"), big("overflow")
    )


@query(
    f"""{sql.OFFERS}, prefixed AS (
      SELECT *, CASE WHEN hedged THEN 'UP TO ' ELSE '' END AS up,
        row_number() OVER (ORDER BY {sql.RANKING}) AS place FROM offers
      WHERE status IN ('valid', 'manual_validation_required'))
    SELECT place, code, {_LABEL} || CASE WHEN hits AND doubt IS NULL THEN ' *TARGET*' ELSE '' END
      AS offer, coalesce('₹' || {_sql_amount('minimum')}, '?') AS minimum,
      CASE WHEN applicable THEN '₹' || {_sql_amount('pay')} ELSE '-' END AS payable,
      upper(status) AS status, confidence::BIGINT AS confidence
    FROM prefixed WHERE place <= 25"""
)
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scan_summary(_ranked(spark, sf_dir), PARAMS).withColumn("place", big("place"))


@query(f"{sql.OFFERS} SELECT dedupe_key, status FROM offers WHERE status = 'unverified'")
def offers_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _ = data.offers(spark, sf_dir)
    return snapshot.where(F.col("status") == "unverified").select("dedupe_key", "status")


# --- validation ----------------------------------------------------------------

_AGE = f"(epoch({sql.NOW}) - epoch(validated)) / 3600.0"
_DUE = f"""(status <> 'expired' AND (coalesce(expiry < {sql.NOW}, false) OR validated IS NULL OR
  {_AGE} >= CASE status WHEN 'valid' THEN 24 WHEN 'invalid' THEN 72 ELSE 6 END))"""


@query(
    f"""{sql.OFFERS} SELECT dedupe_key, coalesce({_AGE}, 1e9) AS hours_since_validation,
    (epoch({sql.NOW}) - epoch(last_seen)) / 86400.0 AS days_since_seen FROM offers"""
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _ = data.offers(spark, sf_dir)
    now = PARAMS.now_col()
    age = hours_since(F.col("last_validated_at"), now)
    return snapshot.select(
        "dedupe_key",
        F.when(age == float("inf"), 1e9).otherwise(age).alias("hours_since_validation"),
        days_since(F.col("last_seen_at"), now).alias("days_since_seen"),
    )


@query(f"{sql.OFFERS} SELECT dedupe_key, status, {_DUE} AS due FROM offers")
def validation_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _ = data.offers(spark, sf_dir)
    return snapshot.select("dedupe_key", "status", validation.is_due(PARAMS).alias("due"))


_QUEUE = f"""{sql.OFFERS}, queue AS (
  SELECT * FROM offers WHERE status <> 'expired' AND {_DUE} ORDER BY {sql.QUEUE} LIMIT 40)"""
_ELIGIBLE = f"(NOT coalesce(expiry < {sql.NOW}, false) AND current_seen IS NULL)"


@query(f"{_QUEUE} SELECT dedupe_key, status, confidence::BIGINT AS confidence FROM queue")
def validation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _ = data.offers(spark, sf_dir)
    return validation.validation_queue(snapshot, PARAMS).select(
        "dedupe_key", "status", big("confidence")
    )


@query(
    f"{_QUEUE} SELECT dedupe_key, code FROM queue WHERE {_ELIGIBLE} ORDER BY {sql.QUEUE} LIMIT 5"
)
def check_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, _ = data.offers(spark, sf_dir)
    queue = validation.validation_queue(snapshot, PARAMS)
    return validation.check_budget(queue, PARAMS).select("dedupe_key", "code")


# coupon-field messages per part, by part number modulo 6
MESSAGES = (
    "Coupon applied! You saved ₹{v} on this order",
    "Invalid coupon code",
    "Minimum order value ₹{m} required",
    "Please sign in to continue. Invalid coupon code",
    "Your bag is ready. Continue shopping.",
    "Add more items, spend ₹{v} more. Min spend ₹{m}",
)


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    part = data.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    values = {
        "v": (100 + 20 * c("p_size")).cast("string"),
        "m": pricing.format_amount((500 + 10 * c("p_size")).cast("double")),
    }
    made = part.select(
        F.concat(F.lit("PART"), c("p_partkey").cast("string")).alias("code"),
        data.choose(c("p_partkey") % 6, [data.filled(m, values) for m in MESSAGES]).alias(
            "message"
        ),
    )
    return made.repartition("code")  # offers are joined by code, and few splits would hold all parts


_V, _M = "(100 + 20 * p_size)", "(500 + 10 * p_size)"
_CHECKS = f"""checks AS (SELECT p_partkey AS check_k, 'PART' || p_partkey AS check_code,
  ['accepted', 'rejected', 'conditional', 'blocked', 'unavailable', 'conditional'][p_partkey % 6 + 1]
    AS verdict,
  CASE p_partkey % 6
    WHEN 0 THEN 'coupon field accepted PART' || p_partkey || ': Coupon applied! You saved ₹' || {_V}
      || ' on this order'
    WHEN 1 THEN 'coupon field rejected PART' || p_partkey
    WHEN 2 THEN 'code recognised but conditions unmet: Minimum order value ₹' || {_sql_amount(_M)}
      || ' required'
    WHEN 3 THEN 'sign-in / OTP / verification requested after applying the code'
    WHEN 4 THEN 'response could not be interpreted with confidence'
    ELSE 'code recognised but conditions unmet: Add more items, spend ₹' || {_V}
      || ' more. Min spend ₹' || {_sql_amount(_M)} END AS detail,
  CASE WHEN p_partkey % 6 IN (2, 5) THEN {_M}::DOUBLE END AS observed_minimum,
  CASE WHEN p_partkey % 6 = 0 THEN {_V}::DOUBLE END AS observed_value,
  CASE WHEN p_partkey % 6 = 0 THEN 'flat' END AS observed_type FROM part)"""


@query(
    f"""WITH {_CHECKS} SELECT check_code AS code, verdict, detail, observed_minimum,
    observed_value, observed_type FROM checks"""
)
def check_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.check_verdicts(checks(spark, sf_dir))


_NOTE = """concat_ws('; ',
  'the customer-facing coupon field could not be reached (empty guest cart, sign-in wall or anti-bot protection)',
  independent || ' independent recent third-party source(s) publish it; copies between coupon sites are not treated as confirmation',
  CASE WHEN hedged THEN 'advertised as an "up to" offer, so the real value is unknown' END,
  CASE WHEN report_domain IS NOT NULL THEN
      'official page lists this offer as expired (https://' || report_domain || '/offers)'
    WHEN report_domains >= 2 THEN report_domains || ' independent sources report this offer as expired'
    WHEN reports > 0 THEN '1 source reports this offer as expired (not sufficient on its own)' END)"""


def _judged(src: str, checked: str) -> str:
    """Outcome columns of offers in ``src`` joined to checks; ``checked`` gates the verdict."""
    gate = f"({_ELIGIBLE} AND {checked})"
    return f"""judged AS (SELECT *,
      CASE WHEN expiry < {sql.NOW} THEN 'expired' WHEN current_seen IS NOT NULL THEN 'valid'
        WHEN {gate} AND verdict = 'accepted' THEN 'valid'
        WHEN {gate} AND verdict = 'rejected' THEN 'invalid'
        WHEN {gate} AND verdict IN ('conditional', 'blocked') THEN 'manual_validation_required'
        WHEN report_domain IS NOT NULL OR report_domains >= 2 THEN 'invalid'
        ELSE 'unverified' END AS outcome_status,
      CASE WHEN expiry < {sql.NOW} THEN 'expiry-date'
        WHEN current_seen IS NOT NULL THEN 'official-publication'
        WHEN {gate} AND verdict <> 'unavailable' THEN 'cart-coupon-field'
        WHEN report_domain IS NOT NULL OR report_domains >= 2 THEN 'source-expiry-reports'
        ELSE 'public-sources-only' END AS outcome_method,
      CASE WHEN expiry < {sql.NOW} THEN 'published expiry ' || {sql.iso('expiry')} || ' has passed'
        WHEN current_seen IS NOT NULL THEN 'still published on an official ACME India page ('
          || current_url || ', last seen ' || {sql.iso('current_seen')} || ')'
        WHEN {gate} AND verdict = 'conditional' THEN
          detail || ' - a qualifying cart is required to confirm'
        WHEN {gate} AND verdict = 'blocked' THEN detail || '; validation stops here by policy'
        WHEN {gate} AND verdict <> 'unavailable' THEN detail
        WHEN report_domain IS NOT NULL THEN
          'official page lists this offer as expired (https://' || report_domain || '/offers)'
        WHEN report_domains >= 2 THEN
          report_domains || ' independent sources report this offer as expired'
        ELSE {_NOTE} END AS outcome_notes
    FROM {src} LEFT JOIN checks ON check_k = k
      LEFT JOIN current_urls USING (dedupe_key))"""


# the official URL behind current_seen: latest sighting, then earliest arrival
_CURRENT = f"""current_urls AS (
  SELECT dedupe_key, 'https://' || arg_min(domain, (-epoch(last_seen), first_seq)) || '/offers'
    AS current_url FROM srcs
  WHERE official AND NOT dead AND last_seen >= {sql.NOW} - INTERVAL 48 HOUR GROUP BY dedupe_key)"""


@query(
    f"""{sql.OFFERS}, {_CHECKS}, {_CURRENT}, {_judged('offers', 'true')}
    SELECT dedupe_key, outcome_status, outcome_method, outcome_notes,
      outcome_method = 'cart-coupon-field' AND outcome_status = 'valid' AS accepted_by_cart
    FROM judged"""
)
def validity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over every offer, each with its code's check."""
    snapshot, _ = data.offers(spark, sf_dir)
    verdicts = validation.check_verdicts(checks(spark, sf_dir))
    judged = validation.cascade(snapshot.join(verdicts, "code", "left"), PARAMS)
    return judged.select(
        "dedupe_key", "outcome_status", "outcome_method", "outcome_notes", "accepted_by_cart"
    )


_APPLIED = f"""{sql.OFFERS}, {_CHECKS}, {_CURRENT}, {_judged('offers', 'true')}"""


@query(
    f"""{_APPLIED}, applied AS (
      SELECT * REPLACE (
          CASE WHEN outcome_method = 'cart-coupon-field' THEN coalesce(observed_minimum, minimum)
            ELSE minimum END AS minimum,
          CASE WHEN outcome_method = 'cart-coupon-field' THEN coalesce(observed_value, val)
            ELSE val END AS val,
          CASE WHEN outcome_method = 'cart-coupon-field' THEN coalesce(observed_type, kind)
            ELSE kind END AS kind),
        attempts + 1 AS new_attempts, status AS previous_status FROM judged),
    priced AS (SELECT *, {sql.raw_discount('1000')} AS new_discount FROM applied)
    SELECT dedupe_key, outcome_status AS status, outcome_method AS validation_method,
      left(outcome_notes, 1000) AS validation_notes, new_attempts::BIGINT AS validation_attempts,
      kind AS discount_type, val AS discount_value, minimum AS minimum_order,
      {sql.round2('new_discount')} AS discount_at_target,
      CASE WHEN outcome_status = previous_status THEN 'validated' ELSE 'status_changed' END AS event,
      left(outcome_status || ': ' || outcome_notes, 500) AS validation_result FROM priced"""
)
def apply_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes written onto every offer and its derived columns refreshed."""
    snapshot, _ = data.offers(spark, sf_dir)
    verdicts = validation.check_verdicts(checks(spark, sf_dir))
    judged = validation.cascade(snapshot.join(verdicts, "code", "left"), PARAMS)
    applied = refreshed(validation.apply_outcome(judged, PARAMS), PARAMS)
    return applied.select(
        "dedupe_key",
        "status",
        "validation_method",
        "validation_notes",
        big("validation_attempts"),
        "discount_type",
        "discount_value",
        "minimum_order",
        "discount_at_target",
        "event",
        "validation_result",
    )


@query(
    f"""{_QUEUE}, {_CHECKS}, {_CURRENT}, budget AS (
      SELECT dedupe_key AS budget_key FROM queue WHERE {_ELIGIBLE} ORDER BY {sql.QUEUE} LIMIT 5),
    {_judged('queue', 'dedupe_key IN (SELECT budget_key FROM budget)')},
    counted AS (SELECT outcome_status AS status, count(*) AS n,
      count(*) FILTER (dedupe_key IN (SELECT budget_key FROM budget)) AS used
      FROM judged GROUP BY outcome_status)
    SELECT s.status, coalesce(n, 0)::BIGINT AS offers, coalesce(used, 0)::BIGINT AS checks_used
    FROM {_STATUS_LIST} s LEFT JOIN counted USING (status)"""
)
def validation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One validation cycle: queue, budget, cascade, statistics."""
    snapshot, found = data.stored(spark, sf_dir)
    cycle = revalidation.revalidate(snapshot, found, checks(spark, sf_dir), PARAMS)
    return revalidation.validation_stats(cycle.outcomes)


_LATER = f"({sql.NOW} + INTERVAL 100 DAY)"


@query(
    f"""{sql.OFFERS} SELECT dedupe_key, 'expired' AS status, status AS previous_status,
    'expiry-date' AS validation_method,
    'published expiry ' || {sql.iso('expiry')} || ' has passed' AS validation_notes
    FROM offers WHERE expiry < {_LATER} AND status <> 'expired'"""
)
def expire_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep 100 days on: offers whose expiry has passed meanwhile."""
    snapshot, _ = data.offers(spark, sf_dir)
    return validation.expire_sweep(snapshot, _later()).select(
        "dedupe_key", "status", "previous_status", "validation_method", "validation_notes"
    )


def _later() -> Params:
    return replace(PARAMS, now=data.NOW + dt.timedelta(days=100))


_OFFERS_LATER = f"""{sql.OFFERS}, later_evid AS (
  SELECT dedupe_key, count(DISTINCT norm) FILTER
    (NOT official AND last_seen >= {_LATER} - INTERVAL 30 DAY) AS independent_later
  FROM srcs GROUP BY dedupe_key),
later AS (SELECT *, greatest(0, least(100,
      CASE WHEN accepted >= {_LATER} - INTERVAL 48 HOUR THEN 50 ELSE 0 END
      + CASE WHEN official_seen >= {_LATER} - INTERVAL 7 DAY THEN 35 ELSE 0 END
      + CASE WHEN independent_later >= 2 THEN 10 ELSE 0 END
      + CASE WHEN independent_later >= 3 THEN 5 ELSE 0 END
      + CASE WHEN last_seen >= {_LATER} - INTERVAL 24 HOUR THEN 10
             WHEN last_seen >= {_LATER} - INTERVAL 7 DAY THEN 5 ELSE 0 END
      - CASE WHEN last_seen < {_LATER} - INTERVAL 30 DAY THEN 20 ELSE 0 END
      - CASE WHEN conflict THEN 20 ELSE 0 END
      - CASE WHEN dead OR expiry < {_LATER} THEN 50 ELSE 0 END)) AS confidence_later
  FROM offers JOIN later_evid USING (dedupe_key))"""


@query(
    f"""{_OFFERS_LATER} SELECT dedupe_key, confidence::BIGINT AS previous_confidence,
    confidence_later::BIGINT AS confidence FROM later
    WHERE abs(confidence_later - confidence) >= 5"""
)
def rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence that moved by 5 or more over the following 100 days."""
    snapshot, found = data.offers(spark, sf_dir, with_sources=True)
    later = _later()
    decayed = refreshed(evidence.attach_evidence(snapshot, found, later), later)
    return validation.rescore(snapshot, decayed).select(
        "dedupe_key", big("previous_confidence"), big("confidence")
    )


# --- reports -------------------------------------------------------------------


def _report(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = report.LINEAGE) -> DataFrame:
    """Report rows with the nested lineage, of which ``fields`` are read."""
    snapshot, found = data.offers(spark, sf_dir, with_sources=True)
    ranked = ranking.rank_offers(snapshot, PARAMS)
    nested = report.nested_sources(snapshot, found, PARAMS, fields)
    return report.report_rows(ranked.join(nested, "dedupe_key", "left"), PARAMS, ("sources",))


def _cents(x: str) -> str:
    return f"({x})::DECIMAL(18, 2)::VARCHAR"


def _step(cart: float) -> str:
    off = sql.raw_discount(f"{cart:g}")
    pay = sql.round2(f"{cart:g} - {off}")
    return f"{_cents(f'{cart:g}')} || ' - ' || {_cents(sql.round2(off))} || ' = ' || {_cents(pay)}"


_STEPS = ", ".join(_step(cart) for cart in PARAMS.full_ladder)


@query(
    f"""{sql.OFFERS}, listed AS (
      SELECT dedupe_key, label, n FROM (
        SELECT dedupe_key, label, row_number() OVER (PARTITION BY dedupe_key ORDER BY first_seq) AS n
        FROM (SELECT dedupe_key, source_name || '(' || CASE WHEN official THEN 'official'
            ELSE 'coupon-site' END || ')' AS label, first_seq FROM srcs)) WHERE n <= 6),
    summed AS (SELECT dedupe_key, string_agg(label, ', ' ORDER BY n) AS source_summary
      FROM listed GROUP BY dedupe_key)
    SELECT dedupe_key, status, discount_at, price, "expiryDate", "lastSeenAt", validated_label,
      "officialConfirmedAt", source_summary, ladder
    FROM (SELECT dedupe_key, status, discount AS discount_at,
      CASE WHEN applicable THEN pay END AS price, {sql.iso('expiry')} AS "expiryDate",
      {sql.iso('last_seen')} AS "lastSeenAt",
      coalesce(strftime(validated + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') || ' IST', 'never')
        AS validated_label,
      {sql.iso('greatest(official_seen, CASE WHEN first_official THEN ' + sql.NOW + ' END)')}
        AS "officialConfirmedAt", concat_ws('; ', {_STEPS}) AS ladder
      FROM offers)
    JOIN summed USING (dedupe_key)"""
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, found = data.offers(spark, sf_dir, with_sources=True)
    ranked = report.with_labels(ranking.rank_offers(snapshot, PARAMS), PARAMS)
    rows = report.report_rows(ranked, PARAMS, ("validated_label",))
    cents = lambda x: x.cast("decimal(18,2)").cast("string")
    steps = F.transform(
        "cartValueAnalysis",
        lambda s: F.concat(
            cents(s["cartValue"]), F.lit(" - "), cents(s["discount"]), F.lit(" = "), cents(s["finalPrice"])
        ),
    )
    return rows.join(report.source_summary(found), "dedupe_key").select(
        "dedupe_key",
        "status",
        F.col("discountAtTarget").alias("discount_at"),
        F.col("finalPriceAtTarget").alias("price"),
        "expiryDate",
        "lastSeenAt",
        "validated_label",
        "officialConfirmedAt",
        "source_summary",
        F.array_join(steps, "; ").alias("ladder"),
    )


_LISTED = """dedupe_key, code, title, status, kind AS "discountType", val AS "discountValue",
  discount AS "discountAtTarget", CASE WHEN applicable THEN pay END AS "finalPriceAtTarget",
  doubt AS "uncertaintyReason", independent AS "independentSources", confidence::BIGINT AS confidence"""


@query(
    f"""{sql.OFFERS}
    SELECT 'best' AS list, {_LISTED} FROM (SELECT * FROM offers WHERE status = 'valid' ORDER BY {sql.RANKING} LIMIT 1)
    UNION ALL SELECT 'targetMatches', {_LISTED} FROM offers WHERE hits AND doubt IS NULL
    UNION ALL SELECT 'potentialTargetMatches', {_LISTED} FROM offers WHERE hits AND doubt IS NOT NULL"""
)
def report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as it is assembled: the best offer and both target lists, in whole rows."""
    shown = report_plan.build(*data.offers(spark, sf_dir, with_sources=True), PARAMS)
    return report.report_lists(shown.best, shown.target_matches, shown.potential_target_matches, PARAMS).select(
        "list",
        "dedupe_key",
        "code",
        "title",
        "status",
        "discountType",
        "discountValue",
        "discountAtTarget",
        "finalPriceAtTarget",
        "uncertaintyReason",
        "independentSources",
        big("confidence"),
    )


@query(
    f"""{sql.OFFERS}, nested AS (
      SELECT dedupe_key, count(*) AS n, arg_min(source_name, first_seq) AS first_name,
        arg_max(source_name, first_seq) AS last_name FROM srcs GROUP BY dedupe_key)
    SELECT dedupe_key, code, status, discount AS discount_at,
      CASE WHEN applicable THEN pay END AS price, doubt AS reason, n AS sources, first_name,
      last_name, confidence::BIGINT AS confidence
    FROM offers JOIN nested USING (dedupe_key)"""
)
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON rows read back by path, so the text itself is compared."""
    rows = report.json_rows(_report(spark, sf_dir))
    at = lambda path: F.get_json_object("json", f"$.{path}")
    schema = "sources array<struct<name:string>>"
    names = F.transform(F.from_json("json", schema)["sources"], lambda s: s["name"])
    return rows.select(
        "dedupe_key",
        at("code").alias("code"),
        at("status").alias("status"),
        at("discountAtTarget").cast("double").alias("discount_at"),
        at("finalPriceAtTarget").cast("double").alias("price"),
        at("uncertaintyReason").alias("reason"),
        big(F.size(names), "sources"),
        F.get(names, F.lit(0)).alias("first_name"),
        F.element_at(names, -1).alias("last_name"),
        big(at("confidence"), "confidence"),
    )


def _cell(x: str) -> str:
    """A number as the CSV report prints it."""
    return f"coalesce(regexp_replace(({x})::VARCHAR, '\\.0$', ''), '')"


@query(
    f"""{sql.OFFERS}, nested AS (
      SELECT dedupe_key, string_agg(source_name || '|https://' || domain || '/offers', ' ; '
        ORDER BY first_seq) AS sources FROM srcs GROUP BY dedupe_key)
    SELECT code, title, status, confidence::VARCHAR AS confidence, kind AS "discountType",
      {_cell('val')} AS "discountValue", hedged::VARCHAR AS "isUpTo",
      {_cell('minimum')} AS "minimumOrder", (minimum IS NOT NULL)::VARCHAR AS "minimumOrderKnown",
      {_cell('cap')} AS "maximumDiscount", {_cell('discount')} AS "discountAtTarget",
      {_cell('CASE WHEN applicable THEN pay END')} AS "finalPriceAtTarget",
      {_cell('eff')} AS "effectiveDiscountAtTarget",
      (hits AND doubt IS NULL)::VARCHAR AS "targetMatch",
      (hits AND doubt IS NOT NULL)::VARCHAR AS "potentialTargetMatch",
      coalesce(doubt, '') AS "uncertaintyReason", '' AS "newUsersOnly", '' AS "appOnly",
      '' AS "selectedUsersOnly", '' AS "selectedProductsOnly", '' AS "firstOrderOnly",
      coalesce({sql.iso('expiry')}, '') AS "expiryDate", {sql.iso('first_seen')} AS "firstSeenAt",
      {sql.iso('last_seen')} AS "lastSeenAt", coalesce({sql.iso('validated')}, '') AS "lastValidatedAt",
      CASE WHEN k % 11 <> 0 THEN 'public-sources-only' ELSE '' END AS "validationMethod",
      '' AS "validationNotes", source_count::VARCHAR AS "sourceCount",
      independent::VARCHAR AS "independentSources", sources, dedupe_key AS "lineageKey"
    FROM offers JOIN nested USING (dedupe_key)"""
)
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the CSV report."""
    return report.csv_rows(_report(spark, sf_dir, ("name", "url")))
