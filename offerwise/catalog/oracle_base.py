"""Shared common table expressions of the oracle SQL (DuckDB dialect).

They state the same projection and the merge rules independently of the Spark code:
claims are numbered by a window, marks and merged terms are plain SQL aggregates.
"""

NOW = "TIMESTAMP '2001-11-05 00:00:00'"


def claims(name: str = "claims", before: str | None = None) -> str:
    """Line items as claims; with ``before`` only those seen earlier."""
    seen = f"WHERE l_shipdate < {before}" if before else ""
    return f"""
{name} AS (
  SELECT p_partkey AS k, 'CODE:PART' || p_partkey AS dedupe_key, 'PART' || p_partkey AS code,
    p_name AS title, l_orderkey, l_linenumber, l_suppkey,
    row_number() OVER (PARTITION BY p_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS seq,
    CASE WHEN l_quantity = 2 THEN 'unknown' WHEN p_partkey % 5 = 1 THEN 'percentage'
         WHEN p_partkey % 5 = 2 THEN 'sale' WHEN p_partkey % 5 = 3 THEN 'cashback'
         ELSE 'flat' END AS kind,
    CASE WHEN l_quantity <> 2 THEN
      CASE WHEN p_partkey % 5 = 1 THEN 5 + p_size ELSE 100 + 20 * p_size END
      + CASE WHEN l_quantity = 50 THEN 10 ELSE 0 END END::DOUBLE AS val,
    CASE WHEN l_linenumber <= 3 AND p_partkey % 7 <> 0 THEN
      500 + 10 * p_size + CASE WHEN l_tax = 0.08 THEN 100 ELSE 0 END END::DOUBLE AS minimum,
    CASE WHEN p_partkey % 5 = 1 AND l_linenumber = 4 THEN 200 + 5 * p_size END::DOUBLE AS cap,
    l_quantity = 1 AS hedged,
    CASE WHEN l_linenumber = 1 THEN l_shipdate + to_days(200 + 60 * p_size) END AS expiry,
    l_returnflag = 'R' AND l_quantity >= 45 AS dead,
    'pub' || l_suppkey AS source_name,
    CASE l_suppkey % 4 WHEN 1 THEN 'www.' WHEN 2 THEN 'm.' WHEN 3 THEN 'amp.' ELSE '' END
      || 'pub' || l_suppkey || '.example' AS domain,
    s_nationkey % 5 = 0 AS official,
    l_shipdate AS seen
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  {seen}
)"""


def merged(name: str = "merged", src: str = "claims") -> str:
    """Merged terms per offer."""
    return f"""
{name}_marks AS (
  SELECT dedupe_key,
    max(seq) FILTER (official AND minimum IS NOT NULL) AS m_min,
    max(seq) FILTER (official AND cap IS NOT NULL) AS m_cap,
    max(seq) FILTER (official) AS m_up,
    max(seq) FILTER (official AND expiry IS NOT NULL) AS m_exp,
    max(seq) FILTER (official AND kind <> 'unknown') AS m_type,
    min(seq) FILTER (kind <> 'unknown') AS m_known
  FROM {src} GROUP BY dedupe_key
),
{name} AS (
  SELECT c.dedupe_key, any_value(k) AS k, any_value(code) AS code, arg_min(title, seq) AS title,
    count(*) AS claims,
    coalesce(max(kind) FILTER (seq = m_type), max(kind) FILTER (seq = m_known), 'unknown') AS kind,
    coalesce(max(val) FILTER (seq = m_type), arg_min(val, seq) FILTER (val IS NOT NULL)) AS val,
    max(minimum) FILTER (m_min IS NULL OR seq >= m_min) AS minimum,
    min(cap) FILTER (m_cap IS NULL OR seq >= m_cap) AS cap,
    bool_or(hedged) FILTER (m_up IS NULL OR seq >= m_up) AS hedged,
    min(expiry) FILTER (m_exp IS NULL OR seq >= m_exp) AS expiry,
    coalesce(bool_or(expiry < {NOW}), false) AS ever_past,
    arg_min(seen, seq) AS first_seen, max(seen) AS last_seen,
    arg_min(official, seq) AS first_official
  FROM {src} c JOIN {name}_marks USING (dedupe_key) GROUP BY c.dedupe_key
)"""


def sources(name: str = "srcs", src: str = "claims") -> str:
    """Each publisher's first discovery and latest claim per offer."""
    return f"""
{name} AS (
  SELECT dedupe_key, source_name, any_value(domain) AS domain,
    regexp_replace(any_value(domain), '^(www|m|amp|mobile)\\.', '') AS norm,
    any_value(official) AS official, min(seen) AS first_seen, max(seen) AS last_seen,
    arg_max(kind, seq) AS kind, max(struct_pack(s := seq, v := val)).v AS val,
    max(struct_pack(s := seq, v := minimum)).v AS minimum,
    max(struct_pack(s := seq, v := cap)).v AS cap, arg_max(dead, seq) AS dead,
    min(seq) AS first_seq
  FROM {src} GROUP BY dedupe_key, source_name
)"""


def evidence(name: str = "evid", src: str = "srcs", report_days: int = 14) -> str:
    return f"""
{name} AS (
  SELECT dedupe_key, count(*) AS source_count, bool_or(official) AS has_official,
    max(last_seen) FILTER (official) AS official_seen,
    count(DISTINCT norm) FILTER (NOT official AND last_seen >= {NOW} - INTERVAL 30 DAY)
      AS independent,
    bool_or(dead) AS dead,
    count(*) FILTER (dead AND last_seen >= {NOW} - INTERVAL {report_days} DAY) AS reports,
    count(DISTINCT norm) FILTER (dead AND last_seen >= {NOW} - INTERVAL {report_days} DAY)
      AS report_domains,
    arg_min(domain, first_seq) FILTER
      (dead AND official AND last_seen >= {NOW} - INTERVAL {report_days} DAY) AS report_domain,
    max(last_seen) FILTER
      (official AND NOT dead AND last_seen >= {NOW} - INTERVAL 48 HOUR) AS current_seen,
    count(DISTINCT kind) FILTER (val IS NOT NULL) > 1
      OR count(DISTINCT val) > 1
      OR count(DISTINCT minimum) FILTER (val IS NOT NULL) > 1 AS conflict
  FROM {src} GROUP BY dedupe_key
)"""


# Discount on a cart value, from columns kind, val, minimum, cap, hedged.
def raw_discount(cart: str) -> str:
    return f"""(CASE WHEN (minimum IS NOT NULL AND {cart} < minimum) OR hedged OR val IS NULL
      OR kind NOT IN ('flat', 'percentage') THEN 0::DOUBLE
    ELSE greatest(0::DOUBLE, least(
      CASE kind WHEN 'flat' THEN val ELSE {cart}::DOUBLE * val / 100::DOUBLE END,
      coalesce(cap, 1e18::DOUBLE), {cart}::DOUBLE)) END)"""


def round2(x: str) -> str:
    return f"(floor(({x}) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE)"


DOUBT = """(CASE WHEN hedged THEN 'advertised as "up to" - guaranteed value unknown'
    WHEN kind = 'sale' THEN 'store-wide sale rather than a cart coupon'
    WHEN kind = 'unknown' THEN 'offer terms could not be parsed'
    WHEN kind = 'cashback' THEN 'cashback, not a checkout discount'
    WHEN val IS NULL THEN 'discount value not published'
    WHEN minimum IS NULL THEN 'minimum order not published - applicability assumed'
    WHEN kind = 'percentage' AND cap IS NULL THEN 'percentage offer without a published cap'
    END)"""


def offers(name: str = "offers") -> str:
    """The snapshot: merged terms, evidence, validation state, analysis, confidence."""
    return f"""
{name}_state AS (
  SELECT m.*, e.* EXCLUDE (dedupe_key),
    CASE WHEN expiry < {NOW} THEN 'expired' ELSE
      ['valid', 'unverified', 'manual_validation_required', 'invalid'][k % 4 + 1] END AS status,
    CASE WHEN k % 11 <> 0 THEN {NOW} - to_hours(k % 100) END AS validated,
    k % 4 AS attempts,
    CASE WHEN k % 13 = 0 THEN {NOW} - to_hours(k % 90) END AS accepted,
    {raw_discount('1000')} AS raw_discount, {DOUBT} AS doubt
  FROM merged m JOIN evid e USING (dedupe_key)
),
{name} AS (
  SELECT *, {round2('raw_discount')} AS discount, {round2('1000 - raw_discount')} AS pay,
    {round2('raw_discount / 1000')} AS eff, raw_discount > 0 AS applicable,
    {round2('raw_discount')} >= 800 AND {round2('1000 - raw_discount')} <= 200 AS hits,
    greatest(0, least(100,
      CASE WHEN accepted >= {NOW} - INTERVAL 48 HOUR THEN 50 ELSE 0 END
      + CASE WHEN official_seen >= {NOW} - INTERVAL 7 DAY OR first_official THEN 35 ELSE 0 END
      + CASE WHEN independent >= 2 THEN 10 ELSE 0 END
      + CASE WHEN independent >= 3 THEN 5 ELSE 0 END
      + CASE WHEN last_seen >= {NOW} - INTERVAL 24 HOUR THEN 10
             WHEN last_seen >= {NOW} - INTERVAL 7 DAY THEN 5 ELSE 0 END
      - CASE WHEN last_seen < {NOW} - INTERVAL 30 DAY THEN 20 ELSE 0 END
      - CASE WHEN conflict THEN 20 ELSE 0 END
      - CASE WHEN dead OR expiry < {NOW} THEN 50 ELSE 0 END)) AS confidence
  FROM {name}_state
)"""


def chain(*parts: str) -> str:
    return "WITH " + ",".join(parts)


MERGED = chain(claims(), merged())
SOURCES = chain(claims(), sources())
EVIDENCE = chain(claims(), sources(), evidence())
OFFERS = chain(claims(), merged(), sources(), evidence(), offers())

# status order and the ranking keys of an offer
STATUS_ORDER = """(CASE status WHEN 'valid' THEN 0 WHEN 'manual_validation_required' THEN 1
  WHEN 'unverified' THEN 2 WHEN 'invalid' THEN 3 ELSE 4 END)"""
RANKING = f"""{STATUS_ORDER}, CASE WHEN applicable THEN pay ELSE 1e18 END, eff DESC,
  (hits AND doubt IS NULL) DESC, (doubt IS NOT NULL), confidence DESC, last_seen DESC,
  independent DESC, code, dedupe_key"""
QUEUE = """(hits AND doubt IS NULL) DESC, (CASE WHEN applicable THEN pay END) ASC NULLS FIRST,
  confidence DESC, last_seen DESC, dedupe_key"""


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def iso(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S.000Z')"
