"""Registered queries that run as streams over the given tables until they are drained."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwise.catalog import offers as batch
from offerwise.catalog import oracle_base as sql
from offerwise.catalog import projection as data
from offerwise.catalog.projection import PARAMS
from offerwise.catalog.registry import big, query, ts
from offerwise.session import SETTINGS, checkpoint_dir
from offerwise.streaming.dedupe import drop_repeats, once_per_window
from offerwise.streaming.ingest import read_store, upsert_stream
from offerwise.streaming.observations import observe_stream, read_events


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables as a stream of its files."""
    schema = data.table(spark, sf_dir, name).schema
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, SETTINGS[key])
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream to its end into Parquet and read the result."""
    started = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/_progress")
        .trigger(availableNow=True)
        .start(f"{folder}/rows")
    )
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event per user and type within the delay."""
    events = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = drop_repeats(events, ["user_id", "event_type"], "ts", "36500 days")
    return drain(kept, shared_folder(spark, "dedupe")).select("user_id", "event_type")


@query(
    """SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day
    FROM events WHERE ts IS NOT NULL"""
)
def stream_daily_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per user, type and day. The events arrive in three parts by time, a micro-batch
    each, so that the watermark moves and days that are over leave the state."""
    c = F.col
    given = data.table(spark, sf_dir, "events").withColumn("ts", c("ts").cast("timestamp"))
    arrived, folder = shared_folder(spark, "events"), shared_folder(spark, "dedupe")
    first, last = given.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    span = ((last or 0) - (first or 0)) / 3
    part = F.coalesce(F.least(F.floor((c("ts").cast("double") - (first or 0)) / (span or 1)), F.lit(2)), F.lit(0))
    kept = None
    for k in range(3):
        given.where(part == k).write.parquet(f"{arrived}/{k}")
        events = spark.readStream.schema(given.schema).option("recursiveFileLookup", True).parquet(arrived)
        kept = drain(once_per_window(events, ["user_id", "event_type"], "ts"), folder)
    return kept.select("user_id", "event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"))


@query(
    f"""{sql.chain(sql.claims(), sql.merged(), sql.sources(), sql.evidence())}
    SELECT {batch._TERM_SQL}, source_count, conflict AS conflicting_sources,
      CASE WHEN ever_past THEN 'expired' ELSE 'unverified' END AS status,
      {sql.ts('last_seen')} AS last_seen_at FROM merged JOIN evid USING (dedupe_key)"""
)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items arriving in two parts, by ship date: a stream that goes on where it stopped
    takes each as one micro-batch, and upserts the offers it names."""
    store, folder = shared_folder(spark, "offers"), shared_folder(spark, "lines")
    given = data.table(spark, sf_dir, "lineitem").select(*data.LINE_COLUMNS)
    shipped = F.coalesce(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date"))
    cuts = [F.lit(day).cast("date") for day in ("0001-01-01", "1997-01-01", "9999-12-31")]
    last = -1
    for k, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
        given.where((shipped >= start) & (shipped < end)).write.parquet(f"{folder}/{k}")
        lines = spark.readStream.schema(given.schema).option("recursiveFileLookup", True).parquet(folder)
        running = upsert_stream(
            lines,
            lambda rows: data.claims_from(spark, sf_dir, rows),
            store,
            PARAMS,
            keyed=data.with_offer_key,
        )
        running.awaitTermination()
        last = running.lastProgress["batchId"] if running.lastProgress else last
    return read_store(spark, store, last).offers.select(
        *batch._term_columns(),
        big("source_count"),
        "conflicting_sources",
        "status",
        ts("last_seen_at"),
    )


_UPTO = "OVER (PARTITION BY dedupe_key ORDER BY seq)"


def _within(mark: str) -> str:
    return f"OVER (PARTITION BY dedupe_key, {mark} ORDER BY seq)"


# the terms after each claim, by running and segmented windows
_RUNNING = f"""{sql.chain(sql.claims())}, marked AS (
  SELECT *, (date_diff('day', DATE '1970-01-01', seen::DATE)::BIGINT << 44) + (l_orderkey << 4) + l_linenumber AS arrival,
    count(*) FILTER (official AND minimum IS NOT NULL) {_UPTO} AS m_min,
    count(*) FILTER (official AND cap IS NOT NULL) {_UPTO} AS m_cap,
    count(*) FILTER (official) {_UPTO} AS m_up,
    count(*) FILTER (official AND expiry IS NOT NULL) {_UPTO} AS m_exp,
    row_number() OVER (PARTITION BY dedupe_key, source_name ORDER BY seq) = 1 AS new_page
  FROM claims
), terms AS (
  SELECT dedupe_key, seq, arrival, source_name,
    coalesce(last_value(CASE WHEN official AND kind <> 'unknown' THEN kind END IGNORE NULLS) {_UPTO},
      first_value(nullif(kind, 'unknown') IGNORE NULLS) {_UPTO}, 'unknown') AS kind,
    coalesce(last_value(CASE WHEN official THEN val END IGNORE NULLS) {_UPTO},
      first_value(val IGNORE NULLS) {_UPTO}) AS val,
    max(minimum) {_within('m_min')} AS minimum, min(cap) {_within('m_cap')} AS cap,
    bool_or(hedged) {_within('m_up')} AS hedged, min(expiry) {_within('m_exp')} AS expiry,
    count(*) FILTER (new_page) {_UPTO} AS source_count
  FROM marked
), run AS (
  SELECT *, CASE WHEN bool_or(coalesce(expiry < {sql.NOW}, false)) {_UPTO} THEN 'expired' ELSE 'unverified' END AS status
  FROM terms
), told AS (
  SELECT n.dedupe_key, n.arrival AS seq, n.source_name, n.status, o.seq IS NULL AS is_new, o.status AS was,
    array_to_string(list_filter([{batch._CHANGES}], lambda x: x IS NOT NULL), '; ') AS changes
  FROM run n LEFT JOIN run o ON o.dedupe_key = n.dedupe_key AND o.seq = n.seq - 1
)"""


@query(
    f"""{_RUNNING} SELECT dedupe_key, seq, source_name, status,
      CASE WHEN is_new THEN 'discovered' WHEN changes = '' THEN 'rediscovered'
        WHEN was <> status THEN 'status_changed' ELSE 'terms_changed' END AS event,
      CASE WHEN NOT is_new AND was <> status THEN was ELSE 'none' END AS previous_status,
      CASE WHEN is_new OR changes = '' THEN 'none' ELSE changes END AS changes FROM told"""
)
def stream_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per claim, with what changed."""
    store = shared_folder(spark, "observations")
    lines = stream_of(spark, sf_dir, "lineitem")
    observe_stream(
        lines,
        lambda rows: data.claims_from(spark, sf_dir, rows),
        store,
        PARAMS,
        keyed=data.with_offer_key,
    ).awaitTermination()
    none = F.lit("none")
    return read_events(spark, store).select(
        "dedupe_key",
        "seq",
        "source_name",
        "status",
        "event",
        F.coalesce("previous_status", none).alias("previous_status"),
        F.coalesce(F.array_join("changes", "; "), none).alias("changes"),
    )
