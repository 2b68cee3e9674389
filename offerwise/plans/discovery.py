"""One discovery cycle: claims in, offers, sources and history out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.functions.text import iso_ms
from offerwise.operators import history
from offerwise.operators.dedupe import cycle_dedupe, dedupe_key
from offerwise.operators.evidence import attach_evidence
from offerwise.operators.merge import merge_sources, merge_terms
from offerwise.operators.pricing import refresh_derived
from offerwise.operators.validation import expire_sweep
from offerwise.params import Params
from offerwise.schemas import CLAIMS, OFFERS, SOURCES, conform, names
from offerwise.session import staged

KEY = "dedupe_key"


class Stored(NamedTuple):
    """The state between cycles: two tables."""

    offers: DataFrame
    sources: DataFrame


class Upserted(NamedTuple):
    offers: DataFrame
    sources: DataFrame
    observations: DataFrame
    result: DataFrame  # one row per touched offer: event, changes, status
    claimed: DataFrame  # the sources that the cycle's claims name


def empty_store(spark) -> Stored:
    # limited to nothing, so that plans drop it and what it is joined to stays in place
    return Stored(*(spark.createDataFrame([], ddl).limit(0) for ddl in (OFFERS, SOURCES)))


def claims_of(candidates: DataFrame, params: Params | None = None) -> DataFrame:
    """Candidates with their dedupe key, one claim per offer, publisher and page."""
    key = dedupe_key(params.title_key_chars if params else None)
    return conform(cycle_dedupe(candidates.withColumn(KEY, key)), CLAIMS)


def _stored_as_claims(offers: DataFrame) -> DataFrame:
    """A stored offer is the fold so far: a first claim that counts as unofficial."""
    return conform(
        offers.withColumns(
            {
                "seq": F.lit(-1),
                "discovered_at": F.col("first_seen_at"),
                "source_type": F.lit("stored"),
            }
        ),
        CLAIMS,
    )


def _sources_as_claims(sources: DataFrame) -> DataFrame:
    """Stored source rows in claim shape; their arrival time sorts them first."""
    shaped = sources.withColumns(
        {
            "seq": F.col("first_seq"),
            "discount_type": F.col("claim_type"),
            "discount_value": F.col("claim_value"),
            "minimum_order": F.col("claim_minimum"),
            "maximum_discount": F.col("claim_cap"),
        }
    )
    return conform(shaped, f"{CLAIMS}, arrived_at TIMESTAMP")


def upsert(
    stored: Stored, claims: DataFrame, params: Params, buckets: int | None = None
) -> Upserted:
    """Merge one cycle's claims into the stored offers.

    Never duplicates: offers and claims meet in one aggregation by key. ``claims``
    should be a materialised table, since merging reads it three times. What it returns
    reads tables that are materialised here. ``buckets``: claims and stored tables are bucketed
    by offer (``skew.deal``), and so are the returned offers and sources.
    """
    c, now = F.col, params.now_col()
    all_claims = conform(claims, CLAIMS)
    merged = merge_terms(
        all_claims.unionByName(_stored_as_claims(stored.offers)), params, buckets
    )

    # evidence, the snapshots, the events and the result all read these two tables
    merged_sources = merge_sources(
        all_claims.withColumns({"arrived_at": now, "claimed": F.lit(True)}).unionByName(
            _sources_as_claims(stored.sources).withColumn("claimed", F.lit(False))
        ),
        params,
        buckets,
    )
    marked = staged(conform(merged_sources, f"{SOURCES}, claimed BOOLEAN"), KEY, buckets)
    sources, claimed = marked.drop("claimed"), marked.where("claimed").drop("claimed")

    before = stored.offers.select(
        KEY, *(c(n).alias(f"old_{n}") for n in names(OFFERS) if n != KEY)
    )
    joined = merged.join(before, KEY, "left")
    is_new = c("old_status").isNull()
    touched = c("claims") > F.when(is_new, 0).otherwise(1)
    expires = touched & c("expired_by").isNotNull()
    expires = expires & (F.coalesce(c("old_status"), F.lit("")) != "expired")
    note = F.concat(F.lit("published expiry "), iso_ms(c("expired_by")), F.lit(" has passed"))

    def carried(name: str, fresh: Column) -> Column:
        return F.when(is_new, fresh).otherwise(c(f"old_{name}"))

    none = F.lit(None)
    state = joined.withColumns(
        {
            "is_new": is_new,
            "touched": touched,
            "currency": F.lit(params.currency),
            "country": F.lit(params.country),
            "status": F.when(expires, "expired").otherwise(
                carried("status", F.lit("unverified"))
            ),
            "validation_method": F.when(expires, "expiry-date").otherwise(
                carried("validation_method", none)
            ),
            "validation_notes": F.when(expires, note).otherwise(
                carried("validation_notes", none)
            ),
            "validation_attempts": carried("validation_attempts", F.lit(0)),
            "last_validated_at": carried("last_validated_at", none),
            "cart_accepted_at": carried("cart_accepted_at", none),
            "official_confirmed_at": F.greatest(
                c("old_official_confirmed_at"), c("official_confirmed_at")
            ),
            "created_at": carried("created_at", now),
            "updated_at": F.when(touched, now).otherwise(c("old_updated_at")),
        }
    )
    scored = refresh_derived(attach_evidence(state, sources, params), params)
    # offers no claim touched keep their score until the whole store is rescored
    kept = F.when(c("touched"), c("confidence")).otherwise(c("old_confidence"))
    scored = staged(
        scored.withColumns({"confidence": kept, "changes": history.changes("old_", "")}),
        KEY,
        buckets,
    )
    events = scored.where("touched").withColumn(
        "event", history.event_of(c("is_new"), c("changes"), c("old_status"), c("status"))
    )
    told = F.when(c("is_new"), c("opening_source")).otherwise(c("closing_source"))
    held = F.when(~c("is_new") & (F.size("changes") > 0), c("changes"))
    observations = history.observe(
        events,
        params,
        previous_status=F.when(c("event") == "status_changed", c("old_status")),
        changes=held,
        source_name=told["source_name"],
        source_url=told["source_url"],
        source_type=told["source_type"],
        validation_method=none,
    )
    result = events.select(KEY, "is_new", "event", held.alias("changes"), "status")
    return Upserted(conform(scored, OFFERS), sources, observations, result, claimed)


def discovery_cycle(
    stored: Stored,
    claims: DataFrame,
    params: Params,
    held: bool = False,
    buckets: int | None = None,
) -> Upserted:
    """Upsert, expiry sweep and rescoring of every offer, as one step.

    ``held``: the claims are a materialised table already. ``buckets``: as in ``upsert``.

    The returned snapshots are materialised in the shared checkpoint folder, so they
    may overwrite the tables they were read from.
    """
    c = F.col
    step = upsert(stored, claims if held else staged(claims), params, buckets)
    offers, sources = step.offers, step.sources

    swept = expire_sweep(offers, params)
    expired = history.observe(
        swept,
        params,
        event=F.lit("expired"),
        validation_result=F.lit("published expiry date passed"),
        validation_method=F.lit("expiry-date"),
    )
    moved = swept.select(
        KEY,
        c("status").alias("new_status"),
        c("validation_method").alias("new_method"),
        c("validation_notes").alias("new_notes"),
    )
    updated = offers.join(moved, KEY, "left").withColumns(
        {
            "status": F.coalesce("new_status", "status"),
            "validation_method": F.coalesce("new_method", "validation_method"),
            "validation_notes": F.coalesce("new_notes", "validation_notes"),
            "old_confidence": c("confidence"),
        }
    )
    rescored = refresh_derived(attach_evidence(updated, sources, params), params)
    drifted = rescored.where(F.abs(c("confidence") - c("old_confidence")) >= 5)
    arrow = F.concat(
        F.lit("confidence: "),
        c("old_confidence").cast("string"),
        F.lit(" -> "),
        c("confidence").cast("string"),
    )
    confidence_changed = history.observe(
        drifted,
        params,
        event=F.lit("confidence_changed"),
        changes=F.array(arrow),
        validation_method=F.lit(None),
    )
    log = step.observations.unionByName(expired).unionByName(confidence_changed)
    held_offers = staged(conform(rescored, OFFERS), KEY, buckets)
    return Upserted(held_offers, sources, log, step.result, step.claimed)


def source_sessions(fetches: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Runs of a source: ``fetches(name, fetched_at, failed)`` that follow one another within
    ``gap``, with start, duration, number of fetches and of those that failed."""
    c = F.col
    return (
        fetches.groupBy("name", F.session_window("fetched_at", gap).alias("session"))
        .agg(
            F.min("fetched_at").alias("started_at"),
            F.max("fetched_at").alias("_ended"),
            F.count(F.lit(1)).alias("fetches"),
            F.count(F.when(c("failed"), 1)).alias("failed_fetches"),
        )
        .withColumn(
            "duration_ms",
            F.expr("(unix_micros(_ended) - unix_micros(started_at)) div 1000"),
        )
        .drop("session", "_ended")
    )


def source_metrics(
    claims: DataFrame, registry: DataFrame, errors: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Per source of the cycle: candidates, with codes, errors, and of its ``source_sessions``
    the number, the whole duration and how many had a failure; silent sources too."""
    c = F.col
    found = claims.groupBy(c("source_label").alias("name")).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count(F.when(c("code").isNotNull(), 1)).alias("with_codes"),
    )
    failed = errors.groupBy("name").agg(F.count(F.lit(1)).alias("errors"))
    took = sessions.groupBy("name").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count(F.when(c("failed_fetches") > 0, 1)).alias("failed_sessions"),
        F.sum("duration_ms").alias("duration_ms"),
    )
    counts = ("candidates", "with_codes", "errors", "sessions", "failed_sessions", "duration_ms")
    return (
        registry.select("name")
        .join(found, "name", "left")
        .join(failed, "name", "left")
        .join(took, "name", "left")
        .select("name", *(F.coalesce(n, F.lit(0)).alias(n) for n in counts))
        .withColumn("failed", c("errors") > 0)
    )


def cycle_stats(
    candidates: DataFrame, claims: DataFrame, result: DataFrame, swept: DataFrame
) -> DataFrame:
    """One row: total and unique candidates, new, updated, changed and expired offers.

    ``swept``: the offers that this cycle's expiry sweep moved. Each input is counted where
    it lies and one row of it joins the union.
    """
    c = F.col
    rows = F.count(F.lit(1))
    parts = [
        candidates.agg(rows.alias("total_candidates")),
        claims.agg(rows.alias("unique_candidates")),
        result.agg(
            F.count(F.when(c("is_new"), 1)).alias("new_offers"),
            F.count(F.when(~c("is_new"), 1)).alias("updated_offers"),
            F.count(F.when(~c("is_new") & (F.size("changes") > 0), 1)).alias("changed_offers"),
        ),
        swept.agg(rows.alias("expired_offers")),
    ]
    names = [name for part in parts for name in part.columns]
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part, allowMissingColumns=True)
    return counted.agg(*(F.sum(name).alias(name) for name in names))
