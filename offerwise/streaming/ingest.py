"""Continuous claim ingestion into the offer tables.

The tables are keyed stores of runs, so a micro-batch writes the offers and pages it changed.
Evidence decays, so offers change without claims too. A calendar says when: with each offer
that is written goes the next instant at which its score or status can change, in a folder of
that month. A cycle takes the offers that its claims name and those whose instant has come since
the cycle before, reads these and their pages only, and leaves all others as they are, which is
what rescoring all would give.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerwise.operators.skew import deal
from offerwise.params import Params
from offerwise.plans.discovery import KEY, Stored, Upserted, discovery_cycle
from offerwise.schemas import CLAIMS, OFFERS, SOURCES, conform
from offerwise.session import passing, staged
from offerwise.streaming.store import KeyedStore

CALENDAR = "dedupe_key STRING, next_change_at TIMESTAMP"
#: After so many batches the calendar is written anew, from all offers.
RENEW = 16
#: So many runs of a level of a table merge into one of the next.
FAN = 4


def offer_store(store: str) -> KeyedStore:
    return KeyedStore(f"{store}/offers", f"{OFFERS}, next_change_at TIMESTAMP", (KEY,), FAN)


def source_store(store: str) -> KeyedStore:
    return KeyedStore(f"{store}/sources", SOURCES, (KEY, "source_name", "source_url"), FAN)


def read_store(spark: SparkSession, store: str, version: int) -> Stored:
    """The tables as one micro-batch left them; empty before the first."""
    offers = offer_store(store).read(spark, version).drop("next_change_at")
    return Stored(offers, source_store(store).read(spark, version))


def read_observations(spark: SparkSession, store: str, version: int) -> DataFrame:
    """What one micro-batch observed."""
    return spark.read.parquet(f"{store}/observations/{version}")


def next_change(offers: DataFrame, sources: DataFrame, params: Params) -> DataFrame:
    """``offers`` with the first instant from now on behind which a rule may read them otherwise.

    An instant is when a span that a rule allows ends: rules hold up to it and not after it.
    It may be early (a page that ages beside a fresher one of its domain), never late.
    """
    c, now = F.col, params.now_col()

    def ends(at: Column, hours: float) -> Column:
        end = at + F.make_dt_interval(secs=F.lit(hours * 3600.0))
        return F.when(end >= now, end)

    third = ends(c("last_seen_at"), 24 * params.third_party_recent_days)
    official = c("source_type") == "official"
    week = ends(c("last_seen_at"), 24 * params.official_recent_days)
    aging = sources.groupBy(KEY).agg(
        F.min(F.when(~official, third)).alias("_third"), F.min(F.when(official, week)).alias("_official")
    )
    seen = c("last_seen_at")
    spans = [
        F.when(c("expiry_date") >= now, c("expiry_date")),
        ends(c("cart_accepted_at"), params.cart_evidence_hours),
        ends(c("official_confirmed_at"), 24 * params.official_recent_days),
        *(ends(seen, hours) for hours in (24, 24 * 7, 24 * params.third_party_recent_days)),
        c("_third"),
        c("_official"),
    ]
    dated = offers.join(aging, KEY, "left")
    return dated.withColumn("next_change_at", F.least(*spans)).drop("_third", "_official")


def _write_calendar(offers: DataFrame, store: str, version: int) -> None:
    dated = offers.where("next_change_at is not null").select(
        KEY, "next_change_at", F.trunc("next_change_at", "month").alias("month")
    )
    # by ranges, so a month is one file, or a few where it has many offers
    ranged = dated.repartitionByRange("month", "next_change_at", KEY)
    ranged.write.mode("overwrite").partitionBy("month").parquet(f"{store}/calendar/{version}")


def due(spark: SparkSession, store: str, version: int, since: Params, params: Params) -> DataFrame:
    """The offers that may have changed after ``since`` and before now; only those months are read.

    An entry that a later batch has overtaken makes its offer due once more, which changes nothing.
    """
    base = max(0, (version - 1) // RENEW * RENEW)
    read = [
        spark.read.schema(f"{CALENDAR}, month DATE").parquet(f"{store}/calendar/{v}")
        for v in range(base, version)
    ]
    if not read:
        return spark.createDataFrame([], CALENDAR).select(KEY)
    c = F.col
    first, last = (F.trunc(at, "month") for at in (since.now_col(), params.now_col()))
    months = c("month").between(first, last)
    come = (c("next_change_at") >= since.now_col()) & (c("next_change_at") < params.now_col())
    return reduce(DataFrame.unionByName, read).where(months & come).select(KEY).distinct()


def upsert_batch(
    rows: DataFrame,
    store: str,
    version: int,
    params: Params,
    since: Params | None = None,
    to_claims: Callable[[DataFrame], DataFrame] = lambda claims: claims,
) -> Upserted:
    """One cycle over the offers it concerns. ``since`` has the clock of the cycle before.

    ``rows`` are claims, or narrower rows with their offer's key that ``to_claims`` makes claims.
    They are dealt by offer once, and what is stored of their offers is dealt in the same way.
    """
    spark, offers, pages = rows.sparkSession, offer_store(store), source_store(store)

    def shape(dealt: DataFrame) -> DataFrame:
        # merging reads neither the code nor the raw text of a claim
        return conform(to_claims(dealt), CLAIMS).drop("code", "raw_text")

    parts = deal(rows, KEY, params, shape, unit=offers.buckets)
    named = [staged(part.rows.select(KEY).distinct(), KEY, part.buckets) for part in parts]
    if since is not None:
        come = due(spark, store, version, since, params)
        for hot in named[1:]:
            come = come.join(hot, KEY, "left_anti")
        named[0] = staged(named[0].unionByName(come).distinct(), KEY, parts[0].buckets)
    steps = []
    for (claims, buckets), keys in zip(parts, named, strict=True):
        stored = Stored(
            staged(offers.read(spark, version - 1, keys, buckets).drop("next_change_at"), KEY, buckets),
            pages.read(spark, version - 1, keys, buckets),
        )
        steps.append(discovery_cycle(stored, claims, params, held=True, buckets=buckets))
    dated = reduce(
        DataFrame.unionByName,
        (
            staged(next_change(step.offers, step.sources, params), KEY, part.buckets)
            for step, part in zip(steps, parts, strict=True)
        ),
    )
    step = Upserted(*(reduce(DataFrame.unionByName, frames) for frames in zip(*steps, strict=True)))
    placed = len(parts) == 1  # rows of hot offers are not in buckets
    offers.write(dated, version, placed)
    pages.write(step.claimed, version, placed)
    step.observations.write.mode("overwrite").parquet(f"{store}/observations/{version}")
    if version % RENEW == 0:
        dated = offers.read(spark, version)
    _write_calendar(dated, store, version)
    return step


def params_of(params: Params | Callable[[int], Params], number: int) -> Params:
    """The parameters, and so the clock, of one micro-batch."""
    return params(number) if callable(params) else params


def upsert_stream(
    stream: DataFrame,
    to_claims: Callable[[DataFrame], DataFrame],
    store: str,
    params: Params | Callable[[int], Params],
    available_now: bool = True,
    every: str = "30 minutes",
    keyed: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Upsert, sweep and rescore with every micro-batch. ``store`` is a folder all executors
    share; ``params`` may be a function of the batch's number, so that the clock moves.
    ``keyed`` adds the offer's key to rows that are narrower than claims; ``to_claims`` then
    gets rows that are dealt by it, and keeps them there.

    Micro-batches run one after another, so cycles never overlap, and the clock never goes
    back. Each batch reads the version before it and writes its own, overwriting what a failed
    attempt left, so a batch that is retried gives the same tables.
    """

    def run(batch: DataFrame, number: int) -> None:
        since = params_of(params, number - 1) if number else None
        rows, shape = (to_claims(batch), lambda claims: claims) if keyed is None else (keyed(batch), to_claims)
        with passing(batch.sparkSession, f"{store}/_passing"):
            upsert_batch(rows, store, number, params_of(params, number), since, shape)

    writer = stream.writeStream.foreachBatch(run).option(
        "checkpointLocation", f"{store}/_progress"
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()
