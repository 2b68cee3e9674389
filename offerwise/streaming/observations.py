"""Per-claim change events from a stream of claims.

The batch upsert compares whole cycles; this reports every claim, in arrival order. Each
micro-batch puts the stored offer before its new claims and takes all running terms as
windows over that order: a term starts anew at an official claim that names it and
tightens in between. An event compares a row with the row before it.

State is one row per offer and one per publishing page, in a folder all executors share.
Claims are dealt by offer once, as narrow as they come, and written with the columns that terms
need; terms and events are one step over them, in which the last event of an offer carries its
terms, so no table of all terms is written.
A micro-batch reads and writes only the offers it touches; every ``COMPACT`` batches the
whole state is written as one version, and older versions are read no more. A batch that is
retried overwrites its own version, so it gives the same events.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerwise.operators.history import TRACKED, changes, event_of
from offerwise.params import Params
from offerwise.schemas import CLAIMS, conform, names
from offerwise.session import passing, staged
from offerwise.streaming.ingest import params_of

KEY = "dedupe_key"
FLAGS = (
    "new_users_only",
    "first_order_only",
    "app_only",
    "selected_users_only",
    "selected_products_only",
)
STATE = """
    dedupe_key STRING, status STRING, discount_type STRING, discount_value DOUBLE,
    minimum_order DOUBLE, maximum_discount DOUBLE, is_up_to BOOLEAN, minimum_order_known BOOLEAN,
    expiry_date TIMESTAMP, source_count BIGINT, new_users_only BOOLEAN, first_order_only BOOLEAN,
    app_only BOOLEAN, selected_users_only BOOLEAN, selected_products_only BOOLEAN,
    existing_users_allowed BOOLEAN
"""
PAGES = "dedupe_key STRING, page STRING"
EVENTS = """
    dedupe_key STRING, seq BIGINT, event STRING, status STRING, previous_status STRING,
    source_name STRING, changes ARRAY<STRING>
"""
#: What terms are made of.
READ = (
    "seq", "source_name", "source_type", "page", "discount_type", "discount_value", "minimum_order",
    "minimum_order_known", "maximum_discount", "is_up_to", "expiry_date", "existing_users_allowed", *FLAGS,
)
COMPACT = 16
#: So many rows a task sorts at a time, a hot offer's apart: its windows hold the row several times.
TASK_ROWS = 50_000


def running_terms(rows: DataFrame, params: Params) -> DataFrame:
    """Claims and stored offers in arrival order, each with the offer's terms after it.

    ``rows``: claims with ``stored`` (0 for the stored offer, else 1), ``page`` and
    ``new_pages`` (pages a stored offer has; 1 where a claim's page is new to the offer).
    """
    c = F.col
    order = ("stored", "seq")
    ordered = Window.partitionBy(KEY).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)

    def within(group: str):
        own = Window.partitionBy(KEY, group).orderBy(*order)
        return own.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def count(condition, over):
        return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("int")).over(over), F.lit(0))

    official = F.coalesce(c("source_type") == "official", F.lit(False))
    known = F.coalesce(c("discount_type") != "unknown", F.lit(False))
    minimum = c("minimum_order_known") & c("minimum_order").isNotNull()
    allowed = c("existing_users_allowed").isNotNull()
    marked = rows.withColumns(
        {
            "_known": count(known, before),
            "_allowed": count(allowed, before),
            "_minimum": count(official & minimum, upto),
            "_maximum": count(official & c("maximum_discount").isNotNull(), upto),
            "_expiry": count(official & c("expiry_date").isNotNull(), upto),
            "_official": count(official, upto),
        }
    )
    # the first known kind counts, then official ones; a value starts anew with its kind
    first_kind = known & (c("_known") == 0)
    sets_kind = first_kind | (known & official)
    starts = first_kind | (known & official & c("discount_value").isNotNull())
    sets_allowed = allowed & (official | (c("_allowed") == 0))
    marked = marked.withColumn("_value", count(starts, upto))
    stated = F.max(F.when(minimum, c("minimum_order"))).over(within("_minimum"))
    terms = {
        "discount_type": F.coalesce(
            F.last(F.when(sets_kind, c("discount_type")), True).over(upto), F.lit("unknown")
        ),
        "discount_value": F.first("discount_value", True).over(within("_value")),
        "minimum_order": F.coalesce(stated, F.first("minimum_order").over(upto)),
        "minimum_order_known": F.coalesce(F.first("minimum_order_known").over(upto), F.lit(False))
        | (count(minimum, upto) > 0),
        "maximum_discount": F.min("maximum_discount").over(within("_maximum")),
        "is_up_to": F.max("is_up_to").over(within("_official")),
        "expiry_date": F.min("expiry_date").over(within("_expiry")),
        "existing_users_allowed": F.last(
            F.when(sets_allowed, c("existing_users_allowed")), True
        ).over(upto),
        "source_count": F.sum("new_pages").over(upto),
        **{
            flag: F.when(count(c(flag), upto) > 0, True).otherwise(F.first(flag).over(upto))
            for flag in FLAGS
        },
    }
    kept = [KEY, "seq", "stored", "source_name", c("status").alias("_status")]
    done = marked.select(*kept, *(value.alias(name) for name, value in terms.items()))
    past = (c("expiry_date") < params.now_col()) | (c("_status") == "expired")
    # expired is for good
    return done.withColumn(
        "status", F.when(count(past, upto) > 0, "expired").otherwise("unverified")
    ).drop("_status")


def events_of(terms: DataFrame) -> DataFrame:
    """One event per claim of ``running_terms``; the last of an offer has its terms in ``after``."""
    c = F.col
    ordered = Window.partitionBy(KEY).orderBy("stored", "seq")
    lagged = {f"was_{name}": F.lag(name).over(ordered) for name in TRACKED}
    is_new = F.row_number().over(ordered) == 1
    is_last = F.lead(F.lit(1)).over(ordered).isNull()
    marked = terms.withColumns({**lagged, "_new": is_new, "_last": is_last})
    seen = marked.where(c("stored") == 1)
    diff = seen.withColumn("changes", changes("was_"))
    moved = ~c("_new") & (c("was_status") != c("status"))
    return diff.select(
        KEY,
        "seq",
        event_of(c("_new"), c("changes"), c("was_status"), c("status")).alias("event"),
        "status",
        F.when(moved, c("was_status")).alias("previous_status"),
        "source_name",
        F.when(~c("_new") & (F.size("changes") > 0), c("changes")).alias("changes"),
        F.when(c("_last"), F.struct(*names(STATE))).alias("after"),
    )


def _read(spark: SparkSession, store: str, name: str, schema: str, number: int) -> DataFrame:
    """All rows of the versions before ``number`` that still count, with their version."""
    base = max(0, (number - 1) // COMPACT * COMPACT)
    found = [
        spark.read.schema(schema).parquet(f"{store}/{name}/v{v}").withColumn("_v", F.lit(v))
        for v in range(base, number)
    ]
    # limited to nothing, so that plans drop it
    empty = spark.createDataFrame([], f"{schema}, _v INT").limit(0)
    return reduce(DataFrame.unionByName, found, empty)


def read_state(spark: SparkSession, store: str, number: int) -> DataFrame:
    """The offers as the micro-batches before ``number`` left them."""
    rows = _read(spark, store, "offers", STATE, number)
    last = rows.groupBy(KEY).agg(F.max("_v").alias("_v"))
    return rows.join(last, [KEY, "_v"]).drop("_v")


def read_events(spark: SparkSession, store: str) -> DataFrame:
    files = spark.read.schema(EVENTS).option("recursiveFileLookup", True)
    return files.parquet(f"{store}/events")


def parts_of(spark: SparkSession, size: int) -> int:
    """Tasks whose number follows ``size``, so that a task's memory does not."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_ROWS))


def by_offer(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` dealt by offer over ``parts_of`` their number."""
    return rows.repartition(parts_of(rows.sparkSession, size), KEY)


def observe_batch(
    rows: DataFrame,
    spark: SparkSession,
    store: str,
    number: int,
    params: Params,
    to_claims: Callable[[DataFrame], DataFrame] = lambda claims: claims,
) -> None:
    """Append the events of one micro-batch and keep the offers it touched.

    ``rows`` are claims, or narrower rows with their offer's key that ``to_claims`` makes claims.
    """
    c = F.col
    page = F.concat_ws("|", "source_name", "source_url")
    size = rows.count()
    parts = parts_of(spark, size)
    came = conform(to_claims(by_offer(rows, size)), CLAIMS).withColumn("page", page)
    claims = staged(came.select(KEY, *READ), KEY, parts)
    touched = claims.select(KEY).distinct()
    offers = read_state(spark, store, number)
    pages = _read(spark, store, "pages", PAGES, number).drop("_v").distinct()
    # a known page stands before the claims that name it, so that no claim leaves its place
    known = by_offer(pages.where(c(KEY).isNotNull()), size).withColumn("_known", F.lit(True))
    met = claims.withColumn("_known", F.lit(False)).unionByName(known, allowMissingColumns=True)
    once = Window.partitionBy(KEY, "page").orderBy(c("_known").desc(), "seq")
    new_page = F.row_number().over(once) == 1
    first = met.withColumn("new_pages", new_page.cast("bigint")).where(~c("_known"))
    came = first.drop("_known").withColumns({"stored": F.lit(1), "status": F.lit(None).cast("string")})
    held = by_offer(offers.join(touched, KEY, "left_semi"), size).withColumns(
        {"stored": F.lit(0), "new_pages": c("source_count")}
    )
    rows = came.unionByName(held.drop("source_count"), allowMissingColumns=True)
    told = f"{store}/events/v{number}"
    events_of(running_terms(rows, params)).write.mode("overwrite").parquet(told)

    after = spark.read.schema(f"after STRUCT<{STATE}>").parquet(told).where("after is not null")
    new_offers = after.select("after.*")
    new_pages = claims.select(KEY, "page").distinct()
    if number % COMPACT == 0:
        new_offers = offers.join(touched, KEY, "left_anti").unionByName(new_offers)
        new_pages = pages.union(new_pages).distinct()
    new_offers.write.mode("overwrite").parquet(f"{store}/offers/v{number}")
    new_pages.write.mode("overwrite").parquet(f"{store}/pages/v{number}")


def observe_stream(
    stream: DataFrame,
    to_claims: Callable[[DataFrame], DataFrame],
    store: str,
    params: Params | Callable[[int], Params],
    available_now: bool = True,
    every: str = "30 minutes",
    keyed: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Observe every claim of a stream; ``read_events`` has what it wrote.

    ``params`` may be a function of the micro-batch's number, so that the clock moves. ``keyed``
    adds the offer's key to rows that are narrower than claims, which are then dealt by it before
    ``to_claims`` gets them. The claims of one offer in one micro-batch are sorted by one task, which spills.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows, shape = (to_claims(batch), lambda claims: claims) if keyed is None else (keyed(batch), to_claims)
        with passing(batch.sparkSession, f"{store}/_passing"):
            observe_batch(rows, batch.sparkSession, store, number, params_of(params, number), shape)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{store}/_progress")
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()
