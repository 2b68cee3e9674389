"""Change detection and the append-only observation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerwise.functions.text import iso_ms, number_text
from offerwise.params import Params
from offerwise.schemas import OBSERVATIONS, conform
from offerwise.session import staged

# Tracked columns with the names used in change texts, in order.
TRACKED = {
    "status": "status",
    "discount_type": "discountType",
    "discount_value": "discountValue",
    "minimum_order": "minimumOrder",
    "maximum_discount": "maximumDiscount",
    "is_up_to": "isUpTo",
    "expiry_date": "expiryDate",
    "source_count": "sourceCount",
    "new_users_only": "newUsersOnly",
    "app_only": "appOnly",
    "selected_users_only": "selectedUsersOnly",
    "selected_products_only": "selectedProductsOnly",
}


def _shown(name: str, value: Column) -> Column:
    if name == "expiry_date":
        text = iso_ms(value)
    elif name in ("discount_value", "minimum_order", "maximum_discount"):
        text = number_text(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("unknown"))


def changes(before: str, after: str = "") -> Column:
    """``field: old -> new`` for every tracked field that differs.

    ``before``/``after`` prefix the two snapshots' column names.
    """
    texts = []
    for name, label in TRACKED.items():
        old, new = F.col(f"{before}{name}"), F.col(f"{after}{name}")
        texts.append(
            F.when(
                ~old.eqNullSafe(new),
                F.concat(F.lit(f"{label}: "), _shown(name, old), F.lit(" -> "), _shown(name, new)),
            )
        )
    return F.filter(F.array(*texts), lambda t: t.isNotNull())


def event_of(is_new: Column, changed: Column, old_status: Column, new_status: Column) -> Column:
    """discovered / rediscovered / terms_changed / status_changed."""
    return (
        F.when(is_new, "discovered")
        .when(F.size(changed) == 0, "rediscovered")
        .when(~old_status.eqNullSafe(new_status), "status_changed")
        .otherwise("terms_changed")
    )


def observe(df: DataFrame, params: Params, **values: Column) -> DataFrame:
    """Rows of the observation log from offers; ``values`` set or override columns."""
    named = df.withColumns({"observed_at": params.now_col(), **values})
    return conform(named, OBSERVATIONS)


def append_observations(observations: DataFrame, path: str, batch: str | int) -> None:
    """Append one batch to the log, one folder per batch and day; its mark comes last.

    A batch that is written again, whole or after a failure, replaces what it wrote before, so
    rows are never there twice. ``read_observations`` has the log.
    """
    (
        observations.withColumn("observed_on", F.to_date("observed_at"))
        .write.mode("overwrite")
        .partitionBy("observed_on")
        .parquet(f"{path}/rows/batch={batch}")
    )
    mark = observations.sparkSession.range(1).select(F.lit(str(batch)).alias("batch")).coalesce(1)
    mark.write.mode("overwrite").parquet(f"{path}/done/{batch}")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """All batches that ended, with ``batch`` and ``observed_on``; days and batches are pruned.

    A batch whose job failed has no mark and is left out. There are as many marks as batches.
    """
    marks = spark.read.schema("batch STRING").option("recursiveFileLookup", True).parquet(f"{path}/done")
    folders = [f"{path}/rows/batch={r[0]}" for r in marks.collect()]
    schema = f"{OBSERVATIONS}, batch STRING, observed_on DATE"
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*folders)


def replay(observations: DataFrame, span: str = "day", hot_rows: int = 1_000_000) -> DataFrame:
    """Each offer's history: every row with the event and time before it.

    Rows are ordered within (offer, span), so an offer with a very long history is spread over
    tasks; the last row of the span before is handed over by a table of one row per offer and
    span. Spans are days, or where an offer has more than ``hot_rows`` rows in one (counted),
    the ranges that a range sort by offer and time cuts, of which any one is a task's share.
    """
    c = F.col
    days = observations.withColumn("_span", F.date_trunc(span, "observed_at"))
    counts = days.groupBy("dedupe_key", "_span").agg(F.count(F.lit(1)).alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= hot_rows:
        spans = days
    else:
        parts = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # ranges are numbered in the order of their rows
        ranged = observations.repartitionByRange(parts, "dedupe_key", "observed_at", "observation_id")
        spans = staged(ranged.withColumn("_span", F.spark_partition_id()))
    order = F.struct("observed_at", "observation_id")
    ends = spans.groupBy("dedupe_key", "_span").agg(
        F.max_by(F.struct("event", "observed_at"), order).alias("_end")
    )
    before = F.lag("_end").over(Window.partitionBy("dedupe_key").orderBy("_span"))
    handed = ends.select("dedupe_key", "_span", before.alias("_before"))
    inside = Window.partitionBy("dedupe_key", "_span").orderBy("observed_at", "observation_id")
    return (
        spans.withColumns(
            {"_event": F.lag("event").over(inside), "_at": F.lag("observed_at").over(inside)}
        )
        .join(handed, ["dedupe_key", "_span"])
        .withColumns(
            {
                "previous_event": F.coalesce(c("_event"), c("_before.event")),
                "previous_at": F.coalesce(c("_at"), c("_before.observed_at")),
            }
        )
        .drop("_event", "_at", "_before", "_span")
    )


def latest_observations(observations: DataFrame, per_offer: int) -> DataFrame:
    """The newest rows of every offer's history, newest first."""
    newest = Window.partitionBy("dedupe_key").orderBy(
        F.col("observed_at").desc(), F.col("observation_id").desc()
    )
    return observations.withColumn("place", F.row_number().over(newest)).where(
        F.col("place") <= per_offer
    )


def with_offer(observations: DataFrame, offers: DataFrame) -> DataFrame:
    """The log joined to the offers it speaks of."""
    wanted = offers.select("dedupe_key", "title", F.col("status").alias("current_status"))
    return observations.join(wanted, "dedupe_key")
