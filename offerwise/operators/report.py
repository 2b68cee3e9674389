"""Report rows and their JSON and CSV files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerwise.functions import pricing
from offerwise.functions.text import ist_label, iso_ms, number_text
from offerwise.operators.evidence import confidence_factors
from offerwise.operators.ranking import rank_order
from offerwise.params import Params
from offerwise.schemas import STATUSES
from offerwise.session import staged

KEY = "dedupe_key"

# The CSV header, in order.
CSV_COLUMNS = (
    "code title status confidence discountType discountValue isUpTo minimumOrder "
    "minimumOrderKnown maximumDiscount discountAtTarget finalPriceAtTarget "
    "effectiveDiscountAtTarget targetMatch potentialTargetMatch uncertaintyReason newUsersOnly "
    "appOnly selectedUsersOnly selectedProductsOnly firstOrderOnly expiryDate firstSeenAt "
    "lastSeenAt lastValidatedAt validationMethod validationNotes sourceCount independentSources "
    "sources lineageKey"
).split()

VALID_NOTE = (
    "Only coupons whose validity was established through official publication or an actual "
    "coupon-field acceptance appear here."
)

LINEAGE = ("name", "url", "type", "discoveredAt", "lastSeenAt", "reportedExpired")
NESTED_TYPE = (
    "array<struct<name:string,url:string,type:string,discoveredAt:string,lastSeenAt:string,"
    "reportedExpired:boolean>>"
)


def source_lineage(sources: DataFrame) -> DataFrame:
    """One row per offer and source, as reports print it, with its arrival order."""
    return sources.select(
        KEY,
        F.col("source_name").alias("name"),
        F.col("source_url").alias("url"),
        F.col("source_type").alias("type"),
        iso_ms(F.col("discovered_at")).alias("discoveredAt"),
        iso_ms(F.col("last_seen_at")).alias("lastSeenAt"),
        F.coalesce("reported_expired", F.lit(False)).alias("reportedExpired"),
        "arrived_at",
        "first_seq",
    )


def source_summary(sources: DataFrame, limit: int = 6) -> DataFrame:
    """``name(type)`` of each offer's first distinct sources.

    Labels are reduced to their first arrival before the per-offer limit, so an
    offer with very many sources ships only ``limit`` labels per task.
    """
    label = F.concat("source_name", F.lit("("), "source_type", F.lit(")"))
    firsts = sources.groupBy(KEY, label.alias("label")).agg(
        F.min(F.struct("arrived_at", "first_seq")).alias("first")
    )
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy("first"))
    short = firsts.withColumn("place", rank).where(F.col("place") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("place", "label")))
    return short.groupBy(KEY).agg(
        F.array_join(F.transform(listed, lambda s: s["label"]), ", ").alias("source_summary")
    )


def nested_sources(
    offers: DataFrame, sources: DataFrame, params: Params, fields: tuple[str, ...] = LINEAGE
) -> DataFrame:
    """Each offer's lineage as an array of ``fields``, gathered in one row.

    With ``max_nested_sources`` set, offers above it get none here; their complete lineage
    is in the lineage table that is written with every report. Written reports call this
    only when it is set.
    """
    limit = params.max_nested_sources
    kept = offers.where(F.col("source_count") <= limit) if limit is not None else offers
    entry = F.struct("arrived_at", "first_seq", F.struct(*fields).alias("source"))
    ordered = F.array_sort(F.collect_list(entry))
    # keys are few and sources many, so these are not sorted to be met
    held = source_lineage(sources).join(kept.select(KEY).hint("shuffle_hash"), KEY, "left_semi")
    # a hash before the key, as keys begin alike and gathering sorts by what it groups by
    return (
        held.groupBy(F.xxhash64(KEY).alias("key_hash"), KEY)
        .agg(F.transform(ordered, lambda s: s["source"]).alias("sources"))
        .drop("key_hash")
    )


def report_rows(
    ranked: DataFrame, params: Params, extra: tuple[str, ...] = ()
) -> DataFrame:
    """One serialised row per ranked offer: nulls kept, ISO times, ladder and factors."""
    c = F.col
    steps = F.transform(
        pricing.ladder(params),
        lambda s: F.struct(
            s["cart_value"].alias("cartValue"),
            s["discount"].alias("discount"),
            s["final_price"].alias("finalPrice"),
            s["effective_discount"].alias("effectiveDiscount"),
            s["applicable"].alias("applicable"),
            s["reason"].alias("reason"),
        ),
    )
    return ranked.select(
        KEY,
        "code",
        "title",
        "status",
        "confidence",
        confidence_factors(params).alias("confidenceFactors"),
        c("discount_type").alias("discountType"),
        c("discount_value").alias("discountValue"),
        c("minimum_order").alias("minimumOrder"),
        c("minimum_order_known").alias("minimumOrderKnown"),
        c("maximum_discount").alias("maximumDiscount"),
        c("is_up_to").alias("isUpTo"),
        "currency",
        "country",
        c("new_users_only").alias("newUsersOnly"),
        c("existing_users_allowed").alias("existingUsersAllowed"),
        c("app_only").alias("appOnly"),
        c("selected_users_only").alias("selectedUsersOnly"),
        c("selected_products_only").alias("selectedProductsOnly"),
        c("first_order_only").alias("firstOrderOnly"),
        iso_ms(c("expiry_date")).alias("expiryDate"),
        c("target_match").alias("targetMatch"),
        c("potential_target_match").alias("potentialTargetMatch"),
        "uncertain",
        c("uncertainty_reason").alias("uncertaintyReason"),
        c("discount_at_target").alias("discountAtTarget"),
        c("final_price_at_target").alias("finalPriceAtTarget"),
        c("effective_discount_at_target").alias("effectiveDiscountAtTarget"),
        steps.alias("cartValueAnalysis"),
        c("independent_sources").alias("independentSources"),
        c("source_count").alias("sourceCount"),
        iso_ms(c("first_seen_at")).alias("firstSeenAt"),
        iso_ms(c("last_seen_at")).alias("lastSeenAt"),
        iso_ms(c("last_validated_at")).alias("lastValidatedAt"),
        c("validation_method").alias("validationMethod"),
        c("validation_notes").alias("validationNotes"),
        iso_ms(c("cart_accepted_at")).alias("cartAcceptedAt"),
        iso_ms(c("official_confirmed_at")).alias("officialConfirmedAt"),
        c("conflicting_sources").alias("conflictingSources"),
        *extra,
    )


def with_labels(ranked: DataFrame, params: Params) -> DataFrame:
    """The wording of an offer in printed reports."""
    c = F.col
    published = c("minimum_order_known") & c("minimum_order").isNotNull()
    return ranked.withColumns(
        {
            "offer_label": pricing.offer_label(),
            "discount_label": pricing.describe_discount(),
            "minimum_label": F.when(
                published, pricing.format_rupees(c("minimum_order"))
            ).otherwise("not published"),
            "cap_label": F.when(
                c("maximum_discount").isNotNull(), pricing.format_rupees(c("maximum_discount"))
            ).otherwise("not published"),
            "payable_label": F.when(
                c("applicable_at_target"), pricing.format_rupees(c("final_price_at_target"))
            ).otherwise("not applicable"),
            "new_users_label": pricing.yes_no(c("new_users_only")),
            "app_label": pricing.yes_no(c("app_only")),
            "expiry_label": F.when(
                c("expiry_date").isNotNull(), ist_label(c("expiry_date"))
            ).otherwise("not published"),
            "validated_label": ist_label(c("last_validated_at")),
            "tag": F.when(c("target_match"), "TARGET_MATCH").when(
                c("potential_target_match"), "POTENTIAL_TARGET_MATCH (assumptions required)"
            ),
        }
    )


def _csv_text(value: Column, kind: str) -> Column:
    if kind == "double":
        return number_text(value)
    return value.cast("string")


def csv_rows(rows: DataFrame) -> DataFrame:
    """Rows as the text columns of the CSV report; empty text for null.

    ``lineageKey`` finds the offer's rows in the lineage table.
    """
    joined = F.array_join(
        F.transform("sources", lambda s: F.concat(s["name"], F.lit("|"), s["url"])), " ; "
    )
    rows = rows.withColumn("lineageKey", F.col(KEY))
    kinds = dict(rows.dtypes)
    cells = [
        F.coalesce(
            joined if name == "sources" else _csv_text(F.col(name), kinds[name]), F.lit("")
        ).alias(name)
        for name in CSV_COLUMNS
    ]
    return rows.select(*cells)


def json_rows(rows: DataFrame) -> DataFrame:
    """Rows as JSON texts with nulls kept."""
    fields = [c for c in rows.columns if c != KEY]
    return rows.select(
        KEY, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json")
    )


def write_reports(ranked: DataFrame, sources: DataFrame, params: Params, folder: str) -> None:
    """Write the report set under ``folder``.

    ``latest_json``/``latest_csv`` and ``valid_json``/``valid_csv`` are folders of
    part files in rank order, ``lists_json`` has the best offer and the target lists in whole
    rows, ``summary_json``, written last, holds counts and target settings, and
    ``source_lineage`` is every offer's complete lineage as Parquet, by offer and arrival.
    Rows name their offer in it by ``lineageKey`` and nest sources only where
    ``max_nested_sources`` asks for it.
    """
    # the sorted rows feed five outputs, so they are computed once
    held = staged(ranked.orderBy(*rank_order()))
    nesting = params.max_nested_sources is not None
    nested = nested_sources(held, sources, params) if nesting else None
    no_sources = F.lit(None).cast(NESTED_TYPE)

    def in_order(df: DataFrame) -> DataFrame:
        return df.orderBy(*rank_order())

    def rows_of(df: DataFrame) -> DataFrame:
        with_sources = in_order(
            df.join(nested, KEY, "left") if nesting else df.withColumn("sources", no_sources)
        )
        # report_rows keeps its input order; the nested lineage rides along
        return report_rows(with_sources, params, extra=("sources",))

    valid = held.where(F.col("status") == "valid")
    for name, part in (("latest", held), ("valid", valid)):
        rows = rows_of(part)
        rows.withColumnRenamed(KEY, "lineageKey").write.mode("overwrite").option("ignoreNullFields", "false").json(
            f"{folder}/{name}_json"
        )
        (
            csv_rows(rows)
            .write.mode("overwrite")
            .option("header", True)
            .option("escape", '"')
            .option("emptyValue", "")
            .csv(f"{folder}/{name}_csv")
        )
    # arrival is part of the range key, so one offer's sources spread over tasks
    by_arrival = source_lineage(sources).orderBy(KEY, "arrived_at", "first_seq")
    by_arrival.write.mode("overwrite").parquet(f"{folder}/source_lineage")
    lists = report_lists(
        held.where(F.col("status") == "valid").orderBy(*rank_order()).limit(1),
        in_order(held.where("target_match")),
        in_order(held.where("potential_target_match")),
        params,
    )
    lists.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("list").json(
        f"{folder}/lists_json"
    )
    report_summary(held, params).write.mode("overwrite").option(
        "ignoreNullFields", "false"
    ).json(f"{folder}/summary_json")


def report_lists(
    best: DataFrame, matches: DataFrame, potential: DataFrame, params: Params
) -> DataFrame:
    """The best offer and both target lists as whole report rows, with the ``list`` they are in.

    They are rows and not arrays in the report's head, so a list may have any length.
    """
    named = {"best": best, "targetMatches": matches, "potentialTargetMatches": potential}
    parts = [report_rows(df, params).withColumn("list", F.lit(name)) for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts)


def report_summary(ranked: DataFrame, params: Params) -> DataFrame:
    """The report's head: one row of counts, target settings and times."""
    c = F.col
    counted = ranked.agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count(F.when(c("status") == s, 1)).alias(s) for s in STATUSES),
        F.count(F.when(c("target_match"), 1)).alias("targetMatches"),
        F.count(F.when(c("potential_target_match"), 1)).alias("potentialTargetMatches"),
        # the best valid offer: the smallest under the ranking keys
        F.min_by(
            "dedupe_key",
            F.when(c("status") == "valid", F.struct(*_ascending_keys())),
        ).alias("best"),
    )
    return counted.select(
        iso_ms(params.now_col()).alias("generatedAt"),
        ist_label(params.now_col()).alias("generatedAtIST"),
        F.struct(
            F.lit(params.target_cart).alias("cartValue"),
            F.lit(params.target_discount).alias("discount"),
            F.array(*map(F.lit, params.full_ladder)).alias("cartValueLadder"),
        ).alias("target"),
        F.struct("total", *STATUSES).alias("counts"),
        "targetMatches",
        "potentialTargetMatches",
        "best",
        F.lit(VALID_NOTE).alias("validNote"),
    )


def _ascending_keys() -> list[Column]:
    """The ranking keys after status, all ascending, for ``min_by``."""
    c = F.col
    return [
        F.coalesce(c("final_price_at_target"), F.lit(float("inf"))),
        -c("effective_discount_at_target"),
        ~c("target_match"),
        c("uncertain"),
        -c("confidence"),
        -F.coalesce(F.unix_micros("last_seen_at"), F.lit(0)),
        -c("independent_sources"),
        F.collate(F.coalesce(c("code"), c("title"), F.lit("")), "UNICODE"),
        c("dedupe_key"),
    ]
