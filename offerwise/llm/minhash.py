"""Near-duplicate documents by circulant MinHash with exact verification.

Two permutations make every coordinate of a signature: the first scatters a shingle over
the ring of 2^32 places, the second, shifted around the ring by k, ranks the places for
coordinate k. ``BANDS`` bands of ``ROWS`` coordinates send classes of equal texts to
buckets; a pair at the threshold of 0.85 misses all of them once in 400,000.

1. Rows with equal word sequences are one class; only classes go on, so thousands of copies
   cost one row.
2. Classes that share a bucket get their full shingle sets. Shingles that no other such
   class has can't be common to any pair, which bounds a pair's similarity from above:
   with m the smaller number of shared shingles, J <= m / (n1 + n2 - m).
3. In every bucket the class with the least share of such shingles is the hub. Members that
   the bound allows are compared with it on full sets. Members of a large group thus cost
   one comparison each, not one with each other.
4. In buckets that still hold more than one component, all pairs across components that the
   bound allows are compared, so no link between components is lost and there is no cap.

Defined results: null, empty and blank texts have no shingles and link with nothing; rows
are judged one by one, so repeated doc_ids may differ; the component's id is its smallest
doc_id that is not null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwise.llm.common import bounded_broadcast, same, short_batches, stage, text_of
from offerwise.llm.shingles import mix, normalised, shingle_sets

BANDS = 22
ROWS = 5
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 85
_STRIDE = 1 << 15


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a set of 64-bit hashes."""
    place = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    best = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(place), _STRIDE):
        rank = place[None, lo : lo + _STRIDE] + shift
        rank *= np.uint32(0x85EBCA6B)
        rank ^= rank >> np.uint32(13)
        rank *= np.uint32(0xC2B2AE35)
        rank ^= rank >> np.uint32(16)
        np.minimum(best, rank.min(axis=1), out=best)
    return best


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in sign.reshape(bands, rows).T.astype(np.uint64):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _class_of(norm: bytes) -> bytes:
    return hashlib.md5(norm, usedforsecurity=False).digest()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.LargeListArray.from_arrays(ends, pa.array(flat.view(np.int64))).cast(
        pa.list_(pa.int64())
    )


def _sign_rows(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [normalised(t) for t in batch.column("text").to_pylist()]
            sets = shingle_sets(norms)
            none = np.empty(0, dtype=np.int64)
            keys = [
                band_keys(signature(s, bands * rows), bands, rows) if len(s) else none for s in sets
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([_class_of(n) if n else None for n in norms], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    _lists(keys),
                ],
                names=["doc_id", "text_hash", "class", "n_shingles", "bands"],
            )

    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norms = [normalised(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_class_of(n) for n in norms], pa.binary()), _lists(shingle_sets(norms))],
            names=["class", "shingles"],
        )


def components(links: DataFrame) -> DataFrame:
    """(node, comp) over the nodes of (a, b) links; comp is the smallest node reachable.

    Each round takes the least label of the neighbours and then that label's own label.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("comp")
    ), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        least = labels.join(near, "node").select(
            "node", F.col("comp").alias("was"), F.least("comp", "near").alias("via")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("next"))
        new = least.join(jump, "via", "left").select(
            "node", F.least("via", F.coalesce("next", "via")).alias("comp"), "was"
        )
        new = stage(new, "labels")
        if new.filter("comp <> was").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    counted = both.select(
        "a", "b", F.size(F.array_intersect("sa", "sb")).alias("met"),
        (F.size("sa") + F.size("sb")).alias("total"),
    )
    return counted.filter(100 * F.col("met") >= percent * (F.col("total") - F.col("met")))


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_shingles, component_id."""
    return placed_rows(docs, percent, bands, rows).drop("component")


def placed_rows(
    docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """The rows of ``near_duplicates`` with ``component``, which tells components apart even
    where ids are null or repeated; null for texts without shingles, which link with nothing.
    """
    short_batches(docs.sparkSession)
    own = docs.select(
        "doc_id",
        F.xxhash64(text_of("text")).alias("text_hash"),
        text_of("text").cast("binary").alias("text"),
    )
    signed = stage(
        own.mapInArrow(
            _sign_rows(bands, rows),
            "doc_id bigint, text_hash bigint, class binary, n_shingles bigint, bands array<bigint>",
        ),
        "signatures",
    )
    classes = (
        signed.filter("class is not null")
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        )
    )
    classes = stage(classes, "classes")
    banded = classes.select("class", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    member = stage(banded.join(stage(shared.select("bucket"), "buckets"), "bucket"), "members")

    # full sets of the classes that share a bucket, from one row of each
    wanted = stage(
        member.select("class").distinct().join(classes.select("class", "doc_id"), "class"), "wanted"
    )
    ids = bounded_broadcast(wanted.select("doc_id"))
    texts = own.join(ids, same(own["doc_id"], ids["doc_id"]), "left_semi").filter(
        F.length("text") > 0
    )
    sets = texts.mapInArrow(_set_rows, "class binary, shingles array<bigint>")
    sets = sets.join(bounded_broadcast(wanted.select("class")), "class", "left_semi")
    sets = stage(sets.dropDuplicates(["class"]), "sets")
    alone = (
        sets.select(F.xxhash64("class").alias("owner"), F.explode("shingles").alias("s"))
        .groupBy("s")
        .agg(F.count("*").alias("m"), F.max("owner").alias("owner"))
        .filter("m = 1")
        .groupBy("owner")
        .agg(F.count("*").alias("alone"))
    )
    alone = stage(alone, "unshared")
    member = member.withColumn("owner", F.xxhash64("class")).join(alone, "owner", "left")
    member = stage(
        member.select(
            "bucket", "class", "n",
            (F.col("n") - F.coalesce("alone", F.lit(0))).alias("met"),
        ).filter(100 * F.col("met") >= percent * F.col("n")),
        "members",
    )

    def may_link(a: str, b: str):
        n, m = F.col(f"{a}.n") + F.col(f"{b}.n"), F.least(f"{a}.met", f"{b}.met")
        small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
        return (100 * small >= percent * large) & (100 * m >= percent * (n - m))

    # hubs: one comparison for each member and hub
    hub = F.min(F.struct(((F.col("n") - F.col("met")) / F.col("n")).alias("rank"), "class", "n", "met"))
    hubs = member.groupBy("bucket").agg(hub.alias("hub"), F.count("*").alias("m")).filter("m > 1")
    hubs = stage(hubs.select("bucket", "hub.class", "hub.n", "hub.met"), "hubs")
    met = (
        member.alias("x")
        .join(
            hubs.alias("h"),
            (F.col("x.bucket") == F.col("h.bucket"))
            & (F.col("x.class") != F.col("h.class"))
            & may_link("x", "h"),
        )
        .select(F.col("h.class").alias("a"), F.col("x.class").alias("b"))
        .distinct()
    )
    tested = stage(met, "hub-pairs")
    links = stage(_verified(tested, sets, percent).select("a", "b"), "hub-links")
    found = components(links)

    # what is left: pairs across components within a bucket
    at = member.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "comp", F.coalesce("comp", "class")
    )
    at = stage(at, "placed")
    mixed = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = stage(mixed.filter("lo <> hi").select("bucket"), "mixed")
    at = at.join(mixed, "bucket").join(classes.select("class", "bands"), "class")
    at = stage(at, "mixed-members")
    # a pair comes up in the first of its common buckets only
    once = F.element_at(F.array_intersect("x.bands", "y.bands"), 1) == F.col("x.bucket")
    across = (
        at.alias("x")
        .join(
            at.alias("y"),
            (F.col("x.bucket") == F.col("y.bucket"))
            & (F.col("x.comp") < F.col("y.comp"))
            & may_link("x", "y")
            & once,
        )
        .select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    )
    known = tested.select("a", "b").union(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = stage(across.join(known, ["a", "b"], "left_anti"), "cross-pairs")
    more = stage(_verified(across, sets, percent).select("a", "b"), "cross-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    placed = classes.select("class", "doc_id").join(
        found.withColumnRenamed("node", "class"), "class", "left"
    ).withColumn("comp", F.coalesce("comp", "class"))
    placed = stage(placed, "class-components")
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(stage(least, "least"), "comp").select("class", "comp", "component_id")
    named = stage(named, "named")
    return signed.drop("bands").join(named, "class", "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("comp").alias("component"),
    )
