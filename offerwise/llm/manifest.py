"""Merkle manifest of a dataset: nested intervals of leaf ranks.

1. Tasks hash their rows into leaves (and the tampered copy of some); only digests go on.
2. Leaves get their rank within their source: a range sort by (source, doc_id), the place in
   the task, and one count per task and source. No source is gathered.
3. A node carries the interval [lo, hi) of leaf ranks that it covers. A level's nodes are the
   runs of ``FAN`` intervals below, found by bucket, so a node gathers at most ``FAN`` digests.
   Subroots are ranked by source and get a tree of their own in the same way.
4. From the root down, nodes meet their parent by a containment join in buckets of the
   parent's width. The parent's interval less the node's own leaves the siblings: the digests
   to the left and to the right. They are put before the parent's own list, so a leaf has the
   lists of all levels after one last join, and folds its digest up to the root by itself.

Lists hold at most ``FAN - 1`` digests a level and there are log n levels, so rows stay short
however large the table is; a source with a third of all rows is as many runs as its rows need.

Defined results: nulls in any column are ``-`` in the leaf; rows of a source and id (null ids
first) come by leaf; fully equal rows are leaves each; a row without siblings on any level
has the hash of the empty string as proof; a null doc_id is never tampered; an empty table has
no rows. Columns other than doc_id, source, lang, n_chars and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerwise.llm.common import bounded_broadcast, lower_ascii, stage

FAN = 16
#: Characters of a digest.
WIDE = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    values = [F.col(name) if name != "text" else text for name in FIELDS]
    return F.sha2(F.concat(*map(field, values)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): the leaf of each row and that of its tampered text,
    null where it isn't tampered."""
    fields = docs.select(*FIELDS)
    picked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return fields.select(
        "doc_id",
        "source",
        leaf(F.col("text")).alias("leaf"),
        F.when(picked, leaf(lower_ascii(F.col("text").cast("string")))).alias("tampered"),
    )


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with their ``rank`` from 0 within ``group``, by ``order``, and the group's
    ``size``. Null groups are one. Rows are dealt out by range, also equal ones, so no group
    lies in one task."""
    keys = [F.col(name).asc_nulls_first() for name in (group, *order)]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = salted.repartitionByRange(parts, *keys, "salt").sortWithinPartitions(*keys, "salt")
    part, at = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
    placed = stage(dealt.drop("salt").select("*", part, at), "ranked")
    runs = placed.groupBy(group, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # at most one row per task of a group
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col(group).alias("_group"),
        F.col("part").alias("_part"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("size"),
    )
    starts = bounded_broadcast(stage(starts, "rank-starts"))
    met = F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part"))
    return placed.join(starts, met).select(
        *rows.columns, (F.col("at") + F.col("shift")).alias("rank"), "size"
    )


def levels_of(bottom: DataFrame, group: str) -> list[DataFrame]:
    """All levels of the groups' trees from ``bottom`` (group, size, lo, hi, digest) up; those
    above hold ``parts`` too, the digests below a node in order. A group is on the levels up
    to that of its only node, the interval of which is the whole group."""
    levels, width = [bottom], 1
    largest = bottom.agg(F.max("size")).first()[0] or 1
    while width < largest:
        below = levels[-1].filter(F.col("size") > width)
        width *= FAN
        # a run has at most FAN intervals
        run = F.array_sort(F.collect_list(F.struct("lo", "digest")))
        nodes = below.groupBy(group, "size", F.floor(F.col("lo") / width).alias("bucket")).agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.array_join(F.transform(run, lambda x: x.digest), "").alias("parts"),
        )
        nodes = nodes.select(group, "size", "lo", "hi", "parts", F.sha2("parts", 256).alias("digest"))
        levels.append(stage(nodes, "level"))
    return levels


def complete() -> Column:
    return F.col("hi") - F.col("lo") == F.col("size")


def attached(
    nodes: DataFrame, above: DataFrame, group: str, width: int, carried: list[str]
) -> DataFrame:
    """``nodes``, intervals of ``width`` leaves, with ``path``: the digests left and right of
    them under their parent in ``above``, then the parent's path; and its ``carried`` columns."""
    wide = width * FAN
    parents = above.select(
        F.col(group).alias("_group"),
        F.floor(F.col("lo") / wide).alias("_bucket"),
        F.col("lo").alias("_lo"),
        F.col("hi").alias("_hi"),
        F.col("parts").alias("_parts"),
        F.col("path").alias("_path"),
        *(F.col(name).alias(f"_{name}") for name in carried),
    )
    held = nodes.withColumn("_at", F.floor(F.col("lo") / wide))
    inside = (
        F.col(group).eqNullSafe(F.col("_group"))
        & (F.col("_at") == F.col("_bucket"))
        & (F.col("_lo") <= F.col("lo"))
        & (F.col("hi") <= F.col("_hi"))
    )
    # what the parent's interval holds besides the node's own
    left = ((F.col("lo") - F.col("_lo")) / width).cast("int") * WIDE
    siblings = F.struct(
        F.substring("_parts", F.lit(1), left).alias("left"),
        F.substring("_parts", left + WIDE + 1, F.length("_parts")).alias("right"),
    )
    path = F.concat(F.array(siblings), F.col("_path")).alias("path")
    return held.join(parents, inside).select(
        *nodes.columns, path, *(F.col(f"_{name}").alias(name) for name in carried)
    )


def paths(
    levels: list[DataFrame], tops: DataFrame | None, group: str, carried: list[str]
) -> DataFrame:
    """The rows of the lowest level with their path to what ``tops`` (group, path, carried)
    says lies above each group's only node; without ``tops`` that is nothing."""
    if tops is not None:
        tops = tops.select(F.col(group).alias("_group"), "path", *carried)
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    above = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        only = nodes.filter(complete())
        if tops is None:
            out = only.withColumn("path", nothing)
        else:
            out = only.join(tops, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
        if above is not None:
            rest = attached(nodes.filter(~complete()), above, group, FAN**k, carried)
            out = out.unionByName(rest)
        above = out if k == 0 else stage(out, "paths")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    held = ranked(stage(leaves(docs), "leaves"), "source", "doc_id", "leaf")
    held = held.withColumns(
        {"lo": F.col("rank"), "hi": F.col("rank") + 1, "digest": F.col("leaf")}
    ).drop("rank")
    trees = levels_of(held, "source")
    subroots = trees[0].filter(complete()).select("source", "digest")
    for level in trees[1:]:
        subroots = subroots.unionByName(level.filter(complete()).select("source", "digest"))
    subroots = ranked(stage(subroots, "subroots").withColumn("all", F.lit(0)), "all", "source")
    subroots = subroots.withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1}).drop("rank")
    top = levels_of(subroots, "all")
    found = top[-1].first()
    tops = paths(top, None, "all", []).select(
        "source", "path", F.col("digest").alias("subroot")
    )
    tops = bounded_broadcast(stage(tops, "subroot-paths"))
    out = paths(trees, tops, "source", ["subroot"])
    lists = F.transform("path", lambda x: F.concat(x.left, x.right))
    folded = F.aggregate(
        "path",
        F.coalesce("tampered", "leaf"),
        lambda below, x: F.sha2(F.concat(x.left, below, x.right), 256),
    )
    root = F.lit(found["digest"] if found else None).cast("string")
    return out.select(
        "doc_id",
        "leaf",
        "subroot",
        root.alias("root"),
        F.sha2(F.array_join(lists, ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
