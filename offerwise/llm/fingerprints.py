"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is a set of digests: its paragraphs (lines), each cut every ``BLOCK`` words so that
one long paragraph isn't one digest. A sketch has three parts of ``part`` cells; a digest
adds itself to one cell in each part: a count, the xor of digests and the xor of check sums.

Sketches of two versions subtract cell by cell: what both have cancels. A cell whose count
is 1 or -1 and whose check sum fits holds one digest alone; taking it out of its other two
cells frees more (peeling). When nothing is left, the digests that differ are recovered with
their side. Sketches that don't peel out are made again, larger and with other hashes.

Peeling takes one part of the sketch at a time: there a digest has exactly one cell, so no
digest is taken out twice. All rounds are generate and hash-aggregate steps over cells that
lie together by document, so nothing is shuffled between rounds. Only DataFrame functions
are used.

Defined results: a null text is empty; an empty text has one empty paragraph; a paragraph
that repeats in a text counts once; repeated doc_ids follow each other by a hash of their
text; null doc_ids come first; a lone document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerwise.llm.common import bounded_broadcast, let, same, shared_folder, stage, text_of

#: Words of a paragraph that make one digest.
BLOCK = 8
#: Cells in each of the three parts of a fingerprint.
PART = 8
#: Peeling rounds, each over one part.
ROUNDS = 15
#: Documents in one range, and paragraph digests in one task.
RANGE_ROWS = 5_000
#: Ranges that are cut at quantiles; more ranges divide each of these evenly.
QUANTILES = 128
TASK_DIGESTS = 150_000


def digests(text: Column, block: int = BLOCK) -> Column:
    """Distinct 64-bit digests of the text's paragraphs."""

    def cut(line: Column) -> Column:
        return let(
            F.split(line, " ", -1),
            lambda words: F.transform(
                F.sequence(F.lit(0), F.size(words) - 1, F.lit(block)),
                lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, block), " ")),
            ),
        )

    return F.array_distinct(F.flatten(F.transform(F.split(text, "\n", -1), cut)))


def check_sum(digest: Column) -> Column:
    return F.xxhash64(F.lit("check"), digest)


def cell_of(digest: Column, part: Column, k: int, seed: Column) -> Column:
    return (F.pmod(F.xxhash64(seed, F.lit(k), digest), part) + k * part).cast("bigint")


def add_digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the signed ``sign``, ``digest`` rows, by ``keys`` (with ``part``, ``seed``)."""
    digest, part, seed = F.col("digest"), F.col("part"), F.col("seed")
    cells = F.explode(F.array(*(cell_of(digest, part, k, seed) for k in range(3))))
    return (
        rows.select(*keys, "sign", "digest", cells.alias("cell"))
        .groupBy(*keys, "cell")
        .agg(
            F.sum("sign").alias("n"),
            F.bit_xor("digest").alias("digest"),
            F.bit_xor(check_sum(F.col("digest"))).alias("check"),
        )
        .filter("n <> 0 or digest <> 0 or check <> 0")
    )


def peel(cells: DataFrame, keys: list[str], rounds: int = ROUNDS) -> DataFrame:
    """``keys``, plus, minus (digests found on either side), stuck (cells that are left)."""
    digest, part, seed = F.col("digest"), F.col("part"), F.col("seed")
    rows = cells.select(
        *keys, "cell", "n", "digest", "check",
        F.lit(0).cast("bigint").alias("plus"), F.lit(0).cast("bigint").alias("minus"),
    )
    none = F.lit(0).cast("bigint")
    for step in range(rounds):
        k = step % 3
        alone = (
            (F.col("cell") >= k * part)
            & (F.col("cell") < (k + 1) * part)
            & (F.abs("n") == 1)
            & (F.col("check") == check_sum(digest))
        )

        def row(cell, n, own, check, plus, minus):
            names = ("cell", "n", "digest", "check", "plus", "minus")
            return F.struct(
                *(c.alias(a) for a, c in zip(names, (cell, n, own, check, plus, minus), strict=True))
            )

        found = row(
            F.lit(-1).cast("bigint"), none, none, none,
            (F.col("n") == 1).cast("bigint"), (F.col("n") == -1).cast("bigint"),
        )
        others = [
            row(cell_of(digest, part, j, seed), -F.col("n"), digest, F.col("check"), none, none)
            for j in range(3)
            if j != k
        ]
        stays = row(*(F.col(c) for c in ("cell", "n", "digest", "check", "plus", "minus")))
        rows = (
            rows.select(*keys, F.explode(F.when(alone, F.array(found, *others)).otherwise(F.array(stays))).alias("r"))
            .select(*keys, "r.*")
            .groupBy(*keys, "cell")
            .agg(
                F.sum("n").alias("n"),
                F.bit_xor("digest").alias("digest"),
                F.bit_xor("check").alias("check"),
                F.sum("plus").alias("plus"),
                F.sum("minus").alias("minus"),
            )
            .filter("n <> 0 or digest <> 0 or check <> 0 or cell < 0")
        )
    return rows.groupBy(*keys).agg(
        F.sum("plus").alias("plus"),
        F.sum("minus").alias("minus"),
        F.sum((F.col("cell") >= 0).cast("bigint")).alias("stuck"),
    )


def likeness(pairs: DataFrame, much: bool = False) -> DataFrame:
    """(row, side, likeness) of (row, side, a, b) rows, a and b the digests of two texts.

    Sketches of ``PART`` cells first; those that don't peel out again with room for every
    digest, then each time twice as large. Texts that differ ``much`` get the room at once.
    """
    spark = pairs.sparkSession
    folder = shared_folder(spark, "likeness")
    total = F.size("a") + F.size("b")
    # three parts of this size have one and a half cells for each digest of either text
    room = F.ceil(total / 2) + 4
    first = F.greatest(F.lit(PART), room) if much else F.lit(PART)
    left = pairs.withColumns({"part": first.cast("bigint"), "seed": F.lit(0)})
    keys = ["row", "side", "part", "seed"]
    level = 0
    while True:
        weight = left.agg(F.sum(total)).first()[0]
        if weight is None:
            break
        parts = max(spark.sparkContext.defaultParallelism, weight // TASK_DIGESTS)
        own = left.repartition(parts, "row")
        signed = F.explode(
            F.concat(
                F.transform("a", lambda d: F.struct(F.lit(1).alias("sign"), d.alias("digest"))),
                F.transform("b", lambda d: F.struct(F.lit(-1).alias("sign"), d.alias("digest"))),
            )
        )
        cells = add_digests(own.select(*keys, signed.alias("s")).select(*keys, "s.*"), keys)
        path = f"{folder}/level-{level}"
        peel(cells, keys).write.parquet(path)
        done = spark.read.parquet(path)
        stuck = stage(done.filter("stuck > 0").select("row", "side"), "stuck")
        if stuck.isEmpty():
            break
        level += 1
        again = F.greatest(F.col("part") * 2, room).cast("bigint")
        left = left.join(stuck, ["row", "side"], "left_semi").withColumns(
            {"part": again, "seed": F.lit(level)}
        )
    # a pair without any cell differs in nothing
    differ = (
        spark.read.schema("row bigint, side string, plus bigint, minus bigint, stuck bigint")
        .parquet(*(f"{folder}/level-{k}" for k in range(level + 1)))
        .filter("stuck = 0")
        if weight is not None
        else spark.createDataFrame([], "row bigint, side string, plus bigint, minus bigint")
    )
    differ = differ.select("row", "side", (F.col("plus") + F.col("minus")).alias("differ"))
    sizes = pairs.select("row", "side", total.alias("total"))
    differs = F.coalesce("differ", F.lit(0))
    return sizes.join(differ, ["row", "side"], "left").select(
        "row", "side", ((F.col("total") - differs) / (F.col("total") + differs)).alias("likeness")
    )


def sketch_text(cells: Column) -> Column:
    """Cells in order as text: place, count and digest xor of those that aren't empty."""
    each = F.transform(
        F.array_sort(cells), lambda c: F.concat_ws(":", c["cell"], c["n"], F.lower(F.hex(c["digest"])))
    )
    return F.array_join(each, ",")


def followed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, next_text): every document with the next in ascending doc_id, the
    last with the first.

    Documents are dealt into ranges of their ids. Each range also gets a copy of the first
    row of the range that follows, so no row has to look beyond its range.
    """
    own = docs.select("doc_id", text_of("text").alias("text"))
    own = own.withColumn("text_hash", F.xxhash64("text"))
    size = own.agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    size = size.first()
    ranges = max(1, size["n"] // RANGE_ROWS)
    coarse = min(ranges, QUANTILES)
    fine = -(-ranges // coarse)
    shares = [i / coarse for i in range(1, coarse)]
    cuts = own.approxQuantile("doc_id", shares, 0.1 / coarse) if shares else []
    ends = sorted({int(c) for c in cuts} | {size["lo"] or 0, (size["hi"] or 0) + 1})
    cut = F.array(*map(F.lit, ends)).cast("array<bigint>")
    # the quantile's range, then the part of it; null ids come first
    nth = F.size(F.filter(cut, lambda c: c <= F.col("doc_id"))).cast("bigint")
    lo, hi = F.get(cut, F.col("nth").cast("int") - 1), F.get(cut, F.col("nth").cast("int"))
    part = F.floor((F.col("doc_id") - lo) / (hi - lo) * fine)
    place = F.col("nth") * fine + F.least(part, F.lit(fine - 1))
    own = own.withColumn("nth", nth).withColumn("range", F.coalesce(place, F.lit(0)).cast("bigint"))
    own = own.drop("nth")
    id_order = F.struct(F.col("doc_id").isNotNull(), "doc_id", "text_hash")
    # one row per range
    firsts = own.groupBy("range").agg(F.min(id_order).alias("first"))
    by_range = Window.partitionBy(F.lit(0)).orderBy("range")
    everywhere = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = F.coalesce(F.lag("range").over(by_range), F.last("range").over(everywhere))
    firsts = stage(
        firsts.select(
            F.col("first.doc_id").alias("_id"),
            F.col("first.text_hash").alias("_hash"),
            ahead.alias("ahead"),
        ),
        "firsts",
    )
    copies = (
        own.join(bounded_broadcast(firsts), same(F.col("doc_id"), F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
        .dropDuplicates(["ahead"])
        .select("doc_id", "text", "text_hash", F.col("ahead").alias("range"), F.lit(1).alias("copy"))
    )
    both = own.withColumn("copy", F.lit(0)).unionByName(copies)
    order = Window.partitionBy("range").orderBy(
        "copy", F.col("doc_id").asc_nulls_first(), "text_hash"
    )
    rows = both.select(
        (F.col("range") * 2**40 + F.row_number().over(order)).alias("row"),
        "doc_id",
        "copy",
        "text",
        F.lead("text").over(order).alias("next_text"),
    )
    return rows.filter("copy = 0").drop("copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"),
        F.left(F.col("next_text"), half),
    )
    rows = followed(docs).withColumn("edited", edited)
    rows = stage(
        rows.select(
            "row",
            "doc_id",
            F.length("text").cast("bigint").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            digests(F.col("text")).alias("a"),
            digests(F.col("edited")).alias("e"),
            digests(F.col("next_text")).alias("b"),
        ),
        "versions",
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit("edited").alias("side"), F.col("e").alias("b")),
            F.struct(F.lit("next").alias("side"), F.col("b").alias("b")),
        )
    )
    pairs = rows.select("row", "a", sides.alias("s")).select("row", "a", "s.side", "s.b")
    # half of an edited text is another's, and so is all of the next document
    near = likeness(pairs, much=True)
    near = near.groupBy("row").agg(
        F.max(F.when(F.col("side") == "edited", F.col("likeness"))).alias("near_edited"),
        F.max(F.when(F.col("side") == "next", F.col("likeness"))).alias("near_next"),
    )
    keys = ["row", "version", "part", "seed"]
    versions = F.explode(
        F.array(
            F.struct(F.lit(0).alias("version"), F.col("a").alias("d")),
            F.struct(F.lit(1).alias("version"), F.col("e").alias("d")),
        )
    )
    weight = rows.agg(F.sum(F.size("a") + F.size("e"))).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, weight // TASK_DIGESTS)
    each = (
        rows.select("row", "a", "e")
        .repartition(parts, "row")
        .select("row", versions.alias("v"))
        .select("row", "v.version", F.explode("v.d").alias("digest"))
        .withColumns(
            {"sign": F.lit(1), "part": F.lit(PART).cast("bigint"), "seed": F.lit(0)}
        )
    )
    cells = add_digests(each, keys)
    sketch = sketch_text(F.collect_list(F.struct("cell", "n", "digest")))
    printed = (
        cells.groupBy("row", "version")
        .agg(sketch.alias("sketch"))
        .groupBy("row")
        .agg(
            F.max(F.when(F.col("version") == 0, F.col("sketch"))).alias("fingerprint"),
            F.max(F.when(F.col("version") == 1, F.col("sketch"))).alias("edited_fingerprint"),
        )
    )
    return (
        rows.select("row", "doc_id", "n_chars", "edited_sha256")
        .join(printed, "row")
        .join(near, "row")
        .drop("row")
    )
