"""Line dedup over levelled sorted runs of line hashes.

The store is a set of runs, each a Parquet folder of (k1, k2, docs) rows sorted by key: a
line key's 128-bit hash and the number of documents that have it. A new batch

1. merge-anti-joins the runs: keys that some run already proves frequent are settled and
   needn't be counted again;
2. adds the counts of its other keys as a run of level 0;
3. compacts: when a level has ``fan`` runs, they merge into one run of the next level.

A key is rewritten once per level, so adding n batches costs n log n rows of writing and
never re-reads old texts. Each run has one row per key, so a line that a third of all
documents share is one row per batch.

Defined results: a null or empty text is one empty line; the empty key is never dropped;
every row is a document, also one whose id or whole content others repeat.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwise.llm.common import bounded_broadcast, let, lower_ascii, shared_folder, stage, text_of

MIN_DOCS = 10
BATCHES = 4
#: Runs of a level that are merged into one of the next.
FAN = 2
STRIP = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(text_of(text), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(STRIP))
    # of ASCII alone both are the same, and the first is many times faster
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(lower_ascii(bare))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"))


@dataclass
class LineRuns:
    """The levelled store below one shared folder."""

    spark: SparkSession
    folder: str
    min_docs: int = MIN_DOCS
    fan: int = FAN
    levels: list[list[str]] = field(default_factory=list)
    _made: int = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.folder}/level-{level}-run-{self._made}"
        self._made += 1
        rows.sortWithinPartitions("k1", "k2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("k1 bigint, k2 bigint, docs bigint").parquet(*paths)

    def counts(self) -> DataFrame | None:
        """(k1, k2, docs) over all runs; None while there is no run."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return None
        return self._read(paths).groupBy("k1", "k2").agg(F.sum("docs").alias("docs"))

    def frequent(self) -> DataFrame | None:
        held = self.counts()
        return None if held is None else held.filter(F.col("docs") >= self.min_docs)

    def add(self, keys: DataFrame) -> None:
        """Take in one batch of (k1, k2) rows, one per document that has the key."""
        new = keys.groupBy("k1", "k2").agg(F.count("*").alias("docs"))
        known = self.frequent()
        if known is not None:
            new = new.join(known.select("k1", "k2"), ["k1", "k2"], "left_anti")
        self._write(new, 0)
        self._compact()

    def _compact(self) -> None:
        for level in range(64):
            if level >= len(self.levels) or len(self.levels[level]) < self.fan:
                return
            runs, self.levels[level] = self.levels[level], []
            merged = self._read(runs).groupBy("k1", "k2").agg(F.sum("docs").alias("docs"))
            self._write(merged, level + 1)


def drop_common_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    store: LineRuns | None = None,
) -> DataFrame:
    """One row per document row: ``doc`` (the input row), kept (text), n_lines, n_dropped.

    Keys found in at least ``min_docs`` documents of the store, this input included, lose
    all their lines. Pass a ``store`` to go on from earlier inputs.
    """
    spark = docs.sparkSession
    store = store or LineRuns(spark, shared_folder(spark, "line-runs"), min_docs)
    rows = docs.select(
        F.struct("*").alias("doc"), F.xxhash64(text_of("text")).alias("text_hash")
    )
    lines = lines_of(F.col("doc.text"))
    keys = let(
        F.transform(lines, line_key),
        lambda found: F.array_distinct(F.transform(F.filter(found, lambda x: x != ""), _hashed)),
    )
    # one row per document row and key
    held = rows.select(F.col("doc.doc_id").alias("doc_id"), "text_hash", F.explode(keys).alias("k"))
    batch = F.pmod(F.col("text_hash"), F.lit(batches)).cast("int").alias("batch")
    seen = stage(held.select("doc_id", "text_hash", "k.k1", "k.k2", batch), "line-keys")
    for b in range(batches):
        store.add(seen.filter(F.col("batch") == b).select("k1", "k2"))
    frequent = bounded_broadcast(stage(store.frequent().select("k1", "k2"), "frequent-lines"))
    drops = (
        seen.join(frequent, ["k1", "k2"], "left_semi")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("k1", "k2")).alias("drops"))
        .withColumnRenamed("text_hash", "_hash")
    )
    joined = rows.join(
        drops,
        F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("text_hash") == F.col("_hash")),
        "left",
    )
    stays = F.filter(
        lines,
        lambda x: F.col("drops").isNull() | ~F.array_contains(F.col("drops"), _hashed(line_key(x))),
    )
    return joined.select("doc", lines.alias("lines"), stays.alias("stays")).select(
        "doc",
        F.array_join("stays", "\n").alias("kept"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("stays")).cast("bigint").alias("n_dropped"),
    )
