"""The training-data pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwise.llm import decontaminate, lines, minhash, packing, toxicity
from offerwise.llm.common import bounded_broadcast, stage, table, text_of


#: Near duplicates have a Jaccard similarity of at least so many hundredths; with so many
#: bands of five coordinates a pair right at it misses all buckets once in 150,000.
SIMILAR, BANDS = 80, 30


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but those whose id and text are among the (_id, _hash) rows of ``gone``."""
    gone = bounded_broadcast(stage(gone.distinct(), "gone"))
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(text_of("text")).alias("hash"))
    met = F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    return rows.join(gone, met, "left_anti").select("doc.*")


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labelled ones among them, rejects go."""
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("doc"), text_of("text").alias("_text"))
    return toxicity.scored(rows, grammar).filter(F.col("_score") < toxicity.THRESHOLD).select("doc.*")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines leave the texts; all documents stay."""
    out = lines.drop_common_lines(docs)
    new = {
        "text": F.when(F.col("doc.text").isNotNull(), F.col("kept")),
        "n_chars": F.length("kept").cast("bigint"),
    }
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the smallest id that is not null, among
    its rows the least text hash, and one of the rows that are equal in both. Texts without
    shingles are in no group and all stay.
    """
    out = minhash.placed_rows(docs, SIMILAR, BANDS).filter("component is not null")
    out = stage(out.select("component", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "placed")
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash")
    groups = out.groupBy("component").agg(F.min(order).alias("kept"), F.count("*").alias("n"))
    groups = bounded_broadcast(stage(groups.filter("n > 1").drop("n"), "groups"))
    pairs = out.join(groups, "component").groupBy("_id", "_hash").agg(
        F.first(order.eqNullSafe(F.col("kept"))).alias("stays"), F.count("*").alias("n")
    )
    pairs = stage(pairs, "pairs")
    gone = pairs.filter("not stays or n > 1").select("_id", "_hash")
    repeated = stage(pairs.filter("stays and n > 1").select("_id", "_hash"), "repeated")
    rest = without(docs, gone)
    if repeated.isEmpty():
        return rest
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(text_of("text")).alias("hash"))
    met = F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    one = (
        rows.join(bounded_broadcast(repeated), met, "left_semi")
        .groupBy("doc.doc_id", "hash")
        .agg(F.min_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc"))
    )
    return rest.unionByName(one.select("doc.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, judged.filter("contaminated").select(F.col("doc_id").alias("_id"), "_hash"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", nontoxic),
    ("line dedup", without_common_lines),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: Tokenizers and a learned grammar are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
