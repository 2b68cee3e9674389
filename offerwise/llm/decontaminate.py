"""Benchmark decontamination: a prefix-filtered set join of item windows and documents.

A window is ``size`` consecutive words of an item; an item with fewer words is one
window. A document contains a window if the window's words stand in it side by side.

1. A window is a set of word shingles (three words, or all words of a shorter window).
   All of them must occur in a document that contains the window, so it is enough to look
   for one: the window's rarest shingle in the documents, its prefix.
2. Documents' shingles are met with the windows' shingles once. What is left gives the
   document frequencies that order shingles by rarity, and the rows of prefix shingles.
3. A prefix shingle found at word ``p`` that stands at offset ``j`` of the window puts the
   window's start at ``p - j``. Starts before the text or too near to its end are left out.
4. The words at that start are compared with the window, word by word.

Only DataFrame functions are used.

Defined results: a null or empty text has no words and is not contaminated; null item texts
have no windows; equal items under different ids all count, rows that repeat an item id
count once; documents that repeat a doc_id are judged each by its own text; a null item_id
takes part in hits but has no name to list and isn't counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.llm.common import bounded_broadcast, let, lower_ascii, same, stage, text_of

WINDOW = 13
SHINGLE = 3
#: A document is contaminated when hit words are at least one in so many.
HIT_SHARE = 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z."""
    return F.array_remove(F.split(lower_ascii(text_of(text)), SEPARATORS, -1), "")


def _hash(words: Column, start: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(words, start + k) for k in range(size)))


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""

    def runs(w: Column) -> Column:
        last = F.size(w) - size
        return F.when(
            last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _hash(w, i, size))
        ).otherwise(F.array().cast("array<bigint>"))

    return let(words, runs)


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, len, window): the windows of every item, each once per item."""
    words = items.select("item_id", words_of(F.col("text")).alias("words"))
    words = words.filter(F.size("words") > 0)
    length = F.least(F.lit(size), F.size("words"))
    starts = F.sequence(F.lit(0), F.size("words") - length)
    each = words.withColumn("len", length).select(
        "item_id", "len", "words", F.explode(starts).alias("start")
    )
    window = F.array_join(F.expr("slice(words, start + 1, len)"), " ")
    return each.select("item_id", "len", window.alias("window")).distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    share: int = HIT_SHARE,
) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items (array), contaminated."""
    own = docs.select("doc_id", "text")
    text_hash = F.xxhash64(text_of("text"))
    owned = stage(item_windows(items, size), "windows")
    # one row per distinct window; split on blanks gives its words back
    windows = owned.select("len", "window").distinct()
    split = F.split("window", " ", -1)
    sizes = sorted(r[0] for r in owned.select(F.least("len", F.lit(SHINGLE))).distinct().collect())
    pieces = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for q in sizes:
        pieces = pieces.when(F.least("len", F.lit(SHINGLE)) == q, _shingles(split, q))
    held = stage(
        windows.select("len", "window", F.posexplode(pieces).alias("offset", "token")),
        "window-shingles",
    )

    # (1) documents' shingles that any window has, with their places
    words = F.col("words")
    split_docs = own.select(
        "doc_id",
        text_hash.alias("text_hash"),
        words_of(F.col("text")).alias("words"),
    )
    met = None
    tokens = bounded_broadcast(stage(held.select("token").distinct(), "tokens"))
    for q in sizes or [SHINGLE]:
        rows = split_docs.select(
            "doc_id", "text_hash", F.size("words").alias("n"), _shingles(words, q).alias("all")
        ).select("doc_id", "text_hash", "n", F.posexplode("all").alias("place", "token"))
        rows = rows.join(tokens, "token", "left_semi")
        met = rows if met is None else met.unionByName(rows)
    met = stage(met, "met-shingles")

    # (2) rarity, then the prefix shingle of each window
    often = met.groupBy("token").agg(F.count("*").alias("often"))
    prefix = (
        held.join(often, "token")
        .groupBy("len", "window")
        # a shingle that no document has rules the window out, so all must be present
        .agg(
            F.min(F.struct("often", "offset", "token")).alias("rare"),
            F.count("*").alias("present"),
        )
        .filter(F.col("present") == F.col("len") - F.least("len", F.lit(SHINGLE)) + 1)
        .select("len", "window", F.col("rare.token").alias("token"), F.col("rare.offset"))
    )
    prefix = bounded_broadcast(stage(prefix, "prefixes"))

    # (3) starts that fit
    starts = (
        met.join(prefix, "token")
        .withColumn("start", F.col("place") - F.col("offset"))
        .filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("start", "len", "window")).alias("starts"))
    )

    # (4) exact comparison with the words of the text
    text = own.select(F.col("doc_id").alias("_id"), text_hash.alias("_hash"), "text")
    found = text.join(
        starts, same(F.col("_id"), F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    ).select(
        "doc_id",
        "text_hash",
        let(
            words_of(F.col("text")),
            lambda w: F.filter(
                "starts",
                lambda s: F.array_join(F.slice(w, s["start"] + 1, s["len"]), " ") == s["window"],
            ),
        ).alias("found"),
    )
    # rows equal in doc_id and text have equal occurrences
    found = found.filter(F.size("found") > 0).dropDuplicates(["doc_id", "text_hash"])
    found = stage(found, "occurrences")
    hit = F.array_distinct(
        F.flatten(
            F.transform("found", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))
        )
    )
    hits = found.select("doc_id", "text_hash", F.size(hit).cast("bigint").alias("n_hit"))
    named = (
        found.select("doc_id", "text_hash", F.explode("found.window").alias("window"))
        .distinct()
        .join(owned.filter("item_id is not null").select("item_id", "window"), "window")
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    judged = hits.alias("h").join(
        named.alias("i"),
        same(F.col("h.doc_id"), F.col("i.doc_id"))
        & (F.col("h.text_hash") == F.col("i.text_hash")),
        "left",
    ).select("h.doc_id", "h.text_hash", "n_hit", "items")
    every = own.select(
        F.col("doc_id").alias("_id"),
        text_hash.alias("_hash"),
        F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"),
    )
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return every.join(
        judged,
        same(F.col("_id"), F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")),
        "left",
    ).select(
        F.col("_id").alias("doc_id"),
        "_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
