"""URL filters: rules first, then naive Bayes over segmented host and path words.

1. Rules name a host and the beginning of a path. A rule fits its host and all subdomains;
   the longest that fits decides.
2. Host names concatenate words. Every run of letters is split by the most likely division
   under a unigram model of all words of page titles and URLs (Viterbi); a piece that isn't
   a known word costs as much as its length makes it unlikely. Only distinct names are
   split, and only the pieces of a name meet the word counts, by a join.
3. Host words and path words are the tokens of a multinomial naive Bayes model. It is
   counted over all URLs that a rule decides, with the rules' verdicts as labels, and decides
   the others. Counts and sums are taken over distinct hosts and paths with their numbers of
   rows, so that a host with a third of all pages is one row.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule
and no tokens, and gets the likelier verdict of the labelled URLs (allow without any);
hosts keep ports and user names, as the definition cuts at ``/ ? #`` only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerwise.llm.common import bounded_broadcast, lower_ascii, stage

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Longest word of the unigram model, in characters.
WORD_CHARS = 24
SMOOTH = 1.0
LETTERS = r"[\p{L}]+"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` text and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for own, start, word in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        name = F.when(fits, F.lit(own + start)).otherwise(name)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return name, verdict


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({LETTERS})"), F.lit(1))


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): all words of titles and URLs, path words and host names apart from dots."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    text = F.concat_ws(" ", title, host_of(F.col("url")), path_of(F.col("url")))
    words = pages.select(F.explode(letter_runs(text)).alias("word"))
    short = words.filter(F.length("word") <= WORD_CHARS)
    return short.groupBy("word").agg(F.count("*").alias("n"))


def best_division(name: str, costs: dict[str, float], unknown: float) -> list[str]:
    """Viterbi: the cheapest division of ``name``; a piece without a cost is charged
    ``unknown`` and ten times more for every character."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - WORD_CHARS), end):
            piece = name[start:end]
            cost = costs.get(piece, unknown + len(piece) * math.log(10))
            options.append((best[start] + cost, start))
        cost, start = min(options)
        best.append(cost)
        back.append(start)
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def _division_rows(unknown: float, total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_pylist()
            out = []
            for name, known in zip(names, batch.column("known").to_pylist(), strict=True):
                costs = {k["word"]: math.log(total / k["n"]) for k in known}
                # a name that stands in the counts only for itself must not be its own word
                if len(costs) > 1 and name in costs:
                    costs[name] += math.log(10) * len(name)
                out.append(best_division(name, costs, unknown))
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), pa.array(out, pa.list_(pa.string()))],
                names=["name", "words"],
            )

    return run


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct ``name`` rows."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    # every piece of a name of at most WORD_CHARS characters
    starts = F.sequence(F.lit(1), F.length("name"))
    pieces = names.select("name", F.explode(starts).alias("start")).select(
        "name",
        F.explode(
            F.transform(
                F.sequence(
                    F.lit(1), F.least(F.lit(WORD_CHARS), F.length("name") - F.col("start") + 1)
                ),
                lambda n: F.substring(F.col("name"), F.col("start"), n),
            )
        ).alias("word"),
    )
    known = pieces.distinct().join(counts, "word").groupBy("name").agg(
        F.collect_list(F.struct("word", "n")).alias("known")
    )
    none = F.array().cast("array<struct<word:string,n:bigint>>")
    rows = names.join(known, "name", "left").select(
        "name", F.coalesce("known", none).alias("known")
    )
    return rows.mapInArrow(
        _division_rows(math.log(total), total), "name string, words array<string>"
    )


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict."""
    rows = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    urls = stage(rows.groupBy("host", "path", "ruled").agg(F.count("*").alias("n")), "urls")
    counts = stage(word_counts(pages), "word-counts")

    hosts = urls.select("host").distinct()
    names = hosts.select(F.explode(letter_runs(F.col("host"))).alias("name")).distinct()
    divided = stage(segmented(stage(names, "names"), counts), "segmented")
    host_words = (
        hosts.select("host", F.posexplode(letter_runs(F.col("host"))).alias("at", "name"))
        .join(divided, "name")
        .select("host", F.explode("words").alias("word"))
        .groupBy("host", "word")
        .agg(F.count("*").alias("times"))
    )
    host_words = stage(host_words, "host-words")
    path_words = (
        urls.select("path")
        .distinct()
        .select("path", F.explode(letter_runs(F.col("path"))).alias("word"))
        .groupBy("path", "word")
        .agg(F.count("*").alias("times"))
    )
    path_words = stage(path_words, "path-words")

    # counts of (token, class) over the URLs that rules decide
    block = F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0))
    allow = F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0))
    classes = urls.filter("ruled is not null").agg(block.alias("b"), allow.alias("a")).first()
    n_block, n_allow = float(classes["b"] or 0), float(classes["a"] or 0)
    prior = math.log((n_block + SMOOTH) / (n_allow + SMOOTH)) if n_block + n_allow else -1.0

    def counted(words: DataFrame, side: str) -> DataFrame:
        ruled = urls.filter("ruled is not null").groupBy(side).agg(
            block.alias("b"), allow.alias("a")
        )
        return (
            words.join(ruled, side)
            .groupBy("word")
            .agg(
                F.sum(F.col("times") * F.col("b")).alias("b"),
                F.sum(F.col("times") * F.col("a")).alias("a"),
            )
            .withColumn("side", F.lit(side))
        )

    model = stage(counted(host_words, "host").unionByName(counted(path_words, "path")), "model")
    size = model.agg(F.count("*"), F.sum("b"), F.sum("a")).first()
    kinds, all_block, all_allow = float(size[0]), float(size[1] or 0), float(size[2] or 0)
    # an unseen word of one class and of the other differ by the classes' sizes only
    unseen = math.log((all_allow + SMOOTH * (kinds + 1)) / (all_block + SMOOTH * (kinds + 1)))
    odds = F.log((F.col("b") + SMOOTH) / (F.col("a") + SMOOTH)) + unseen

    def summed(words: DataFrame, side: str) -> DataFrame:
        own = bounded_broadcast(
            stage(model.filter(F.col("side") == side).select("word", odds.alias("odds")), "odds")
        )
        met = words.join(own, "word", "left")
        each = F.col("times") * F.coalesce("odds", F.lit(unseen))
        return stage(met.groupBy(side).agg(F.sum(each).alias(f"{side}_odds")), f"{side}-odds")

    host_odds = bounded_broadcast(summed(host_words, "host"))
    path_odds = bounded_broadcast(summed(path_words, "path"))
    total = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    guess = F.when(total > 0, "block").otherwise("allow")
    return (
        rows.join(host_odds, "host", "left")
        .join(path_odds, "path", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", guess).alias("verdict"))
    )
