"""Robots rules: parsing texts to rule rows, and matching URLs against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerwise.functions.urls import fold_dots, host_of, url_part
from offerwise.params import Params
from offerwise.session import staged

MAX_CRAWL_DELAY_MS = 30_000


def robots_rules(texts: DataFrame, params: Params) -> DataFrame:
    """``texts(domain, text)`` -> ``domain, kind, pattern, line`` of the rules for us.

    Consecutive agent lines open one group; a group applies when one of its agents is
    ``*`` or names our crawler.
    """
    c = F.col
    line = F.trim(F.split_part(c("raw"), F.lit("#"), F.lit(1)))
    lines = (
        texts.select("domain", F.posexplode(F.split("text", "\r?\n", -1)).alias("line", "raw"))
        .withColumn("text", line)
        .where(c("text").contains(":"))
        .select(
            "domain",
            "line",
            F.lower(F.trim(F.regexp_extract("text", "^([^:]*):", 1))).alias("field"),
            F.trim(F.regexp_extract("text", "^[^:]*:(.*)$", 1)).alias("value"),
        )
        .withColumn("is_agent", c("field") == "user-agent")
    )
    # a robots text is at most 500 kB, so a domain's lines are a bounded group
    by_line = Window.partitionBy("domain").orderBy("line")
    running = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = c("is_agent") & ~F.coalesce(F.lag("is_agent").over(by_line), F.lit(False))
    agent = F.lower("value")
    ours = c("is_agent") & (
        (agent == "*") | agent.contains(params.robots_agent.lower())
    )
    grouped = lines.withColumn("opens", opens).withColumns(
        {"group": F.sum(c("opens").cast("int")).over(running), "ours": ours}
    )
    applies = F.max("ours").over(Window.partitionBy("domain", "group"))
    ruled = grouped.withColumn("applies", applies).where(c("applies") & ~c("is_agent"))
    rules = ruled.where(c("field").isin("allow", "disallow") & (c("value") != "")).select(
        "domain", c("field").alias("kind"), c("value").alias("pattern"), "line"
    )
    seconds = F.when(
        c("value").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c("value")
    ).try_cast("double")
    delays = (
        ruled.where((c("field") == "crawl-delay") & (seconds > 0))
        .groupBy("domain")
        .agg(F.max_by(seconds, c("line")).alias("seconds"), F.max("line").alias("line"))
        .select(
            "domain",
            F.lit("crawl-delay").alias("kind"),
            F.least(F.lit(float(MAX_CRAWL_DELAY_MS)), c("seconds") * 1000)
            .cast("bigint")
            .cast("string")
            .alias("pattern"),
            "line",
        )
    )
    return rules.unionByName(delays)


def pattern_regex(pattern: Column) -> Column:
    """``*`` matches anything, a final ``$`` anchors, all else is literal."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, 1, F.length(pattern) - 1)).otherwise(pattern)
    literal = F.regexp_replace(body, r"([.+?^$\{\}()|\[\]\\])", r"\\$1")
    wild = F.regexp_replace(literal, r"\*", ".*")
    return F.concat(F.lit("^"), wild, F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def rule_nodes(rules: DataFrame) -> DataFrame:
    """The rules as rows of a prefix trie: domain, kind, ``literal`` (the beginning that is
    taken as it is), ``depth`` (its length), ``regex`` where there is more, ``size``."""
    c = F.col
    body = F.when(c("pattern").endswith("$"), F.expr("substring(pattern, 1, length(pattern) - 1)"))
    literal = F.split_part(F.coalesce(body, c("pattern")), F.lit("*"), F.lit(1))
    more = c("pattern").contains("*") | c("pattern").endswith("$")
    named = rules.where(c("kind").isin("allow", "disallow")).withColumn("literal", literal)
    return named.select(
        "domain",
        "kind",
        "literal",
        F.length("literal").alias("depth"),
        F.when(more, pattern_regex(c("pattern"))).alias("regex"),
        F.length("pattern").alias("size"),
    ).distinct()


# What URL parsers percent-encode in a path and in a query.
ENCODED_IN_PATH = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "`": "%60", "{": "%7B", "}": "%7D"}
ENCODED_IN_QUERY = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "'": "%27"}


def _encoded(value: Column, table: dict[str, str]) -> Column:
    for char, code in table.items():
        value = F.replace(value, F.lit(char), F.lit(code))
    return value


def target_of(url: Column) -> Column:
    """Path and query as rules see them: dot segments folded, encoded as URL parsers do."""
    bare = F.trim(url)
    path = F.translate(url_part(bare, 3), "\\", "/")
    path = F.when(path.rlike(r"/\.{1,2}(/|$)"), fold_dots(path)).otherwise(path)
    path = F.when(path == "", "/").otherwise(path)
    query = F.when(url_part(bare, 4) == "?", "").otherwise(url_part(bare, 4))
    return F.concat(_encoded(path, ENCODED_IN_PATH), _encoded(query, ENCODED_IN_QUERY))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(url_id, url)`` with ``allowed``: the longest matching rule decides, a tie allows.

    A longest-match join over the trie of rules: a target meets the depths that its domain's
    rules have, then the rules whose literal is its beginning of that depth, and only what
    lies behind is matched as a pattern. A domain may have any number of rules: nothing is
    gathered by domain, and rules that share no beginning with a target are never compared.
    A URL that is none, or not of the web, is refused.
    """
    c = F.col
    nodes = staged(rule_nodes(rules))
    host = host_of(c("url"))
    web = F.lower(url_part(c("url"), 1)).isin("http", "https")
    web = web & (host != "unknown") & ~host.rlike(r"[\s<>^|]")
    asked = staged(
        urls.select("url_id", "url").withColumns(
            {"domain": host, "web": F.coalesce(web, F.lit(False)), "target": target_of(c("url"))}
        )
    )
    depths = nodes.select("domain", "depth").distinct()
    begun = (
        asked.where("web")
        .select("domain", "target")
        .distinct()
        .join(depths, "domain")
        .where(c("depth") <= F.length("target"))
        .withColumn("literal", F.expr("substring(target, 1, depth)"))
        .drop("depth")
    )
    met = begun.join(nodes.drop("depth"), ["domain", "literal"]).where(
        c("regex").isNull() | F.rlike("target", c("regex"))
    )
    sizes = met.groupBy("domain", "target").agg(
        F.max(F.when(c("kind") == "disallow", c("size"))).alias("denied_by"),
        F.max(F.when(c("kind") == "allow", c("size"))).alias("allowed_by"),
    )
    judged = asked.join(sizes, ["domain", "target"], "left").withColumns(
        {n: F.when(c("web"), F.coalesce(n, F.lit(-1))).otherwise(-1) for n in ("denied_by", "allowed_by")}
    )
    allowed = c("web") & ((c("denied_by") < 0) | (c("allowed_by") >= c("denied_by")))
    return judged.select("url_id", "url", "denied_by", "allowed_by", allowed.alias("allowed"))
