"""Pages and URLs as the web has them: odd markup, odd characters, no limits."""

import json
import time

import pytest
from pyspark.sql import functions as F

from offerwise.functions.urls import host_of, normalise_domain, resolve_url
from offerwise.sources.candidates import offers_only
from offerwise.sources.html import page_parts, page_results, raw_parts
from offerwise.sources.pages import pick_copy
from offerwise.sources.plaintext import chunks


def nodes(html):
    return [p for p in page_parts(html) if p["kind"] == "node"]


def jsonld(value):
    raw = value if isinstance(value, str) else json.dumps(value)
    found = page_parts(f'<script type="application/ld+json">{raw}</script>')
    return [p for p in found if p["kind"] in ("jsonld", "error")]


def test_marked_sections_are_comments():
    found = nodes("<ul><li>10% off <![foo[x]]> all orders</li></ul><![if IE]>x<![endif]>")
    assert [n["text"] for n in found] == ["10% off all orders"]


def test_deep_json_is_reported():
    found = jsonld("[" * 200_000 + "]" * 200_000)
    assert [f["kind"] for f in found] == ["error"]
    after = '<script type="application/ld+json">{"name": "10% off"}</script>'
    deep = '<script type="application/ld+json">' + "[" * 200_000 + "</script>"
    kinds = [p["kind"] for p in page_parts(deep + after)]
    assert kinds == ["error", "jsonld", "body"] or kinds == ["jsonld", "body"]


def test_half_surrogates_are_replaced(spark):
    page = '<script type="application/ld+json">{"name": "off \\ud83d 10%"}</script>'
    rows = spark.createDataFrame([(1, page)], "page_id bigint, html string")
    found = raw_parts(rows).filter("kind = 'jsonld'").collect()
    assert [r["text"] for r in found] == ["off ? 10%"]


def test_every_node_container_chip_and_result_is_read():
    many = [{"name": f"offer {i}"} for i in range(5000)]
    assert len(jsonld(many)) == 5000
    assert len(nodes("<li>an offer</li>" * 1200)) == 1200
    chips = "".join(f"<b>CODE{i}</b>" for i in range(40))
    assert len(nodes(f"<li>{chips}</li>")[0]["chips"]) == 40
    row = "<div class=result><a class=result__a href=/x>t</a></div>"
    assert len(list(page_results(row * 60))) == 60


def test_titles_cut_within_a_reference():
    """A reference without its semicolon is text in a title; others are read."""
    found = list(page_parts("<title>a &amp;amp; b &#233;&quot;&am</title><p>x &amp y</p>"))
    assert {p["title"] for p in found} == {'a &amp; b é"&am'}
    assert found[-1]["text"].endswith("x & y")
    assert list(page_parts("<title>and&amp;&amp</title>"))[0]["title"] == "and&&amp"


def test_pages_that_share_a_url_keep_their_own_copy(spark):
    rows = [(1, "u", "http", "x"), (1, "u", "chromium", ""), (2, "u", "http", "10% off")]
    fetched = spark.createDataFrame(rows, "page_id bigint, url string, via string, html string")
    kept = pick_copy(fetched, ("page_id", "url")).select("page_id", "via").collect()
    assert sorted(map(tuple, kept)) == [(1, "chromium"), (2, "http")]
    assert pick_copy(fetched).count() == 1


def test_positions_go_on_from_nodes_to_containers():
    page = (
        '<script type="application/ld+json">[{"name": "a"}, {"name": "b"}]</script>'
        "<li>one offer</li><li>two offers</li>"
    )
    places = [p["pos"] for p in page_parts(page) if p["kind"] != "body"]
    assert places == sorted(set(places)) and len(places) == 4


def test_nested_containers_cost_what_they_emit():
    text = "words and more words of an offer " * 8
    deep = "<div class=offer>" * 400 + text * 40 + "</div>" * 400
    assert sum(len(n["text"]) for n in nodes(deep)) == 0
    wide = "<div class=offer>" * 3000 + "".join(f"<b>C{i}</b>" for i in range(300))
    began = time.perf_counter()
    assert len(nodes(wide)) == 3000
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(
    ("url", "host"),
    [
        ("https://a.example/x|y", "a.example"),
        ("https://A.example:8080/{x} y", "a.example"),
        ("http://user:pw@www.b_c.example?q", "www.b_c.example"),
        ("https://d.example#f", "d.example"),
        ("//e.example/x", "unknown"),
        ("no url", "unknown"),
    ],
)
def test_hosts(spark, url, host):
    row = spark.range(1).select(host_of(F.lit(url)), normalise_domain(F.lit(url))).first()
    assert row[0] == host
    if host != "unknown":
        assert row[1] == host.removeprefix("www.")


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("../../../../../coupon", "https://a.example/coupon"),
        ("../x|y", "https://a.example/d/e/f/x|y"),
        ("./z?q=../s#../t", "https://a.example/d/e/f/g/z?q=../s#../t"),
        ("/k/./l/../m/", "https://a.example/k/m/"),
        ("..", "https://a.example/d/e/f/"),
        ("//o.example", "https://o.example/"),
        ("mailto:x@y", "mailto:x@y"),
    ],
)
def test_links(spark, href, want):
    base = F.lit("https://a.example/d/e/f/g/h?x#y")
    assert spark.range(1).select(resolve_url(F.lit(href), base)).first()[0] == want


def test_all_chunks_of_a_text(spark):
    text = " ".join(f"Offer number {i} is here." for i in range(700))
    assert len(spark.range(1).select(chunks(F.lit(text))).first()[0]) == 700


def test_texts_are_parsed_once(spark, params):
    """The test for usable terms stays above the parsing and is not written out below it."""
    rows = spark.createDataFrame([(1, "Flat Rs.200 off"), (2, "Good morning everyone")], "doc_id bigint, raw_text string")
    named = rows.withColumn("code", F.lit(None).cast("string"))
    found = offers_only(named, params)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.lower().count("regexp") for line in plan.splitlines()) < 40
    assert [(r.doc_id, r.discount_value) for r in found.collect()] == [(1, 200.0)]
