"""Pages, links, listings, posts and robots texts."""

import datetime as dt
import json
from dataclasses import replace

from conftest import NOW
from pyspark.sql import functions as F

from offerwise.functions.messages import challenge_reason
from offerwise.operators import history
from offerwise.sources import links, pages, posts, registry, robots, search
from offerwise.sources.html import Page, page_anchors
from offerwise.sources.plaintext import text_candidates

PAGE = "page_id long, url string, source_name string, page_about_brand boolean, via string, html string"


def page(spark, *htmls, url="https://www.grabon.in/acme", about=True):
    rows = [(i, url, "grabon", about, "http", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, PAGE)


def offers(spark, params, *htmls, **context):
    return pages.page_candidates(page(spark, *htmls, **context), params).collect()


def test_card_with_attribute(spark, params):
    html = """<html><head><title>ACME Coupons</title></head><body>
      <div class="Coupon-card" data-coupon-code="ACME800"><h3>Flat Rs.800 OFF on orders above Rs.1,000</h3>
      <p>New users only. Valid till 31 August 2026.</p></div></body></html>"""
    (row,) = offers(spark, params, html)
    assert (row.code, row.discount_type, row.discount_value, row.minimum_order) == ("ACME800", "flat", 800, 1000)
    assert row.new_users_only and row.expiry_date == dt.datetime(2026, 8, 31, 23, 59, 59)


def test_code_lookup_order(spark, params):
    card = "<li class=offer>{}Rs.500 off at ACME today</li>"
    found = offers(
        spark, params,
        card.format('<button data-code="NESTED50">x</button>Use code TEXT50. '),
        card.format("Use code TEXT50. "),
        card.format("<span class='promoCode'>CHIP50</span> "),
        card.format("<b>NODIGITS</b> <strong>BOLD50</strong> "),
        "<li data-code='ATTR50' class=offer><i data-code='NESTED50'></i>Rs.500 off at ACME</li>",
    )
    assert {r.page_id: r.code for r in found} == {0: "NESTED50", 1: "TEXT50", 2: "CHIP50", 3: "BOLD50", 4: "ATTR50"}


def test_sale_banner_and_dropped_markup(spark, params):
    html = """<body><nav><li class=offer>Rs.9 off in the menu at ACME</li></nav><header><li>Rs.8 off here now</li></header>
      <script>"<li>Rs.7 off for everyone</li>"</script><li class="offer">UP TO 80% OFF SALE on styles</li></body>"""
    (row,) = offers(spark, params, html)
    assert (row.code, row.discount_type, row.is_up_to) == (None, "sale", True)


def test_jsonld(spark, params):
    node = {"@graph": [{"@type": "Offer", "name": "ACME India", "description": "Flat Rs.800 off on Rs.1000",
                        "couponCode": "LDCODE800", "validThrough": "2026-08-31"},
                       {"name": "no offer"}, {"discountCode": "ONLY50", "priceValidUntil": "August 30, 2026"}]}
    html = f'<body><script type="application/ld+json">{json.dumps(node)}</script><script type="application/ld+json">{{bad</script></body>'
    found = {r.code: r for r in offers(spark, params, html)}
    assert set(found) == {"LDCODE800", "ONLY50"}
    assert found["LDCODE800"].discount_value == 800
    assert found["LDCODE800"].expiry_date == dt.datetime(2026, 8, 31)
    assert found["ONLY50"].expiry_date == dt.datetime(2026, 8, 30)
    assert found["ONLY50"].raw_text == "coupon ONLY50"


def test_pages_off_topic_and_broken(spark, params):
    card = '<div class="coupon" data-coupon-code="OTHER500">Rs.500 off on Rs.2000 at Other</div>'
    assert offers(spark, params, card, url="https://x.in/", about=False) == []
    assert offers(spark, params, card, url="https://x.in/", about=None) == []
    assert len(offers(spark, params, card, url="https://x.in/acme", about=None)) == 1
    assert len(offers(spark, params, f"<title>acme</title>{card}", url="https://x.in/", about=None)) == 1
    assert len(offers(spark, params, '<div class="coupon"><span>Rs.800 off Rs.1000 ACME<div></span>')) == 1
    assert offers(spark, params, "<nav>Home</nav><div class=content><p>Discover the latest styles.</p></div>", "") == []


def test_page_cap(spark, params):
    cards = "".join(f'<div class="coupon" data-coupon-code="CODE{i}00">Rs.{i + 100} off Rs.1000</div>' for i in range(30))
    limited = replace(params, max_candidates_per_page=5)
    assert [r.code for r in sorted(offers(spark, limited, f"<body>{cards}</body>"), key=lambda r: r.pos)] == [f"CODE{i}00" for i in range(5)]


def test_bare_pages_are_read_as_text(spark, params):
    html = "<body><p>Use code ACME900 for Rs.900 off Rs.1000. Nothing here.</p></body>"
    assert [r.code for r in offers(spark, params, html)] == ["ACME900"]


def test_implied_end_tags():
    tree = Page("<ul><li>one<li>two <b>x</b></ul><p>a<p>b<br>c")
    texts = [tree.text_of(e) for e in tree.elements if e[0] in ("li", "p")]
    assert texts == ["one", "two x", "a", "bc"]


def texts(spark, params, text, about=True):
    df = spark.createDataFrame([(1, text, about)], "doc_id long, text string, about_brand boolean")
    return text_candidates(df, params).orderBy("pos").collect()


def test_text_candidates(spark, params):
    two = "Use code ACME800 for Rs.800 off Rs.1000. Use code NEW70 for 70% off up to Rs.700."
    assert [r.code for r in texts(spark, params, two)] == ["ACME800", "NEW70"]
    assert len(texts(spark, params, two[:41] + two[:41])) == 1
    (sale,) = texts(spark, params, "ACME India sale: up to 80% off on selected styles this week")
    assert (sale.code, sale.discount_type, sale.is_up_to) == (None, "sale", True)
    assert texts(spark, params, "ACME ships to most pin codes across the country") == []
    other = "Use code OTHER500 to get Rs.500 off on Rs.2000"
    assert texts(spark, params, other, about=False) == [] and len(texts(spark, params, other)) == 1


def test_promo_links(spark, params):
    html = "".join(f'<a href="{h}">{t}</a>' for h, t in [
        ("/coupon-a-1.html", "Coupons"), ("/promotion#top", "Promo"), ("/promotion", "again"),
        ("/campaign/new-in", "x"), ("/hotsale/B-sc-1.html", "coupon"), ("/some-p-1.html", "promo"),
        ("/sale/a.html?ici=nav", "promo"), ("https://us.acme.com/coupon", "x"), ("http://www.acme.in/coupon", "x"),
        ("https://in.acme.com/promotion", "x"), ("/about", "About"), ("/help", "New user help"),
    ])
    rows = spark.createDataFrame([(1, "https://www.acme.in/", html), (2, "https://www.acme.in/", "<a href=")],
                                 "page_id long, url string, html string")
    found = links.promo_links(rows, registry.official_hosts(params)).orderBy("pos").collect()
    assert [r.link for r in found] == [
        "https://www.acme.in/coupon-a-1.html", "https://www.acme.in/promotion",
        "https://www.acme.in/campaign/new-in", "https://in.acme.com/promotion", "https://www.acme.in/help",
    ]
    visited = spark.createDataFrame([("https://www.acme.in/promotion",)], "url string")
    step = links.frontier_step(links.promo_links(rows, registry.official_hosts(params)), visited, params)
    assert step.count() == 4
    assert len(list(page_anchors("<a href='/x'>t</a>" * 500))) == 500


def test_robots(spark, params):
    def rules(text):
        df = spark.createDataFrame([("a.in", text)], "domain string, text string")
        return [(r.kind, r.pattern) for r in robots.robots_rules(df, params).orderBy("line").collect()]

    assert rules("User-agent: *\nDisallow: /private\nAllow: /private/public") == [("disallow", "/private"), ("allow", "/private/public")]
    assert rules("User-agent: Googlebot\nDisallow: /\n\nUser-agent: *\nDisallow: /search") == [("disallow", "/search")]
    assert rules("User-agent: SomeBot\nUser-agent: *\nDisallow: /shared") == [("disallow", "/shared")]
    assert rules("User-agent: OfferWise/2\nDisallow: /nope") == [("disallow", "/nope")]
    assert rules("User-agent: *\nCrawl-delay: 5") == [("crawl-delay", "5000")]
    assert rules("User-agent: *\nCrawl-delay: 600") == [("crawl-delay", "30000")]
    assert rules("User-agent: *\nCrawl-delay: nonsense") == []
    assert rules("# c\nUser-agent: *\nDisallow: /x # t\nDisallow:\n") == [("disallow", "/x")]
    assert rules("") == rules("total nonsense") == []


def test_robots_patterns(spark):
    cases = [("/private/page", "/private", True), ("/public/page", "/private", False), ("/a/b/c.html", "/a/*/c.html", True),
             ("/search?q=x", "/*?q=", True), ("/page.html", "/page.html$", True), ("/page.html?a=1", "/page.html$", False),
             ("/a+b", "/a+b", True), ("/aab", "/a+b", False), ("/a(b)[c]{d}", "/a(b)[c]{d}", True)]
    df = spark.createDataFrame(cases, "path string, pattern string, want boolean")
    got = df.select("want", F.rlike("path", robots.pattern_regex(F.col("pattern"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_odd_links_and_many_rules(spark):
    import random
    import re

    rng = random.Random(4)
    parts = ["a", "b", "x|y", "c d", "{e}", "e+", "", "f.html", "..", "\u00e9"]
    urls = [f"{s}://{h}/" + "/".join(rng.choices(parts, k=rng.randint(0, 4))) + rng.choice(["", "?q=1 2", "?"])
            for s in ("http", "https", "ftp") for h in ("a.in", "b.in", "") for _ in range(80)]
    urls += ["https://a.in", "no url", "https://a b/x", "https://A.in:8080/a#f"]
    made = ["/", "/a", "/a/*", "/*/b", "/a/b$", "/x|y", "/*?q=", "/c%20d", "/%7Be%7D/*f.html$", "/e+", "*", "/b$", "/a$b"]
    rules = [(h, k, p) for h in ("a.in", "b.in") for p in made for k in ("allow", "disallow") if rng.random() < 0.5]
    rules += [("a.in", "disallow", f"/never/{i}") for i in range(2000)]

    def fits(target, pattern):
        body = re.escape(pattern.removesuffix("$")).replace(r"\*", ".*")
        return re.match(body + ("$" if pattern.endswith("$") else ""), target) is not None

    def want(url):
        m = re.match(r"(https?)://([a-zA-Z.]+)(:\d+)?(?=[/?#]|$)([^?#]*)(\?[^#]*)?", url)
        if not m:
            return False
        path, kept = m[4], []
        if "/.." in path:
            for part in path.split("/")[1:]:
                kept = kept[:-1] if part == ".." else [*kept, part]
            path = "/" + "/".join(kept) + ("/" if path.endswith("/..") and kept else "")
        query = "" if m[5] in (None, "?") else m[5]
        for char, code in ((" ", "%20"), ("{", "%7B"), ("}", "%7D")):
            path = path.replace(char, code)
        target = (path or "/") + query.replace(" ", "%20")
        sizes = {k: max([len(p) for h, kind, p in rules if h == m[2].lower() and kind == k and fits(target, p)], default=-1)
                 for k in ("allow", "disallow")}
        return sizes["disallow"] < 0 or sizes["allow"] >= sizes["disallow"]

    asked = spark.createDataFrame(list(enumerate(urls)), "url_id long, url string")
    ruled = spark.createDataFrame(rules, "domain string, kind string, pattern string")
    found = robots.robots_allowed(asked, ruled)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        assert r.allowed == want(urls[r.url_id]), urls[r.url_id]
    assert found.count() == len(urls)


def test_listings(spark, params):
    payload = json.dumps({"data": {"children": [
        {"data": {"title": "ACME deal", "selftext": "Use code ACME500 for Rs.500 off", "permalink": "/r/x/1",
                  "subreddit": "deals", "created_utc": 1755600000}},
        {"data": None}, {"data": {"title": "other"}}]}})
    df = spark.createDataFrame([(1, payload), (2, "{}"), (3, "broken")], "payload_id long, json string")
    (row,) = posts.post_candidates(df, params).collect()
    assert (row.code, row.source_name, row.source_url, row.source_type) == ("ACME500", "reddit:deals", "https://www.reddit.com/r/x/1", "community")
    assert row.discovered_at == dt.datetime(2025, 8, 19, 10, 40) and row.last_seen_at == NOW


def test_rank_hits(spark, params):
    hits = [("ACME coupon India", "https://a.in/acme"), ("ACME", "https://facebook.com/acme"), ("ACME coupon India", "https://a.in/acme"),
            ("shoes", "https://b.org/"), ("ACME", "https://acme.in/"), ("ACME", "ftp://acme.in/x")]
    df = spark.createDataFrame([(i, t, u, "") for i, (t, u) in enumerate(hits)], "seq long, title string, url string, snippet string")
    assert [r.url for r in search.rank_hits(df, params).collect()] == ["https://acme.in/", "https://a.in/acme"]


def test_copies(spark, params):
    fetched = [("u1", "http", "<p>coupon</p>"), ("u1", "chromium", "r"), ("u2", "http", "plain"), ("u2", "chromium", "r"), ("u3", "http", "plain")]
    df = spark.createDataFrame(fetched, "url string, via string, html string")
    assert {r.url: r.via for r in pages.pick_copy(df).collect()} == {"u1": "http", "u2": "chromium", "u3": "http"}
    found = spark.createDataFrame([(1, "http"), (1, "chromium"), (2, "chromium")], "page_id long, via string")
    assert sorted(tuple(r) for r in pages.pick_rendered(found).select("page_id", "via").collect()) == [(1, "http"), (2, "chromium")]


def test_challenges(spark):
    cases = [("Just a moment...", 200, "cloudflare interstitial"), ("<title>Attention Required! | x</title>", 200, "cloudflare block page"),
             ("hcaptcha.com/1/api.js", 200, "captcha widget"), ("you are blocked", 403, "http 403 with block markers"),
             ("you are blocked", 200, None), ("plain page", 403, None)]
    df = spark.createDataFrame(cases, "b string, s int, want string")
    assert all(r.want == r.got for r in df.select("want", challenge_reason(F.col("b"), F.col("s")).alias("got")).collect())


def test_registry(spark, params):
    rows = registry.source_registry(spark, replace(params, extra_source_urls=("https://www.more.in/p",))).orderBy("ordinal").collect()
    assert [r.name for r in rows][0] == "official" and len(rows) == 8 and all(r.enabled for r in rows)
    assert not registry.source_registry(spark, params).where("name = 'generic'").first().enabled
    extra = registry.registry_pages(registry.source_registry(spark, replace(params, extra_source_urls=("https://www.more.in/p",))))
    assert extra.where("name = 'generic'").first().label == "generic:more.in"


def test_replay_over_days(spark):
    rows = [(i, f"K{i % 3}", f"e{i}", NOW + dt.timedelta(hours=7 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "observation_id long, dedupe_key string, event string, observed_at timestamp")
    found = {r.observation_id: r for r in history.replay(df).collect()}
    assert all(found[i].previous_event == (f"e{i - 3}" if i >= 3 else None) for i in range(60))


def test_replay_of_a_hot_offer_day(spark):
    """An offer with a third of all rows within one day is cut into ranges."""
    rows = [(i, "HOT" if i % 3 == 0 else f"K{i % 7}", f"e{i}", NOW + dt.timedelta(seconds=i // 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "observation_id long, dedupe_key string, event string, observed_at timestamp")
    found = {r.observation_id: r for r in history.replay(df, hot_rows=100).collect()}
    assert len(found) == len(rows)
    last = {}
    for i, key, event, at in rows:
        before = last.get(key, (None, None))
        assert (found[i].previous_event, found[i].previous_at) == before, i
        last[key] = (event, at)
