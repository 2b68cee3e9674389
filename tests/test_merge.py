"""The closed merge forms against a plain sequential fold."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from conftest import NOW, ago
from pyspark.sql import functions as F

from offerwise.operators import merge, skew
from offerwise.operators.dedupe import cycle_dedupe, dedupe_key, page_dedupe, source_cap
from offerwise.plans import discovery
from offerwise.schemas import CLAIMS, OFFERS, names, violations

COLUMNS = names(CLAIMS)
COMPARED = [
    "discount_type", "discount_value", "minimum_order", "maximum_discount", "is_up_to",
    "minimum_order_known", "existing_users_allowed", "expiry_date", "new_users_only", "app_only",
]


def claim(seq, key, **values):
    base = dict.fromkeys(COLUMNS)
    base.update(
        seq=seq, dedupe_key=key, code=key[5:], title="t", raw_text="t", discount_type="flat",
        is_up_to=False, minimum_order_known=False, source_name="a", source_url="https://a.in/",
        source_type="coupon-site", source_domain="a.in", discovered_at=NOW, last_seen_at=NOW,
    )
    base.update(values)
    return base


def random_claims(n, keys, seed, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        key = "CODE:HOT1" if rng.random() < hot else f"CODE:K{rng.randrange(keys)}X"
        kind = rng.choice(["flat", "percentage", "unknown", "cashback"])
        minimum = rng.choice([None, None, 500.0, 900.0, 1200.0])
        source = rng.randrange(5)
        rows.append(
            claim(
                seq, key,
                discount_type=kind,
                # values of untyped claims are rare but legal
                discount_value=rng.choice([None, 100.0, 200.0, 300.0]),
                minimum_order=minimum,
                minimum_order_known=minimum is not None and rng.random() < 0.8,
                maximum_discount=rng.choice([None, None, 50.0, 80.0]),
                is_up_to=rng.random() < 0.3,
                new_users_only=rng.choice([None, True]),
                app_only=rng.choice([None, None, True]),
                existing_users_allowed=rng.choice([None, True, False]),
                expiry_date=rng.choice([None, ago(days=1), ago(days=-5), ago(days=-9)]),
                source_name=f"s{source}", source_url=f"https://s{source}.in/",
                source_domain=f"s{source}.in",
                source_type="official" if rng.random() < 0.25 else "coupon-site",
                last_seen_at=ago(hours=rng.randrange(2000)),
            )
        )
    return rows


def fold(rows):
    """Plain sequential merging, claim by claim, in arrival order."""
    offers = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        o = offers.get(r["dedupe_key"])
        off = r["source_type"] == "official"
        if o is None:
            o = offers[r["dedupe_key"]] = {k: r[k] for k in COMPARED}
            o["status"] = "unverified"
        else:
            t, v = r["discount_type"], r["discount_value"]
            if o["discount_type"] == "unknown" and t != "unknown":
                o["discount_type"], o["discount_value"] = t, v
            elif off and t != "unknown":
                o["discount_type"] = t
                if v is not None:
                    o["discount_value"] = v
            elif o["discount_value"] is None and v is not None:
                o["discount_value"] = v
            m = r["minimum_order"]
            if r["minimum_order_known"] and m is not None:
                if not o["minimum_order_known"] or o["minimum_order"] is None:
                    o["minimum_order"], o["minimum_order_known"] = m, True
                elif off or m > o["minimum_order"]:
                    o["minimum_order"] = m
            cap = r["maximum_discount"]
            if cap is not None:
                replaces = o["maximum_discount"] is None or off
                o["maximum_discount"] = cap if replaces else min(o["maximum_discount"], cap)
            o["is_up_to"] = r["is_up_to"] if off else o["is_up_to"] or r["is_up_to"]
            for flag in ("new_users_only", "app_only"):
                o[flag] = True if r[flag] else o[flag]
            e = r["existing_users_allowed"]
            if e is not None and (off or o["existing_users_allowed"] is None):
                o["existing_users_allowed"] = e
            x = r["expiry_date"]
            if x is not None and (o["expiry_date"] is None or off or x < o["expiry_date"]):
                o["expiry_date"] = x
        if o["expiry_date"] is not None and o["expiry_date"] < NOW:
            o["status"] = "expired"
    return offers


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], CLAIMS)


@pytest.mark.parametrize("path", ["broadcast", "split", "hot"])
def test_merge_terms_is_the_fold(spark, params, monkeypatch, path):
    rows = random_claims(3000, 150, seed=7, hot=0.35)
    tuned = params
    if path != "broadcast":
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    if path == "hot":
        tuned = replace(params, hot_min_rows=50, hot_share=4)
    found = merge.merge_terms(frame(spark, rows).repartition(7), tuned).collect()
    expected = fold(rows)
    assert len(found) == len(expected)
    for row in found:
        want = expected[row.dedupe_key]
        assert {k: row[k] for k in COMPARED} == {k: want[k] for k in COMPARED}, row.dedupe_key
        assert (row.expired_by is not None) == (want["status"] == "expired")


def test_upsert_in_batches_is_upsert_at_once(spark, params):
    rows = random_claims(900, 60, seed=3, hot=0.3)
    expected = fold(rows)
    stored = discovery.empty_store(spark)
    for part in (rows[:200], rows[200:500], rows[500:]):
        step = discovery.upsert(stored, frame(spark, part), params)
        stored = discovery.Stored(step.offers.cache(), step.sources.cache())
    once = discovery.upsert(discovery.empty_store(spark), frame(spark, rows), params)
    whole = {r.dedupe_key: r for r in once.offers.collect()}
    parts = {r.dedupe_key: r for r in stored.offers.collect()}
    assert whole.keys() == parts.keys() == expected.keys()
    same = [n for n in names(OFFERS) if n not in ("updated_at",)]
    for key, row in parts.items():
        assert {n: row[n] for n in same} == {n: whole[key][n] for n in same}, key
        assert row.status == expected[key]["status"]
    pages = ["dedupe_key", "source_name", "source_url", "claim_value", "last_seen_at"]
    a = sorted(map(str, stored.sources.select(*pages).collect()))
    b = sorted(map(str, once.sources.select(*pages).collect()))
    assert a == b
    assert violations(once.offers).count() == 0


def test_upsert_events(spark, params):
    first = [claim(1, "CODE:A1BC", discount_value=800.0), claim(2, "CODE:B1CD", discount_value=1.0)]
    later = [
        claim(1, "CODE:A1BC", discount_value=800.0),
        claim(2, "CODE:B1CD", discount_value=1.0, minimum_order=999.0, minimum_order_known=True),
        claim(3, "CODE:C1DE", expiry_date=ago(days=2)),
        claim(4, "CODE:D1EF"),
    ]
    one = discovery.upsert(discovery.empty_store(spark), frame(spark, first), params)
    assert {r.event for r in one.observations.collect()} == {"discovered"}
    two = discovery.upsert(discovery.Stored(one.offers, one.sources), frame(spark, later), params)
    seen = {r.dedupe_key: r for r in two.observations.collect()}
    assert seen["CODE:A1BC"].event == "rediscovered" and seen["CODE:A1BC"].changes is None
    assert seen["CODE:B1CD"].event == "terms_changed"
    assert seen["CODE:B1CD"].changes == ["minimumOrder: unknown -> 999"]
    assert (seen["CODE:C1DE"].event, seen["CODE:C1DE"].status) == ("discovered", "expired")


def test_expired_stays_unless_an_official_page_comes_first(spark, params):
    past = replace(params, now=ago(days=10))
    start = [claim(1, k, expiry_date=ago(days=3)) for k in ("CODE:A1BC", "CODE:B1CD")]
    one = discovery.upsert(discovery.empty_store(spark), frame(spark, start), past)
    assert {r.status for r in one.offers.collect()} == {"unverified"}
    later = [
        claim(1, "CODE:A1BC", source_type="official", expiry_date=ago(days=-3)),
        claim(2, "CODE:B1CD"),
        claim(3, "CODE:B1CD", source_type="official", expiry_date=ago(days=-3)),
    ]
    two = discovery.upsert(discovery.Stored(one.offers, one.sources), frame(spark, later), params)
    assert {r.dedupe_key: r.status for r in two.offers.collect()} == {
        "CODE:A1BC": "unverified", "CODE:B1CD": "expired",
    }


def test_discovery_cycle_sweeps_and_rescores(spark, params):
    start = [claim(1, "CODE:A1BC", expiry_date=ago(days=3), discount_value=5.0, last_seen_at=ago(days=10)),
             claim(2, "CODE:B1CD", discount_value=5.0, last_seen_at=ago(days=10))]
    old = replace(params, now=ago(days=10))
    one = discovery.discovery_cycle(discovery.empty_store(spark), frame(spark, start), old)
    later = frame(spark, [claim(3, "CODE:C1DE")])
    two = discovery.discovery_cycle(discovery.Stored(one.offers, one.sources), later, params)
    offers = {r.dedupe_key: r for r in two.offers.collect()}
    assert offers["CODE:A1BC"].status == "expired"
    assert offers["CODE:B1CD"].confidence == 0
    log = {(r.dedupe_key, r.event) for r in two.observations.collect()}
    assert ("CODE:A1BC", "expired") in log
    assert ("CODE:B1CD", "confidence_changed") in log
    assert ("CODE:C1DE", "discovered") in log


def test_conflicts_are_pairwise_disagreements(spark, params):
    rng = random.Random(5)
    rows, expected = [], {}
    for k in range(200):
        claims = [
            (rng.choice(["flat", "flat", "percentage", None]), rng.choice([None, 1.0, 1.0, 2.0]),
             rng.choice([None, None, 5.0, 6.0]))
            for _ in range(rng.randrange(1, 4))
        ]
        concrete = [c for c in claims if c[0] and c[1] is not None]
        expected[f"K{k}"] = any(
            a[0] != b[0] or a[1] != b[1] or (a[2] and b[2] and a[2] != b[2])
            for i, a in enumerate(concrete) for b in concrete[i + 1:]
        )
        rows += [(f"K{k}", *c) for c in claims]
    ddl = "dedupe_key string, claim_type string, claim_value double, claim_minimum double"
    found = merge.conflicts(spark.createDataFrame(rows, ddl)).collect()
    assert {r.dedupe_key: r.conflicting_sources for r in found} == {
        k: bool(v) for k, v in expected.items()
    }


def test_dedupe_keys(spark):
    rows = [
        claim(1, "", code=" acme800"), claim(2, "", code="ACME 800"),
        claim(3, "", code=None, title="UP TO 80% OFF!"), claim(4, "", code=None, title="up to 80% off"),
        claim(5, "", code=None, title="other"),
    ]
    keys = [r.k for r in frame(spark, rows).select("seq", dedupe_key().alias("k")).orderBy("seq").collect()]
    assert keys[0] == keys[1] == "CODE:ACME800"
    assert keys[2] == keys[3] != keys[4]
    assert keys[2].startswith("OFFER:") and len(keys[2]) == 26


def test_offers_that_differ_behind_a_long_opening(spark, params):
    opening = "Acme festive season sale on selected styles for men and women in all stores of the country today, "
    texts = [opening + end for end in ("jackets and coats", "shoes and boots", "SHOES and boots")]
    assert len(opening) > 90
    rows = [claim(i, "", code=None, title=title, raw_text=t) for i, (t, title) in enumerate(
        [(t, t) for t in texts] + [(opening + opening + t, (opening + opening)[:117] + "...") for t in "ab"])]
    full = frame(spark, rows)

    def keys(**kwargs):
        return [r.k for r in full.select("seq", dedupe_key(**kwargs).alias("k")).orderBy("seq").collect()]

    found = keys()
    assert found[1] == found[2] and len(set(found)) == 4
    assert len(set(keys(chars=90)[:3])) == 1
    pages = full.withColumn("page", F.lit(1))
    assert page_dedupe(pages, params, ["page"], pos="seq").count() == 4
    short = replace(params, text_key_chars=80)
    assert page_dedupe(pages, short, ["page"], pos="seq").count() == 1


def test_cycle_dedupe_keeps_the_best_at_the_first_place(spark):
    rows = [
        claim(1, "CODE:A1BC"), claim(2, "CODE:A1BC", discount_value=5.0),
        claim(3, "CODE:A1BC", discount_value=6.0), claim(4, "CODE:A1BC", source_name="b"),
    ]
    found = cycle_dedupe(frame(spark, rows)).orderBy("seq").collect()
    assert [(r.seq, r.discount_value, r.source_name) for r in found] == [(1, 5.0, "a"), (4, None, "b")]


def test_page_dedupe_drops_better_duplicates_below_a_full_page(spark, params):
    rows = [
        claim(1, "", code="A1BC"), claim(2, "", code="A1BC", discount_value=5.0),
        claim(3, "", code="B1CD"), claim(4, "", code="B1CD", discount_value=5.0),
        claim(5, "", code="C1DE"),
    ]
    limited = replace(params, max_candidates_per_page=2)
    pages = frame(spark, rows).withColumn("page", F.lit(1))
    found = page_dedupe(pages, limited, ["page"], pos="seq").orderBy("code").collect()
    assert [(r.code, r.discount_value) for r in found] == [("A1BC", 5.0), ("B1CD", None)]


def test_source_cap(spark, params):
    rows = [claim(i, f"CODE:K{i}") for i in range(30)]
    capped = source_cap(
        frame(spark, rows).withColumn("source_label", F.col("source_name")),
        replace(params, max_candidates_per_source=7),
    )
    assert sorted(r.seq for r in capped.collect()) == list(range(7))
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") >= 2  # on both sides of the shuffle


def test_nothing_is_collected_per_offer(spark, params):
    plan = merge.merge_terms(frame(spark, random_claims(50, 5, 1)), params)
    assert "collect_list" not in plan._jdf.queryExecution().toString()
    assert dt.datetime(2026, 8, 19, 15) == NOW


@pytest.mark.parametrize("hot", [False, True])
def test_page_dedupe_splits_hot_pages(spark, params, monkeypatch, hot):
    rng = random.Random(2)
    rows = [claim(i, "", code=f"K{rng.randrange(12)}X", discount_value=rng.choice([None, 1.0])) for i in range(400)]
    pages = frame(spark, rows).withColumn("page", F.when(F.col("seq") % 3 == 0, 1).otherwise(F.col("seq") % 7))
    limited = replace(params, max_candidates_per_page=5, hot_min_rows=60, hot_share=4)
    if hot:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    found = {(r.page, r.code): (r.seq, r.discount_value) for r in page_dedupe(pages, limited, ["page"], pos="seq").collect()}
    want = {}
    for r in rows:
        page = 1 if r["seq"] % 3 == 0 else r["seq"] % 7
        full = sum(1 for p, _ in want if p == page) >= 5
        held = want.get((page, r["code"]))
        if full:
            continue
        if held is None:
            want[page, r["code"]] = (r["seq"], r["discount_value"])
        elif held[1] is None and r["discount_value"] is not None:
            want[page, r["code"]] = (held[0], r["discount_value"])
    assert found == want


def test_numbers_of_the_first_pass_need_no_sort(spark, params):
    """All buffers of pass 1 have a fixed width, so it is a hash aggregation."""
    from offerwise.operators import merge

    claims = spark.createDataFrame([], CLAIMS)
    plan = merge._pass1(claims, params)._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("hot", [False, True])
def test_dealt_claims_merge_in_place(spark, params, hot):
    """Claims dealt by offer are merged without a shuffle; hot offers stay outside the buckets."""
    claims = frame(spark, random_claims(1500, 60, seed=11, hot=0.3))
    tuned = replace(params, hot_min_rows=50, hot_share=4) if hot else params
    parts = skew.deal(claims, "dedupe_key", tuned)
    assert [p.buckets is None for p in parts] == ([False, True] if hot else [False])
    for merged in (merge.merge_terms, merge.merge_sources):
        found = [merged(p.rows, params, p.buckets) for p in parts]
        assert _exchanges(found[0]) == 0
        rows = sorted(str(r) for df in found for r in df.collect())
        assert rows == sorted(map(str, merged(claims, params).collect()))


def test_dealt_upserts_stay_in_place(spark, params):
    """Stored tables and claims of one dealing meet without a shuffle."""
    claims = frame(spark, random_claims(600, 40, seed=5))
    (rows, buckets), = skew.deal(claims, "dedupe_key", params)
    first = discovery.upsert(
        discovery.empty_store(spark), rows.where("seq < 300"), params, buckets
    )
    none = discovery._sources_as_claims(discovery.empty_store(spark).sources)
    new = discovery.conform(rows, f"{CLAIMS}, arrived_at TIMESTAMP").unionByName(none)
    assert _exchanges(merge.merge_sources(new, params, buckets)) == 0
    stored = discovery.Stored(first.offers, first.sources)
    late = discovery.conform(rows.where("seq >= 300"), CLAIMS)
    both = late.withColumn("arrived_at", F.lit(NOW)).unionByName(
        discovery._sources_as_claims(stored.sources)
    )
    assert _exchanges(merge.merge_sources(both, params, buckets)) == 0
    step = discovery.upsert(stored, rows.where("seq >= 300"), params, buckets)
    plain = discovery.upsert(discovery.empty_store(spark), claims, params)
    same = ["dedupe_key", *COMPARED, "source_count", "status", "confidence"]
    assert sorted(map(str, step.offers.select(*same).collect())) == sorted(
        map(str, plain.offers.select(*same).collect())
    )


def test_chosen_texts_ride_in_the_key_of_a_hash_aggregation(spark, params):
    """The second pass combines all claims by numbers; only what is left of an offer is sorted."""
    claims = frame(spark, random_claims(400, 20, seed=3))
    first = merge._pass1(claims, params).localCheckpoint()
    for publishers in (False, True):
        second = merge._pass2(claims, first, params, 4, publishers)
        plan = second._jdf.queryExecution().sparkPlan().toString()
        lowest = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
        assert "HashAggregate(" in lowest and "ObjectHash" not in lowest
        assert ("opening_source" in second.columns) == publishers
    told = merge.merge_terms(claims, params).drop("opening_source", "closing_source")
    plain = merge.merge_terms(claims, params, publishers=False)
    assert sorted(map(str, plain.collect())) == sorted(map(str, told.collect()))


def test_claims_that_take_shape_late(spark, params):
    """Narrow rows are dealt, and what reads them shapes them; counts go by a column that is as good."""
    claims = frame(spark, random_claims(500, 30, seed=8)).withColumn("part", F.xxhash64("dedupe_key"))
    shape = lambda rows: rows.withColumn("title", F.concat("title", "code"))
    narrow = claims.drop("snippet")
    (early,) = skew.deal(narrow, "dedupe_key", params, shape)
    (late,) = skew.deal(narrow, "dedupe_key", params, shape, "part", late=True)
    assert early.buckets == late.buckets
    assert _exchanges(merge.merge_terms(late.rows, params, late.buckets)) == 0
    rows = [merge.merge_terms(p.rows, params, p.buckets).collect() for p in (early, late)]
    assert sorted(map(str, rows[0])) == sorted(map(str, rows[1]))
    tuned = replace(params, hot_min_rows=10, hot_share=25)
    parts = skew.deal(narrow, "dedupe_key", tuned, shape, "part", late=True)
    assert [p.buckets is None for p in parts] == [False, True]
    split = [r for p in parts for r in p.rows.select(early.rows.columns).collect()]
    assert sorted(map(str, split)) == sorted(map(str, early.rows.collect()))


def test_pages_are_sorted_by_a_number_first(spark, params):
    """Keys and addresses begin alike, so a sort by them alone compares whole texts."""
    claims = frame(spark, random_claims(50, 5, seed=2))
    plan = merge.merge_sources(claims, params)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [page_hash" in plan.replace("_groupingexpression", "page_hash")
