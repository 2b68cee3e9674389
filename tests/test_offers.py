"""Pricing, evidence, validation, ranking and reports on small hand-made offers."""

import json
import random
from dataclasses import replace

import pytest
from conftest import NOW, ago
from pyspark.sql import functions as F

from offerwise.functions import messages, pricing
from offerwise.operators import evidence, ranking, report, validation
from offerwise.operators.pricing import price_ladder, refresh_derived, with_target_analysis
from offerwise.plans import report as report_plan
from offerwise.plans import revalidation
from offerwise.schemas import OFFERS, SOURCES, names


def offer(code, **values):
    base = dict.fromkeys(names(OFFERS))
    base.update(
        dedupe_key=f"CODE:{code}", code=code, title="Test offer", discount_type="flat",
        discount_value=800.0, minimum_order=1000.0, is_up_to=False, minimum_order_known=True,
        currency="INR", country="India", status="unverified", confidence=0, source_count=1,
        has_official_source=False, conflicting_sources=False, target_match=False,
        first_seen_at=NOW, last_seen_at=NOW, validation_attempts=0, created_at=NOW, updated_at=NOW,
    )
    base.update(values)
    return base


def source(code, domain="grabon.in", **values):
    base = dict.fromkeys(names(SOURCES))
    base.update(
        dedupe_key=f"CODE:{code}", source_name=domain, source_url=f"https://{domain}/x",
        source_type="coupon-site", source_domain=domain, discovered_at=NOW, last_seen_at=NOW,
        arrived_at=NOW, first_seq=1,
    )
    base.update(values)
    return base


def make(spark, ddl, rows):
    return spark.createDataFrame([tuple(r[n] for n in names(ddl)) for r in rows], ddl)


def scored(spark, params, offers, sources):
    frame = make(spark, OFFERS, offers)
    return refresh_derived(
        evidence.attach_evidence(frame, make(spark, SOURCES, sources), params), params
    )


def by_code(df):
    return {r.code: r for r in df.collect()}


# --- pricing


def test_ladder(spark, params):
    offers = make(spark, OFFERS, [
        offer("FLAT"),
        offer("CAPPED", discount_type="percentage", discount_value=80.0, maximum_discount=300.0,
              minimum_order=None, minimum_order_known=False),
        offer("HUGE", discount_value=5000.0, minimum_order=None, minimum_order_known=False),
        offer("UPTO", discount_type="percentage", is_up_to=True),
        offer("SALE", discount_type="sale"), offer("CASH", discount_type="cashback"),
        offer("NONE", discount_type="unknown", discount_value=None),
        offer("VOID", discount_value=None),
    ])
    rows = price_ladder(offers, params).collect()
    at = {(r.dedupe_key[5:], r.cart_value): r for r in rows}
    assert len(rows) == 8 * 7
    assert (at["FLAT", 1000].discount, at["FLAT", 1000].final_price) == (800, 200)
    assert at["FLAT", 1000].effective_discount == 0.8
    assert at["FLAT", 999].reason == "cart below published minimum order of 1000"
    assert (at["CAPPED", 1000].discount, at["HUGE", 1000].final_price) == (300, 0)
    for code in ("UPTO", "SALE", "CASH", "NONE", "VOID"):
        row = at[code, 1000]
        assert (row.discount, row.applicable) == (0, False) and row.reason, code
    zero = offers.select(pricing.breakdown(F.lit(0.0)).alias("b")).first().b
    assert (zero.applicable, zero.reason) == (False, "cart value must be positive")


def test_rounding_is_half_up_in_doubles(spark):
    row = spark.range(1).select(pricing.round2(F.lit(1.005)).alias("a"), pricing.round2(F.lit(2.345)).alias("b")).first()
    assert (row.a, row.b) == (1.0, 2.35)


def test_target_analysis(spark, params):
    offers = make(spark, OFFERS, [
        offer("SURE"), offer("MAYBE", minimum_order=None, minimum_order_known=False),
        offer("SMALL", discount_value=600.0),
        offer("NOCAP", discount_type="percentage", discount_value=90.0),
    ])
    found = by_code(with_target_analysis(offers, params))
    assert (found["SURE"].target_match, found["SURE"].uncertain) == (True, False)
    assert (found["MAYBE"].target_match, found["MAYBE"].potential_target_match) == (False, True)
    assert "minimum order not published" in found["MAYBE"].uncertainty_reason
    assert (found["SMALL"].target_match, found["SMALL"].final_price_at_target) == (False, 400)
    assert "without a published cap" in found["NOCAP"].uncertainty_reason
    other = by_code(with_target_analysis(offers, replace(params, target_cart=1499, target_discount=700)))
    assert other["SURE"].target_match
    assert 1499.0 in replace(params, target_cart=1499).full_ladder
    assert 1500.0 in replace(params, target_cart=1500).full_ladder


def test_labels(spark):
    rows = [
        (offer("A"), "₹800 OFF"), (offer("B", discount_value=123456.0), "₹1,23,456 OFF"),
        (offer("C", discount_type="percentage", discount_value=70.0), "70% OFF"),
        (offer("D", discount_type="percentage", discount_value=80.0, is_up_to=True), "UP TO 80% OFF"),
        (offer("E", discount_type="sale", discount_value=80.0, is_up_to=True), "UP TO 80% SALE"),
        (offer("F", discount_type="unknown", discount_value=None), "UNKNOWN OFFER"),
        (offer("G", discount_type="cashback", discount_value=99.5), "₹99.50 CASHBACK"),
        (offer("H", discount_value=None), "FLAT OFF (value unknown)"),
        (offer("I", discount_type="percentage", discount_value=12.5), "12.5% OFF"),
    ]
    df = make(spark, OFFERS, [r for r, _ in rows]).select("code", pricing.offer_label().alias("l"))
    assert {r.code: r.l for r in df.collect()} == {o["code"]: label for o, label in rows}
    money = spark.createDataFrame([(1000.0,), (200.0,), (None,)], "v double")
    shown = [r.s for r in money.select(pricing.format_rupees(F.col("v")).alias("s")).collect()]
    assert shown == ["₹1,000", "₹200", "-"]


# --- evidence


def test_confidence(spark, params):
    official = {"source_type": "official"}
    cases = {
        # code: offer values, sources, score
        "ONE": ({}, [source("ONE")], 10),
        "CART": ({"cart_accepted_at": ago(hours=1)}, [source("CART")], 60),
        "OLDCART": ({"cart_accepted_at": ago(hours=49)}, [source("OLDCART")], 10),
        "OFF": ({}, [source("OFF", **official)], 45),
        "BOTH": ({"cart_accepted_at": NOW}, [source("BOTH", **official)], 95),
        "OLDOFF": ({}, [source("OLDOFF", last_seen_at=ago(days=8), **official)], 10),
        "CONFIRMED": ({"official_confirmed_at": ago(days=6)}, [source("CONFIRMED")], 45),
        "MANY": ({}, [source("MANY", f"d{i}.in") for i in range(10)], 25),
        "MIRROR": ({}, [source("MIRROR", d) for d in ("a.in", "www.a.in", "m.a.in", "amp.a.in")], 10),
        "WEEK": ({"last_seen_at": ago(days=3)}, [source("WEEK")], 5),
        "STALE": ({"last_seen_at": ago(days=31), "cart_accepted_at": NOW}, [source("STALE")], 30),
        "CLASH": ({}, [source("CLASH", "a.in", claim_type="flat", claim_value=1.0),
                       source("CLASH", "b.in", claim_type="flat", claim_value=2.0)], 0),
        "DEAD": ({"cart_accepted_at": NOW}, [source("DEAD", reported_expired=True)], 10),
        "PAST": ({"cart_accepted_at": NOW, "expiry_date": ago(days=1)},
                 [source("PAST", reported_expired=True)], 10),
    }
    offers = [offer(code, **values) for code, (values, _, _) in cases.items()]
    sources = [s for _, found, _ in cases.values() for s in found]
    found = by_code(scored(spark, params, offers, sources))
    assert {k: r.confidence for k, r in found.items()} == {k: v[2] for k, v in cases.items()}
    assert found["MANY"].independent_sources == 10 and found["MIRROR"].independent_sources == 1


def test_derived(spark, params):
    found = by_code(scored(spark, params, [
        offer("A"), offer("S", discount_type="sale", is_up_to=True, minimum_order=None, minimum_order_known=False),
    ], [source("A"), source("S")]))
    a = found["A"]
    assert (a.confidence, a.target_match, a.discount_at_target) == (10, True, 800)
    assert (a.final_price_at_target, a.effective_discount_at_target) == (200, 0.8)
    assert (found["S"].final_price_at_target, found["S"].target_match) == (None, False)


# --- validation


def test_due(spark, params):
    cases = [
        ("valid", 12, None, False), ("valid", 25, None, True), ("unverified", 2, None, False),
        ("unverified", 7, None, True), ("manual_validation_required", 2, None, False),
        ("manual_validation_required", 7, None, True), ("invalid", 48, None, False),
        ("invalid", 80, None, True), ("unverified", None, None, True), ("expired", None, None, False),
        ("valid", 0, ago(hours=1), True),
    ]
    offers = [
        offer(f"C{i}", status=s, expiry_date=x,
              last_validated_at=None if h is None else ago(hours=h))
        for i, (s, h, x, _) in enumerate(cases)
    ]
    df = make(spark, OFFERS, offers).select("code", validation.is_due(params).alias("due"))
    assert {r.code: r.due for r in df.collect()} == {f"C{i}": c[3] for i, c in enumerate(cases)}


def test_queue_holds_due_offers_behind_any_number_of_others(spark, params):
    fresh = [offer(f"F{i:02}", target_match=True, status="valid", last_validated_at=NOW) for i in range(10)]
    stale = [offer("STALE", status="valid", last_validated_at=ago(hours=30))]
    df = make(spark, OFFERS, fresh + stale)
    assert [r.code for r in validation.validation_queue(df, params, 1).collect()] == ["STALE"]
    assert [r.code for r in validation.validation_queue(df, params, 3).collect()] == ["STALE"]


def test_cascade(spark, params):
    old = ago(hours=49)
    cases = {
        "PAST": ({"expiry_date": ago(days=1)}, [source("PAST", source_type="official")], "expired"),
        "OFF": ({}, [source("OFF", source_type="official")], "valid"),
        "OLDOFF": ({}, [source("OLDOFF", source_type="official", last_seen_at=old)], "unverified"),
        "COPIES": ({}, [source("COPIES", f"d{i}.in") for i in range(10)], "unverified"),
        "TWODEAD": ({}, [source("TWODEAD", f"d{i}.in", reported_expired=True) for i in range(2)], "invalid"),
        "SAMEDEAD": ({}, [source("SAMEDEAD", d, reported_expired=True) for d in ("a.in", "www.a.in")], "unverified"),
        "ONEDEAD": ({}, [source("ONEDEAD", reported_expired=True)], "unverified"),
        "OFFDEAD": ({}, [source("OFFDEAD", source_type="official", reported_expired=True)], "invalid"),
        "OLDDEAD": ({}, [source("OLDDEAD", f"d{i}.in", reported_expired=True, last_seen_at=ago(days=15)) for i in range(3)], "unverified"),
        "OK": ({}, [source("OK")], "valid"), "NO": ({}, [source("NO")], "invalid"),
        "IF": ({}, [source("IF")], "manual_validation_required"),
        "WALL": ({}, [source("WALL")], "manual_validation_required"),
        "HM": ({"app_only": True}, [source("HM")], "unverified"),
    }
    said = {"OK": "Coupon applied! You saved ₹700", "NO": "Invalid coupon code",
            "IF": "Minimum order value ₹1299 required", "WALL": "Please sign in", "HM": "Your bag"}
    offers = [offer(code, **v) for code, (v, _, _) in cases.items()] + [{**offer("X"), "code": None}]
    sources = [s for _, found, _ in cases.values() for s in found] + [source("X")]
    checks = spark.createDataFrame(list(said.items()), "code string, message string")
    verdicts = validation.check_verdicts(checks)
    frame = evidence.attach_evidence(make(spark, OFFERS, offers), make(spark, SOURCES, sources), params)
    judged = validation.cascade(frame.join(verdicts, "code", "left"), params)
    found = {r.dedupe_key[5:]: r for r in judged.collect()}
    assert {k: found[k].outcome_status for k in cases} == {k: v[2] for k, v in cases.items()}
    assert "has passed" in found["PAST"].outcome_notes and found["OK"].accepted_by_cart
    assert "nothing to test in a cart" in found["X"].outcome_notes
    assert "app-only" in found["HM"].outcome_notes
    assert found["COPIES"].outcome_notes.count("10 independent recent third-party source(s)") == 1
    applied = {r.dedupe_key[5:]: r for r in validation.apply_outcome(judged, params).collect()}
    assert (applied["IF"].minimum_order, applied["OK"].discount_value) == (1299, 700)
    assert applied["OK"].cart_accepted_at == NOW and applied["OK"].event == "status_changed"
    assert applied["HM"].event == "validated" and applied["HM"].validation_attempts == 1


def test_budget_spends_on_the_first_eligible(spark, params):
    offers = [offer(f"C{i}", target_match=i < 3) for i in range(4)] + [offer("OFF", target_match=True)]
    sources = [source(f"C{i}") for i in range(4)] + [source("OFF", source_type="official")]
    checks = spark.createDataFrame([(o["code"], "Invalid coupon code") for o in offers], "code string, message string")
    done = revalidation.revalidate(
        make(spark, OFFERS, offers), make(spark, SOURCES, sources), checks, replace(params, max_cart_checks=2)
    )
    stats = {r.status: (r.offers, r.checks_used) for r in revalidation.validation_stats(done.outcomes).collect()}
    assert stats == {"valid": (1, 0), "invalid": (2, 2), "unverified": (2, 0), "expired": (0, 0),
                     "manual_validation_required": (0, 0)}
    assert {r.event for r in done.observations.collect()} == {"validated", "status_changed"}


@pytest.mark.parametrize("message, verdict", [
    ("Coupon applied! Coupon discount ₹800", "accepted"), ("This coupon is expired", "rejected"),
    ("Code does not exist", "rejected"), ("Coupon not applicable", "rejected"),
    ("Minimum order value ₹1299 required", "conditional"), ("Enter the OTP", "blocked"),
    ("Please complete the captcha", "blocked"), ("Access denied, unusual traffic", "blocked"),
    ("Invalid coupon code. Please login to continue.", "blocked"),
    ("Your bag is ready. Continue shopping.", "unavailable"),
])
def test_verdicts(spark, message, verdict):
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(messages.verdict(F.col("m")).alias("v")).first().v == verdict


def test_new_text(spark):
    pairs = [("Bag total", "Bag total Coupon applied"), ("Bag total\n₹1000", "Bag total\n₹200\nCoupon applied"),
             ("", "Coupon applied")]
    df = spark.createDataFrame(pairs, "b string, a string")
    found = [r.n for r in df.select(messages.new_text(F.col("b"), F.col("a")).alias("n")).collect()]
    assert found == [" Coupon applied", "₹200 Coupon applied", "Coupon applied"]


# --- ranking and reports


def ranked(spark, params, offers):
    frame = make(spark, OFFERS, offers).withColumn("independent_sources", F.coalesce("independent_sources", F.lit(0)))
    return ranking.rank_offers(frame, params)


def codes(df):
    return [r.code for r in df.collect()]


def test_ranking(spark, params):
    v = {"status": "valid"}
    order = codes(ranked(spark, params, [
        offer("EXP", status="expired"), offer("UNV", discount_value=900.0, confidence=100),
        offer("CAP", discount_type="percentage", discount_value=80.0, maximum_discount=300.0, **v),
        offer("B600", discount_value=600.0, **v), offer("SALE", discount_type="sale", is_up_to=True, **v),
        offer("SURE", **v), offer("MAYBE", minimum_order=None, minimum_order_known=False, **v),
        offer("INV", status="invalid"), offer("MAN", status="manual_validation_required"),
    ]))
    assert order == ["SURE", "MAYBE", "B600", "CAP", "SALE", "MAN", "UNV", "INV", "EXP"]


def test_ranking_ties(spark, params):
    v = {"status": "valid", "discount_value": 500.0}
    order = codes(ranked(spark, params, [
        offer("b1", confidence=50, **v), offer("B1", confidence=50, **v), offer("A2", confidence=50, **v),
        offer("OLD", confidence=50, last_seen_at=ago(days=5), **v), offer("HIGH", confidence=90, **v),
        offer("SRC", confidence=50, independent_sources=3, **v),
    ]))
    assert order == ["HIGH", "SRC", "A2", "b1", "B1", "OLD"]


def test_positions_need_no_single_task(spark, params):
    offers = [offer(f"C{i:03}", discount_value=float(i % 50), status="valid" if i % 3 else "invalid") for i in range(300)]
    frame = ranked(spark, params, offers)
    want = codes(frame)
    found = ranking.numbered(frame.select("code", "dedupe_key")).orderBy("position").collect()
    assert [r.position for r in found] == list(range(1, 301))
    assert [r.code for r in found] == want


def test_report_groups_and_best(spark, params):
    offers = [
        offer("VALID", status="valid"),
        offer("PCT", status="valid", discount_type="percentage", discount_value=70.0, maximum_discount=700.0),
        offer("MAN", status="manual_validation_required", discount_value=900.0), offer("EXP", status="expired"),
    ]
    built = report_plan.build(make(spark, OFFERS, offers), make(spark, SOURCES, [source(o["code"]) for o in offers]), params)
    assert codes(built.groups["valid"]) == ["VALID", "PCT"] and codes(built.best) == ["VALID"]
    counts = {r.status: r.offers for r in built.counts.collect()}
    assert counts == {"valid": 2, "manual_validation_required": 1, "unverified": 0, "invalid": 0, "expired": 1, "total": 4}
    assert set(codes(built.target_matches)) == {"VALID", "MAN", "EXP"}
    assert [r.code for r in ranking.scan_summary(built.ranked, params).orderBy("place").collect()] == ["VALID", "PCT", "MAN"]
    only = built.ranked.where("status = 'expired'")
    assert [r.code for r in ranking.scan_summary(only, params).collect()] == ["EXP"]


def test_files(spark, params, tmp_path):
    offers = [offer("GOOD", status="valid", title='Say "hi", now'), offer("OTHER", minimum_order=None, minimum_order_known=False)]
    offers[0]["source_count"] = 1
    many = [source("OTHER", f"d{i}.in", first_seq=i) for i in range(4)]
    small = replace(params, max_nested_sources=3)
    report_plan.publish(make(spark, OFFERS, offers), make(spark, SOURCES, [source("GOOD"), *many]), small, str(tmp_path))

    def text(folder, kind):
        parts = sorted((tmp_path / folder).glob(f"part-*.{kind}"))
        return [line for p in parts for line in p.read_text().splitlines()]

    rows = [json.loads(line) for line in text("latest_json", "json")]
    assert [r["code"] for r in rows] == ["GOOD", "OTHER"]
    assert rows[1]["minimumOrder"] is None and rows[0]["lastSeenAt"] == "2026-08-19T15:00:00.000Z"
    assert len(rows[0]["cartValueAnalysis"]) == 7 and rows[0]["sources"][0]["name"] == "grabon.in"
    # too many sources to nest: the lineage table still has them all
    assert rows[1]["sources"] is None
    lineage = spark.read.parquet(str(tmp_path / "source_lineage"))
    assert lineage.where("dedupe_key = 'CODE:OTHER'").count() == 4
    csv = text("latest_csv", "csv")
    assert csv[0] == ",".join(report.CSV_COLUMNS) and '"Say ""hi"", now"' in csv[1]
    assert csv[1].startswith("GOOD,") and ",800,false,1000,true,," in csv[1]
    assert [json.loads(r)["code"] for r in text("valid_json", "json")] == ["GOOD"]
    head = json.loads(text("summary_json", "json")[0])
    assert head["counts"]["total"] == 2 and head["best"] == "CODE:GOOD"
    assert head["generatedAtIST"] == "2026-08-19 20:30 IST"


def test_written_reports_gather_no_sources_by_default(spark, params, tmp_path, monkeypatch):
    gathered = []
    nested = report.nested_sources
    monkeypatch.setattr(report, "nested_sources", lambda *a: gathered.append(1) or nested(*a))
    many = [source("ONE", f"d{i}.in", first_seq=9 - i) for i in range(5)]
    report_plan.publish(make(spark, OFFERS, [offer("ONE", status="valid")]), make(spark, SOURCES, many), params, str(tmp_path))
    assert not gathered
    row = spark.read.json(str(tmp_path / "latest_json")).first()
    assert row.sourceCount == 5 and row.lineageKey == "CODE:ONE"
    assert spark.read.option("header", True).csv(str(tmp_path / "latest_csv")).first().lineageKey == "CODE:ONE"
    lineage = spark.read.parquet(str(tmp_path / "source_lineage")).where(f"dedupe_key = '{row.lineageKey}'")
    assert [r.name for r in lineage.collect()] == ["d4.in", "d3.in", "d2.in", "d1.in", "d0.in"]


def test_source_summary_keeps_the_first_six(spark):
    rows = [source("A", f"d{i}.in", first_seq=i) for i in (8, 2, 3, 1, 5, 6, 7, 4)]
    found = report.source_summary(make(spark, SOURCES, rows)).first()
    assert found.source_summary == ", ".join(f"d{i}.in(coupon-site)" for i in range(1, 7))


def test_evidence_is_combined_by_numbers(spark, params):
    """Sources that matter by number only become one row of an offer; results as counted plainly."""
    rng = random.Random(4)
    rows = []
    for seq in range(400):
        host = f"p{rng.randrange(6)}.in"
        rows.append(
            dict(
                dedupe_key=f"CODE:K{seq % 7}", source_name=f"n{seq}", source_url=f"https://www.{host}/{seq}",
                source_type=rng.choice(["official", "coupon-site", "social"]),
                source_domain=rng.choice([None, "", f"m.{host}"]), reported_expired=rng.choice([None, False, True]),
                discovered_at=NOW, last_seen_at=ago(hours=rng.choice([3, 40, 60, 200, 700, 800, 5000])),
                arrived_at=ago(hours=rng.randrange(3)), first_seq=seq, claim_type=rng.choice([None, "flat", "sale"]) if seq % 7 else "flat",
                claim_value=10.0, claim_minimum=None, claim_cap=None, snippet=None,
            )
        )
    sources = make(spark, SOURCES, rows)
    plan = evidence.by_domain(sources, params)._jdf.queryExecution().sparkPlan().toString()
    lowest = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
    assert "HashAggregate(" in lowest and "ObjectHash" not in lowest
    found = {r["dedupe_key"]: r for r in evidence.evidence(sources, params).collect()}
    for key in {r["dedupe_key"] for r in rows}:
        mine = [r for r in rows if r["dedupe_key"] == key]
        domain = lambda r: "" if r["source_domain"] == "" else f"p{r['source_url'].split('.')[1][1:]}.in"
        age = lambda r: (NOW - r["last_seen_at"]).total_seconds() / 3600
        order = lambda r: (r["arrived_at"], r["first_seq"])
        proof = [r for r in mine if r["source_type"] == "official"]
        reports = [r for r in mine if r["reported_expired"] and age(r) <= 24 * params.expiry_report_days]
        third = [r for r in mine if r["source_type"] != "official" and age(r) <= 24 * params.third_party_recent_days]
        current = [r for r in proof if not r["reported_expired"] and age(r) <= params.official_current_hours]
        quoted = [r for r in reports if r["source_type"] == "official"]
        got = found[key]
        assert got["source_count"] == len(mine)
        assert got["official_last_seen_at"] == max((r["last_seen_at"] for r in proof), default=None)
        assert got["independent_sources"] == len({domain(r) for r in third} - {""})
        assert got["any_reported_expired"] == any(r["reported_expired"] for r in mine)
        assert got["recent_expiry_reports"] == len(reports)
        assert got["reporting_domains"] == len({domain(r) for r in reports})
        assert got["official_report_url"] == (min(quoted, key=order)["source_url"] if quoted else None)
        newest = min(current, key=lambda r: (age(r), *order(r))) if current else None
        assert got["current_official_url"] == (newest and newest["source_url"])
        assert got["current_official_seen_at"] == (newest and newest["last_seen_at"])
        assert got["conflicting_sources"] == (len({r["claim_type"] for r in mine} - {None}) > 1)


def test_nested_fields_that_are_read(spark, params):
    """The CSV report gathers names and addresses only."""
    rows = [dict(dedupe_key="CODE:A", source_name=f"n{i}", source_url=f"u{i}", arrived_at=NOW, first_seq=-i) for i in range(3)]
    offers = spark.createDataFrame([("CODE:A", 3)], "dedupe_key string, source_count int")
    rows = [dict.fromkeys(names(SOURCES)) | r for r in rows]
    nested = report.nested_sources(offers, make(spark, SOURCES, rows), params, ("name", "url"))
    assert [tuple(s) for s in nested.first()["sources"]] == [("n2", "u2"), ("n1", "u1"), ("n0", "u0")]


def test_checks_are_spread_before_they_are_read(spark):
    """A table of codes that lies in one split would be one task's work."""
    from offerwise.catalog import offers as queries

    checks = queries.checks(spark, "/root/testdata/sf0.001")
    plan = queries.validation.check_verdicts(checks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("verdict") < plan.index("RepartitionByExpression [code")
