"""Streams against the batch results and a sequential fold."""

import datetime as dt
import random
import shutil
from dataclasses import replace
from pathlib import Path

import pytest
from conftest import NOW
from pyspark.sql import functions as F
from test_merge import claim, fold, frame, random_claims

from offerwise.operators import history
from offerwise.plans import discovery
from offerwise.schemas import CLAIMS, OFFERS, names
from offerwise.session import checkpoint_dir, passing, staged
from offerwise.streaming import ingest, observations
from offerwise.streaming.dedupe import once_per_window
from offerwise.streaming.ingest import read_store, upsert_stream
from offerwise.streaming.observations import observe_stream, read_events
from offerwise.streaming.store import KeyedStore


def files(spark, folder, parts):
    """One file per part, read one per micro-batch in order."""
    for number, rows in enumerate(parts):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/{number}")
    return (
        spark.readStream.schema(CLAIMS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    )


def test_stream_upsert_equals_batches(spark, params, tmp_path):
    rows = random_claims(300, 25, seed=11, hot=0.3)
    stream = files(spark, str(tmp_path / "in"), [rows[:100], rows[100:200], rows[200:]])
    query = upsert_stream(stream, lambda batch: batch, str(tmp_path / "store"), params)
    query.awaitTermination()
    offers = read_store(spark, str(tmp_path / "store"), 2).offers.collect()
    expected = fold(rows)
    assert len(offers) == len(expected)
    for row in offers:
        want = expected[row.dedupe_key]
        assert (row.discount_type, row.discount_value, row.minimum_order, row.status) == (
            want["discount_type"], want["discount_value"], want["minimum_order"], want["status"],
        )


def test_every_claim_is_observed(spark, params, tmp_path):
    rows = [
        claim(1, "CODE:A1BC", discount_value=800.0),
        claim(2, "CODE:A1BC", discount_value=800.0),
        claim(3, "CODE:A1BC", discount_value=800.0, minimum_order=999.0, minimum_order_known=True),
        claim(4, "CODE:A1BC", source_name="b", is_up_to=True),
        claim(5, "CODE:A1BC", expiry_date=NOW.replace(year=2025)),
        claim(6, "CODE:B1CD", new_users_only=True),
    ]
    stream = files(spark, str(tmp_path / "in"), [rows])
    found = {r.seq: r for r in observed(stream, params, tmp_path)}
    assert [found[i].event for i in range(1, 7)] == [
        "discovered", "rediscovered", "terms_changed", "terms_changed", "status_changed", "discovered",
    ]
    assert found[3].changes == ["minimumOrder: unknown -> 999"]
    assert found[4].changes == ["isUpTo: false -> true", "sourceCount: 1 -> 2"]
    assert found[5].changes == ["status: unverified -> expired", "expiryDate: unknown -> 2025-08-19T15:00:00.000Z"]
    assert found[5].previous_status == "unverified"


def observed(stream, params, tmp_path):
    store = str(tmp_path / "observations")
    observe_stream(stream, lambda batch: batch, store, params).awaitTermination()
    return read_events(stream.sparkSession, store).collect()


@pytest.mark.parametrize("parts", [1, 4])
def test_observed_state_is_the_fold_after_every_claim(spark, params, tmp_path, parts):
    rows = random_claims(240, 4, seed=5)
    step = len(rows) // parts
    stream = files(spark, str(tmp_path / "in"), [rows[i : i + step] for i in range(0, len(rows), step)])
    events = {r.seq: r for r in observed(stream, params, tmp_path)}
    assert len(events) == len(rows)
    seen, before = [], {}
    for row in rows:
        seen.append(row)
        after = fold([r for r in seen if r["dedupe_key"] == row["dedupe_key"]])[row["dedupe_key"]]
        event, was = events[row["seq"]], before.get(row["dedupe_key"])
        assert event.status == after["status"]
        told = {t.split(": ")[0] for t in event.changes or ()}
        if was is None:
            assert event.event == "discovered"
        else:
            for name, label in history.TRACKED.items():
                if name in after and name in was:
                    assert (label in told) == (was[name] != after[name]), (name, was, after, event)
        before[row["dedupe_key"]] = dict(after)


def test_a_hot_offer_in_reverse_and_over_batches(spark, params, tmp_path):
    rows = [claim(i, "CODE:A1BC", discount_value=800.0, source_name=f"s{i % 7}") for i in range(3000)]
    batches = [rows[:1000][::-1], rows[1000:2000][::-1], rows[2000:][::-1]]
    events = sorted(observed(files(spark, str(tmp_path / "in"), batches), params, tmp_path), key=lambda r: r.seq)
    assert [e.seq for e in events] == list(range(3000))
    assert [e.seq for e in events if e.event == "discovered"] == [0]
    assert [e.seq for e in events if e.event == "terms_changed"] == [1, 2, 3, 4, 5, 6]


def test_the_clock_moves_between_batches(spark, params, tmp_path):
    rows = [
        claim(1, "CODE:A1BC", expiry_date=NOW + dt.timedelta(days=1)),
        claim(2, "CODE:A1BC"),
        claim(3, "CODE:A1BC"),
    ]
    later = lambda number: replace(params, now=NOW + dt.timedelta(days=number))
    events = observed(files(spark, str(tmp_path / "in"), [[r] for r in rows]), later, tmp_path)
    assert [e.status for e in sorted(events, key=lambda r: r.seq)] == ["unverified", "unverified", "expired"]
    store = str(tmp_path / "store")
    stream = files(spark, str(tmp_path / "in2"), [[r] for r in rows])
    upsert_stream(stream, lambda batch: batch, store, later).awaitTermination()
    assert read_store(spark, store, 2).offers.first().status == "expired"


def test_a_batch_writes_what_it_changes_and_the_calendar_finds_what_ages(spark, params, tmp_path, monkeypatch):
    """Against whole cycles over all offers, with a clock that moves by hours, days and weeks."""
    rng = random.Random(8)
    rows = random_claims(120, 30, seed=21)
    batches = [rows[:90], *(rows[i : i + 10] for i in range(90, 120, 10))]
    hours = [0, 0, 24 * 8, 24 * 31]
    clocks = [replace(params, now=NOW + dt.timedelta(hours=h)) for h in hours]
    store, whole = str(tmp_path / "store"), discovery.empty_store(spark)
    monkeypatch.setattr(ingest, "FAN", 3)
    for number, (batch, clock) in enumerate(zip(batches, clocks, strict=True)):
        batch = [dict(r, last_seen_at=clock.now - dt.timedelta(hours=rng.randrange(900))) for r in batch]
        given = frame(spark, batch)
        if number == 1:  # an attempt that failed half way is overwritten
            ingest.offer_store(store).write(
                spark.createDataFrame([], f"{OFFERS}, next_change_at TIMESTAMP"), number
            )
        step = ingest.upsert_batch(given, store, number, clock, clocks[number - 1] if number else None)
        want = discovery.discovery_cycle(whole, given, clock)
        whole = discovery.Stored(want.offers, want.sources)
        if number == 1:
            run = spark.read.parquet(f"{store}/offers/runs/{number}-0")
            assert run.count() == len({r["dedupe_key"] for r in batch}) < want.offers.count()
        events = ["dedupe_key", "event", "status", "confidence"]
        assert sorted(map(str, step.observations.select(*events).collect())) == sorted(
            map(str, want.observations.select(*events).collect())
        )
    found = read_store(spark, store, number)
    for mine, theirs in ((found.offers, want.offers), (found.sources, want.sources)):
        assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.select(*mine.columns).collect()))
    assert [level for level, _ in ingest.offer_store(store).runs(spark, number)] == [1, 0]


def test_observation_log_is_appended_once_per_batch(spark, params, tmp_path):
    log = str(tmp_path / "log")
    step = discovery.upsert(discovery.empty_store(spark), frame(spark, [claim(1, "CODE:A1BC")]), params)
    for batch in (7, 7, 8):  # the first is written twice
        history.append_observations(step.observations, log, batch)
    found = history.read_observations(spark, log).collect()
    assert [(r.batch, str(r.observed_on)) for r in sorted(found, key=lambda r: r.batch)] == [
        ("7", "2026-08-19"), ("8", "2026-08-19"),
    ]
    shutil.rmtree(tmp_path / "log" / "done" / "8")  # as a job leaves it that fails
    assert [r.batch for r in history.read_observations(spark, log).collect()] == ["7"]
    assert set(names(CLAIMS)) >= {"dedupe_key", "seq"}


def test_days_that_are_over_leave_the_state(spark, tmp_path):
    """Days straddle batches, a late row of an open day is a repeat, one of a past day is dropped."""
    day = dt.datetime(2026, 3, 1)
    hours = [
        [(1, 1), (1, 5), (2, 20), (1, 23)],
        [(1, 22), (1, 26), (2, 23), (3, 71)],  # one hour late, next day, repeat, watermark at 69 h
        [(1, 30), (9, 40), (3, 50), (3, 73), (None, 73), (4, None)],  # past days, open day, next day
    ]
    rows, state = [], []
    for k, batch in enumerate(hours):
        events = [(u, None if h is None else day + dt.timedelta(hours=h), k) for u, h in batch]
        spark.createDataFrame(events, "user_id int, ts timestamp, extra int").coalesce(1).write.parquet(
            f"{tmp_path}/in/{k}"
        )
        given = (
            spark.readStream.schema("user_id int, ts timestamp, extra int")
            .option("recursiveFileLookup", True)
            .parquet(f"{tmp_path}/in")
        )
        kept = once_per_window(given, ["user_id"], "ts")
        run = (
            kept.writeStream.format("parquet")
            .option("checkpointLocation", f"{tmp_path}/_progress")
            .trigger(availableNow=True)
            .start(f"{tmp_path}/out")
        )
        run.awaitTermination()
        state.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    for r in spark.read.schema(kept.schema).parquet(f"{tmp_path}/out").collect():
        rows.append((r["user_id"], (r["window"]["start"] - day).days))
    assert sorted(rows, key=str) == sorted([(1, 0), (2, 0), (1, 1), (3, 2), (3, 3), (None, 3)], key=str)
    assert state[0] == 2 and state[1] < 5 and state[2] <= 3


def test_a_month_of_the_calendar_is_not_scattered(spark, tmp_path):
    """Files follow the months, not tasks times days."""
    from offerwise.streaming import ingest

    days = F.timestamp_seconds(F.col("id") % 40 * 86400)
    offers = spark.range(0, 4000, 1, 16).select(
        F.col("id").cast("string").alias("dedupe_key"), days.alias("next_change_at")
    )
    ingest._write_calendar(offers, str(tmp_path), 0)
    files = list((tmp_path / "calendar" / "0").rglob("*.parquet"))
    assert len(files) <= 2 + 4
    assert spark.read.parquet(str(tmp_path / "calendar" / "0")).count() == 4000


def test_tasks_of_observations_follow_the_rows(spark):
    from offerwise.streaming import observations

    rows = spark.range(10).select(F.col("id").cast("string").alias("dedupe_key"))
    assert observations.by_offer(rows, 10).rdd.getNumPartitions() == 4
    assert observations.by_offer(rows, 1_000_001).rdd.getNumPartitions() == 21


def left_behind(spark):
    """Steps staged in the checkpoint folder."""
    return set(Path(checkpoint_dir(spark).removeprefix("file:")).glob("staged-*"))


def test_a_stream_leaves_its_tables_only(spark, params, tmp_path):
    """What a micro-batch stages goes when it is over; steps outside keep theirs."""
    rows, store = random_claims(60, 8, seed=3), str(tmp_path / "store")
    kept = staged(spark.range(3))
    before = left_behind(spark)
    stream = files(spark, str(tmp_path / "in"), [rows[:30], rows[30:]])
    upsert_stream(stream, lambda batch: batch, store, params).awaitTermination()
    assert left_behind(spark) == before and kept.count() == 3
    assert {p.name for p in Path(store).iterdir()} == {"_progress", "offers", "sources", "observations", "calendar"}
    assert read_store(spark, store, 1).offers.count() == len({r["dedupe_key"] for r in rows})


def test_passing_steps_go_when_they_fail_and_shuffles_with_their_job(spark, tmp_path):
    folder, cleanup = str(tmp_path / "passing"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    with pytest.raises(ValueError, match="half way"), passing(spark, folder):
        assert staged(spark.range(5)).count() == 5 and len(list((tmp_path / "passing").iterdir())) == 1
        assert spark.conf.get(cleanup) == "true"
        raise ValueError("half way")
    assert not (tmp_path / "passing").exists() and spark.conf.get(cleanup) == before


@pytest.mark.parametrize("hot", [False, True])
def test_narrow_rows_are_dealt_by_offer_and_stay(spark, params, tmp_path, hot):
    """Rows become claims where they lie, hot offers apart, and the store holds what claims at once give."""
    tuned = replace(params, hot_min_rows=40 if hot else 1_000_000)
    rows = random_claims(240, 12, seed=13, hot=0.4)
    store, later = str(tmp_path / "store"), replace(tuned, now=NOW + dt.timedelta(days=9))
    stream = files(spark, str(tmp_path / "in"), [rows[:150], rows[150:]])
    seen = []

    def to_claims(dealt):
        seen.append("title" in dealt.columns)
        return dealt.withColumn("title", F.lit("t"))

    upsert_stream(
        stream, to_claims, store, lambda n: (tuned, later)[n], keyed=lambda batch: batch.drop("title")
    ).awaitTermination()
    assert seen == [False] * (3 if hot else 2)  # hot in the first batch only
    whole = discovery.empty_store(spark)
    for clock, part in ((tuned, rows[:150]), (later, rows[150:])):
        want = discovery.discovery_cycle(whole, frame(spark, part).withColumn("title", F.lit("t")), clock)
        whole = discovery.Stored(want.offers, want.sources)
    found = read_store(spark, store, 1)
    for mine, theirs in ((found.offers, whole.offers), (found.sources, whole.sources)):
        assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.select(*mine.columns).collect()))


def test_dealt_rows_are_written_where_they_are(spark, tmp_path):
    """The store's buckets are those of a dealing, so a task writes one file and reads find the rows."""
    kept = KeyedStore(str(tmp_path / "kept"), "k STRING, n BIGINT", ("k",))
    rows = staged(spark.range(500).selectExpr("string(id) k", "id n"), "k", 32)
    kept.write(rows, 0, placed=True)
    assert len(list((tmp_path / "kept" / "runs").rglob("*.parquet"))) <= 32
    wanted = spark.createDataFrame([("7",), ("499",), ("x",)], "k STRING")
    assert sorted(r.n for r in kept.read(spark, 0, wanted).collect()) == [7, 499]
    assert kept.read(spark, 0, wanted, 32).rdd.getNumPartitions() == 32
    assert kept.read(spark, 0).count() == 500


def test_observations_leave_events_and_state_only(spark, params, tmp_path):
    """Narrow rows become claims where they lie, pages are known over batches, and the state is taken
    from the last event of each offer."""
    rows = [
        claim(1, "CODE:A1BC", discount_value=800.0, source_name="a"),
        claim(2, "CODE:B1CD", discount_value=50.0, source_name="a"),
        claim(3, "CODE:A1BC", discount_value=800.0, source_name="a"),
        claim(4, "CODE:A1BC", discount_value=800.0, source_name="b", minimum_order=999.0, minimum_order_known=True),
        claim(5, "CODE:A1BC", discount_value=800.0, source_name="b"),
    ]
    stream, before = files(spark, str(tmp_path / "in"), [rows[:2], rows[2:4], rows[4:]]), left_behind(spark)
    store = str(tmp_path / "observations")
    observe_stream(
        stream,
        lambda dealt: dealt.withColumn("title", F.lit("t")),
        store,
        params,
        keyed=lambda batch: batch.drop("title"),
    ).awaitTermination()
    assert left_behind(spark) == before
    assert {p.name for p in Path(store).iterdir()} == {"_progress", "events", "offers", "pages"}
    found = sorted(read_events(spark, store).collect(), key=lambda r: r.seq)
    assert [e.event for e in found] == ["discovered", "discovered", "rediscovered", "terms_changed", "rediscovered"]
    assert found[3].changes == ["minimumOrder: unknown -> 999", "sourceCount: 1 -> 2"]
    held = {r.dedupe_key: r for r in observations.read_state(spark, store, 3).collect()}
    assert {k: (r.source_count, r.minimum_order) for k, r in held.items()} == {
        "CODE:A1BC": (2, 999.0), "CODE:B1CD": (1, None),
    }
    pages = spark.read.schema(observations.PAGES).option("recursiveFileLookup", True).parquet(f"{store}/pages")
    assert pages.distinct().count() == 3
