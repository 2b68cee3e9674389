"""The training-data operators on odd rows, against oracle SQL, brute force and round trips."""

import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offerwise.llm import (
    bwt,
    decontaminate,
    fingerprints,
    lines,
    minhash,
    oracles,
    ordering,
    packing,
    substrings,
    toxicity,
    urls,
    warc,
)

SF = "/root/testdata/sf0.001"
# names that the operators use themselves
CLASH = (
    "doc class n words text_hash _id _hash _text _score comp bucket bands range copy row key "
    "runs hash place length piece"
).split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(
    f", {name} string" for name in CLASH
)


def odd_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    prose = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(6)]
    near = prose[0].split(" ")
    near[50] = "changed"
    passage = " ".join(rng.choice(words) for _ in range(130))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (6, prose[0]),
        (7, prose[0]), (8, " ".join(near)), (9, prose[0].upper()), (10, "\n".join(prose[1:3])),
        (11, prose[3] + passage + prose[4]), (12, prose[5] + passage), (13, "ab" * 700),
        (14, "é" * 900), (15, "You idiot! " * 3), (16, prose[2] + "\n\nSame line \n" + prose[3]),
        (17, "😀 line\n" * 50), (18, " ".join(rng.choice(words) for _ in range(30_000))),
        (18, "same id, other text"), (19, "twice\nthe same row"), (19, "twice\nthe same row"),
        (20, "x  y   z\n\n end "), (21, "<|endoftext|> stays text"),
    ]
    rows += [(100 + i, f"own {i}\n Same line\nshared\tline {i % 2}") for i in range(12)]
    return rows


def docs_of(spark, rows):
    full = [(i, t, "en", "s", None if t is None else len(t), *CLASH) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, odd_texts()).cache()


ITEMS = [
    (1, "one two"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(20))),
    (5, "Own 3"), (6, "own 3"), (7, "never met anywhere"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


def sql(name, **tables):
    con = duckdb.connect()
    for key, rows in tables.items():
        con.register(key, rows)
    cursor = con.execute(oracles.ORACLES[name])
    return sorted(map(str, cursor.fetchall())), [c[0] for c in cursor.description]


def frame(rows, columns):
    table = pd.DataFrame(rows, columns=columns)
    table[columns[0]] = table[columns[0]].astype("Int64")
    return table


def rows_of(df, columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def test_lines_match_sql_with_any_number_of_runs(odd):
    # SQL counts rows; fully equal rows count as one document here
    texts = list(dict.fromkeys(odd_texts()))
    want, columns = sql("op5_line_dedup", documents=frame(texts, ["doc_id", "text"]))
    for batches in (1, 5):
        out = lines.drop_common_lines(odd, batches=batches).select(
            "doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
        )
        assert sorted(set(rows_of(out, columns))) == want
        assert out.count() == len(odd_texts())


def test_lines_of_repeated_rows_count_for_each_row(spark):
    texts = [(1, "Same line\nown")] * 12 + [(2, "\u00c9cole A\n x"), (3, "\u00c9COLE a")]
    want, columns = sql("op5_line_dedup", documents=frame(texts, ["doc_id", "text"]))
    out = lines.drop_common_lines(docs_of(spark, texts)).select(
        "doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )
    assert sorted(set(rows_of(out, columns))) == sorted(set(want))
    assert out.filter("n_dropped = 2").count() == 12


def test_line_runs_settle_keys_and_compact(spark, tmp_path):
    store = lines.LineRuns(spark, str(tmp_path / "runs"), min_docs=3, fan=2)
    batch = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 2)], "k1 bigint, k2 bigint")
    for _ in range(5):
        store.add(batch)
    counts = {r["k1"]: r["docs"] for r in store.counts().collect()}
    assert counts == {1: 3, 2: 3}  # settled keys are counted no further
    assert sum(map(len, store.levels)) == 2


def test_contamination_matches_sql(odd, items):
    texts = odd_texts()
    want, columns = sql(
        "op10_decontamination",
        documents=frame(texts, ["doc_id", "text"]),
        benchmark=frame(ITEMS, ["item_id", "text"]),
    )
    out = decontaminate.contamination(odd, items).select(
        "*", F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )
    assert rows_of(out, columns) == want


def test_minhash_matches_sql(odd):
    # ids are told apart in SQL, so rows that repeat one are left out
    texts = [r for i, r in enumerate(odd_texts()) if r[0] not in {x[0] for x in odd_texts()[:i]}]
    out = minhash.near_duplicates(docs_of(odd.sparkSession, texts))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    want, columns = sql("op9_minhash", documents=frame(texts, ["doc_id", "text"]))
    assert rows_of(out, columns) == want


def test_minhash_of_a_group_without_a_common_hub(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(200)] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(words)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    want, columns = sql("op9_minhash", documents=frame(rows, ["doc_id", "text"]))
    assert rows_of(out, columns) == want


def block_set(text):
    return {
        " ".join(words[i : i + fingerprints.BLOCK])
        for words in (line.split(" ") for line in text.split("\n"))
        for i in range(0, len(words), fingerprints.BLOCK)
    }


@pytest.mark.parametrize(("ranges", "quantiles"), [(1, 128), (7, 128), (7, 2)])
def test_fingerprints_against_sets(spark, monkeypatch, ranges, quantiles):
    monkeypatch.setattr(fingerprints, "QUANTILES", quantiles)
    texts = [r for i, r in enumerate(odd_texts()) if r[0] not in {x[0] for x in odd_texts()[:i]}]
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", max(1, len(texts) // ranges))
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs_of(spark, texts)).collect()}
    texts = sorted((i, t or "") for i, t in texts)
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[i]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, e, b = block_set(text), block_set(edited), block_set(after)
        assert row["near_edited"] == pytest.approx(len(a & e) / len(a | e))
        assert row["near_next"] == pytest.approx(len(a & b) / len(a | b))
    assert got[4]["fingerprint"] == got[5]["fingerprint"] != got[6]["fingerprint"]


def removed_by_brute_force(texts):
    size = substrings.WINDOW
    starts = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for text in texts:
        marks, end = bytearray(len(text)), 0
        for i in range(len(text) - size + 1):
            if starts[text[i : i + size]] > 1:
                begin = max(i, end)
                marks[begin : i + size] = b"\1" * (i + size - begin)
                end = i + size
        spans = sum(1 for i, m in enumerate(marks) if m and not (i and marks[i - 1]))
        kept = bytes(b for b, m in zip(text, marks, strict=True) if not m)
        out.append((len(text), sum(marks), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("variants", [512, 1])
def test_substrings_against_brute_force(odd, monkeypatch, variants):
    monkeypatch.setattr(substrings, "VARIANTS", variants)
    texts = [(i, (t or "").encode()) for i, t in odd_texts()]
    want = removed_by_brute_force([t for _, t in texts])
    out = substrings.remove_repeats(odd).drop("kept").collect()
    got = [tuple(r) for r in out]
    assert sorted(got) == sorted((i, *w) for (i, _), w in zip(texts, want, strict=True))


def test_merged_transforms_against_counting():
    rng = random.Random(3)
    for _ in range(60):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        texts = []
        for _ in range(rng.randint(1, 8)):
            text = bytearray()
            while len(text) < rng.randint(0, 80):
                at = rng.randint(0, 50)
                text += base[at : at + rng.randint(1, 40)]
                text += bytes(rng.choice(b"abcdef") for _ in range(rng.randint(0, 4)))
            texts.append(bytes(text))
        seen = Counter(t[i : i + 16] for t in texts for i in range(len(t) - 15))
        want = [[i for i in range(len(t) - 15) if seen[t[i : i + 16]] > 1] for t in texts]
        assert [x.tolist() for x in bwt.repeated_windows(texts, 16, 2)] == want


def test_packing_round_trip(odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_paths()[0])
    want = Counter()
    for i, text in odd_texts():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, (start, length) in enumerate(packing.piece_bounds(len(ids), packing.CAPACITY)):
            part = b"".join(x.to_bytes(4, "little") for x in ids[start : start + length])
            want[i, piece, start, length, zlib.crc32(part)] += 1
    rows = packing.pack(odd).collect()
    assert Counter((r[0], r[1], r[2], r[3], r[4]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // packing.CAPACITY) + 2


def test_word_ids_where_tokens_span_blanks():
    tokenizer = packing.WordTokenizer(*packing.tokenizer_paths())
    assert tokenizer.ids("a \xa0 \xa0 b").tolist() == [64, 11504, 275]
    rng = random.Random(5)
    parts = [" ", "\xa0", " \xa0", "\xa0 ", "\n", "a", "menu", "home", "'s", "1", "\u00e9", "!"]
    texts = ["menu \xa0 \xa0 \xa0 home", "\xa0 \xa0 \xa0", " \xa0" * 17 + "x"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(5000)]
    for text in texts:
        want = tokenizer.whole.encode(text, add_special_tokens=False).ids
        assert tokenizer.ids(text).tolist() == want, text


def test_packing_plan_holds_every_piece():
    rng = random.Random(2)
    for size in (1, 50, 5000):
        bars = Counter(min(2048, int(rng.lognormvariate(6.8, 1)) + 1) for _ in range(size))
        bins = packing.plan_bins(dict(bars), 2048)
        held = Counter()
        for pattern, count in bins.items():
            assert sum(k * c for k, c in pattern) <= 2048
            for k, c in pattern:
                held[k] += c * count
        assert held == bars
        least = -(-sum(k * c for k, c in bars.items()) // 2048)
        assert sum(bins.values()) <= least * 1.03 + 2


def test_training_order_round_trip_and_resume(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    folder = f"file://{tmp_path}/shards"
    docs = odd.coalesce(1)
    rows = ordering.ordered(docs, length=64, key=7)
    shards = ordering.write_shards(rows, folder, length=64, shard_rows=10).collect()
    back = sorted(ordering.read_shards(spark, folder, 0, 64, 10).collect(), key=lambda r: r["slot"])
    n = len(back)
    assert [r["slot"] for r in back] == list(range(n)) == sorted(r["index"] for r in back)
    assert sum(s["records"] for s in shards) == n and len(shards) == -(-n // 10)
    index = np.array([r["index"] for r in back])
    assert ordering.slots(index, n, 7).tolist() == list(range(n))
    whole = Tokenizer.from_file(packing.tokenizer_paths()[0])
    want = []
    for r in docs.select("text").collect():
        want += [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
    ids = b"".join(bytes(r["ids"]) for r in sorted(back, key=lambda r: r["index"]))
    assert np.frombuffer(ids, "<u4").tolist() == want
    later = ordering.read_shards(spark, folder, 57, 64, 10).collect()
    assert sorted(r["slot"] for r in later) == list(range(57, n))
    for shard in range(5):  # a reader that goes on from slot 57 needs none of these
        os.remove(f"{folder.removeprefix('file://')}/{ordering.name(shard)}")
    again = ordering.read_shards(spark, folder, 57, 64, 10).collect()
    assert sorted(r["slot"] for r in again) == list(range(57, n))


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        for key in (0, 1, 99):
            assert sorted(ordering.slots(np.arange(n), n, key).tolist()) == list(range(n))
    assert ordering.slots(np.arange(1000), 1000, 1).tolist() != ordering.slots(np.arange(1000), 1000, 2).tolist()


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["toxic"] == r["predicted"] for r in out)
    assert right >= 0.93 * len(out)
    assert not any(r["predicted"] and not r["toxic"] for r in out)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_toxicity_without_labels_and_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity(odd, none).collect()
    assert len(rows) == len(odd_texts())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    odd_labels = spark.createDataFrame(
        [(15, 1, 1), (15, 1, 0), (4, 1, None), (None, 1, 1), (6, 0, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    assert toxicity.toxicity(odd, odd_labels).count() == len(odd_texts())


def test_grammar_scores_clauses():
    grammar = toxicity.Grammar({"idiot": 4.0})
    read = grammar.reader()
    plain, aimed = read("some idiot there"), read("you are an idiot")
    assert grammar.score(aimed) > grammar.score(plain) > grammar.score(read("a calm day"))
    assert read("she said: fine. he said you idiot")[toxicity.PATTERNS.index("reported")] > 0
    assert read("you are no idiots")[toxicity.PATTERNS.index("negated")] > 0
    assert read("i will kill them")[toxicity.PATTERNS.index("threat at target")] > 0
    assert not read("kill the lights. nonidiot").any()


@pytest.mark.parametrize(
    ("text", "patterns"),
    [
        ("you are not an idiot", {"negated"}),
        ("no doubt you are an idiot", {"insult at target"}),  # out of reach
        ("not no idiot", {"insult"}),  # the second negation lifts the first
        ("you don’t look like idiots", {"negated"}),
        ("the idiot said hello to you", {"insult at target"}),  # before the reporting word
        ("he said: you idiot", {"reported"}),
        ("he said so. you idiot", {"insult at target"}),  # another clause
        ("she never called him an idiot", {"reported"}),
        ("idiot, idiots, you idiotic", {"insult", "insult at target"}),
        ("they were killing him", {"threat at target"}),
        ("you will be killed", {"threat at target"}),
        ("i will not hurt you", {"negated"}),
        ("ich werde dich umbringen", {"threat at target"}),
        ("il va te tuer", {"threat at target"}),
        ("te matarán: te mataré", {"threat at target"}),
        ("beatles burnish the hurtle", set()),
        ("", set()),
        ("idiot " * 50_000 + "you", {"insult at target"}),
    ],
)
def test_patterns_of_clauses(text, patterns):
    found = toxicity.Grammar({"idiot": 4.0}).reader()(text)
    assert {n for n, x in zip(toxicity.PATTERNS, found, strict=True) if x} == patterns


def test_composed_grammar_equals_transducers_in_turn():
    import itertools

    parts = [toxicity.negation_arcs(), toxicity.report_arcs(), toxicity.target_arcs()]
    for kinds in itertools.product("ihtnro", repeat=5):
        state, states = 0, [0, 0, 0]
        for kind in kinds:
            state, out, weight = toxicity.GRAMMAR[state, kind]
            told, product = kind, 1.0
            for k, arcs in enumerate(parts):
                states[k], told, own = arcs[states[k], told]
                product *= own
            assert (out, weight) == (told, product)
        assert (state in toxicity.AIMED) == bool(states[2])


def test_held_out_rows_of_the_larger_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in out)
    assert hits >= 0.84 * sum(r["toxic"] for r in out)
    assert hits >= 0.9 * sum(r["predicted"] for r in out)


PAGES = [
    (1, "https://a.example.com/en/x?y", "<p>" + "z" * 200), (2, None, "<p>" + "z" * 200),
    (3, "not a url", ""), (4, "http://X.NET/es/", None), (5, "http://x.net/es", "short"),
    (6, "http://x.net/es", "short"), (7, "http://b.net/fr/#f", "<p>" + "z" * 200),
    (7, "http://b.net/fr/#f", "<p>" + "é" * 90), (8, "https://www.example.com/en/q", "ü\n\r\n"),
    (9, "http://spamfarm.org\n/x y", "<title>spam farm</title>"), (10, "s://com", "q" * 100),
    (11, "s://example.org/spam/farm", "<title>spam farm spam farm</title>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, *CLASH) for p in PAGES]
    schema = "page_id bigint, url string, html string" + "".join(f", {c} string" for c in CLASH)
    return spark.createDataFrame(rows, schema).cache()


def test_warc_round_trip(pages):
    want, columns = sql("op2_warc", pages=frame(PAGES, ["page_id", "url", "html"]))
    out = warc.round_trip(pages)
    assert rows_of(out, columns) == want
    back = {(r["page_id"], r["url"]): r for r in out.collect()}
    assert all(r["error"] is None for r in back.values())
    for page_id, url, html in PAGES:
        assert (page_id, url) in back
        if back[page_id, url]["record_type"] == "response" and page_id != 7:
            assert bytes(back[page_id, url]["payload"]) == (html or "").encode()


def test_warc_reader_reports_damage():
    records = [warc.record(i, "u", b"x" * i, hashlib.sha256(b"x" * i).hexdigest(), None) for i in range(300)]
    data = warc.archive(records)
    assert [r["page_id"] for r in warc.records_of(data)] == list(range(300))
    cut = list(warc.records_of(data[:-3]))
    assert len(cut) == 300 and cut[-1]["error"] and not any(r["error"] for r in cut[:-1])
    for broken in (b"", b"junk", data[4:], data[:6]):
        assert [bool(r["error"]) for r in warc.records_of(broken)] == [True]
    wrong = warc.record(1, "u", b"abc", "0" * 64, None)
    assert [r["error"] for r in warc.records_of(warc.archive([wrong]))] == ["wrong payload digest"]


def brute_rule(host, path):
    fits = [
        (own + start, word)
        for own, start, word in urls.RULES
        if (host == own or host.endswith("." + own)) and path.startswith(start)
    ]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_url_rules(pages):
    out = urls.judged(pages).collect()
    assert len(out) == len(PAGES)
    parts = {}
    for page_id, url, _ in PAGES:
        rest = (url or "").split("://", 1)
        rest = rest[1] if len(rest) == 2 else ""
        host = rest
        for mark in "/?#":
            host = host.split(mark)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        parts[page_id] = (host.lower(), path)
    for r in out:
        assert (r["host"], r["path"]) == parts[r["page_id"]]
        name, verdict = brute_rule(r["host"], r["path"])
        assert r["rule"] == name
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")


def test_host_segmentation(spark):
    counts = spark.createDataFrame(
        [("cheap", 50), ("pills", 40), ("heap", 5), ("the", 900)], "word string, n bigint"
    )
    names = spark.createDataFrame([("cheappills",), ("thecheap",), ("qqq",)], "name string")
    got = {r["name"]: r["words"] for r in urls.segmented(names, counts).collect()}
    assert got == {"cheappills": ["cheap", "pills"], "thecheap": ["the", "cheap"], "qqq": ["qqq"]}


def test_empty_tables(spark, items):
    docs = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    no_items = items.limit(0)
    assert lines.drop_common_lines(docs).count() == 0
    assert decontaminate.contamination(docs, items).count() == 0
    assert decontaminate.contamination(docs_of(spark, [(1, "a")]), no_items).count() == 1
    assert minhash.near_duplicates(docs).count() == 0
    assert packing.pack(docs).count() == 0
    assert ordering.training_order(docs).count() == 0
    assert toxicity.toxicity(docs, labels).count() == 0
    assert fingerprints.fingerprints(docs).count() == 0
    assert substrings.remove_repeats(docs).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(pages).count() == 0
    assert urls.judged(pages).count() == 0


def test_null_ids(spark, items):
    docs = docs_of(spark, [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (None, "x")])
    assert lines.drop_common_lines(docs).count() == 4
    assert decontaminate.contamination(docs, items).count() == 4
    near = minhash.near_duplicates(docs).collect()
    assert [r["component_id"] for r in near if r["n_shingles"] == 2] == [1, 1]
    assert packing.pack(docs).count() == 4
    assert fingerprints.fingerprints(docs).count() == 4
    assert substrings.remove_repeats(docs).count() == 4


def test_one_row_of_each_near_duplicate_group_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    texts = [
        (1, a), (1, a), (1, a), (2, a), (1, a + "  "),  # repeated rows and copies of one group
        (None, b), (None, b), (None, b + " "),  # no ids at all
        (None, c), (7, c), (7, c),
        (1, "quite another text of the same id"), (None, "quite another text without id"),
        (9, ""), (9, ""), (None, None),  # no shingles: in no group
    ]
    docs = docs_of(spark, texts)
    out = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    left = Counter((r["doc_id"], (r["text"] or "").strip()) for r in out.collect())
    assert left == Counter([
        (1, a), (None, b), (7, c), (1, texts[11][1]), (None, texts[12][1]), (9, ""), (9, ""), (None, ""),
    ])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_id", F.lit(1))
    count = docs.count()
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        if name == "best-fit packing":
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == kept
            break
        assert out.columns == docs.columns
        docs = corpus_pipeline.stage(out, "test")
        now = docs.count()
        assert now == count if name == "line dedup" else 0 < now <= count
        count = now
