"""Conversation repair, dataset manifest and online packing: brute force, SQL and odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from offerwise.llm import conversations, manifest, online, oracles, packing, substrings

CONV = "conv_id bigint, turn bigint, role string, text string, copies string, n string, long string, digest string"


def conv_rows(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, ""]
    texts = ["Well.", "no end", " \t", "", None, "Why? \n", "é!", "x" * 5000 + "."]
    return [
        (
            rng.choice([None, 1, 2, *range(3, 40)]), rng.choice([None, *range(9)]),
            rng.choices(roles, [6, 6, 2, 1, 1, 1])[0], rng.choice(texts),
        )
        for _ in range(n)
    ]


def conv_table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], CONV)


def conv_sql(rows) -> list[tuple]:
    con = duckdb.connect()
    con.register("given", pd.DataFrame({"k": [repr(r) for r in rows]}))
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", [list(r) for r in rows])
    return con.sql(oracles.OP11).fetchall()


def told(rows) -> list[str]:
    return sorted(map(str, map(tuple, rows)))


def brute(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) over all edits with up to three inserted turns in each gap."""
    found, seen, marks = [], set(), []
    for role, text in rows:
        bare = text.strip(conversations.WHITE)
        marks.append((role[:1], not bare or (role, text) in seen, bare[-1:] not in tuple(".!?")))
        seen.add((role, text))
    gaps = list(itertools.product(range(4), repeat=len(rows) + 1))
    for ops in itertools.product("DKR", repeat=len(rows)):
        if any(gone and op != "D" for op, (_, gone, _) in zip(ops, marks, strict=True)):
            continue
        for gap in gaps:
            audit = "I" * gap[0] + "".join(op + "I" * k for op, k in zip(ops, gap[1:], strict=True))
            out, row, cost = "", 0, 0
            for op in audit:
                initial, cut = (marks[row][0], marks[row][2]) if op != "I" else ("", False)
                row += op != "I"
                if op == "D":
                    cost += 3
                    continue
                cost += 2 * (op != "K") + cut
                out += initial if op == "K" else "a" if out.endswith("u") else "u"
                if op == "K" and initial not in tuple("sua"):
                    break
            else:
                tail = out.removeprefix("s")
                if out == "" or (tail and tail == "ua" * (len(tail) // 2)):
                    found.append((cost, audit))
    return min(found)


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(3)
    for _ in range(60):
        rows = [
            (rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", "c!"]))
            for _ in range(rng.randint(0, 4))
        ]
        repair = conversations.Repair(1)
        for k, (role, text) in enumerate(rows):
            repair.add(k, role, text, None, False)
        out = repair.result()
        assert (out["cost"], out["audit"]) == brute(rows), rows


def test_settled_edits_and_colliding_hashes_change_nothing(monkeypatch):
    rng = random.Random(4)
    rows = [
        (rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "b", f"c{i}!", f"d{i}"]))
        for i in range(3000)
    ]

    def run():
        repair = conversations.Repair(1)
        for k, row in enumerate(rows):
            repair.add(k, *row, None, False)
        return repair.result(), len(repair.open_rows)

    whole, _ = run()
    monkeypatch.setattr(conversations, "OPEN_NODES", 16)
    assert run()[0] == whole
    monkeypatch.setattr(conversations, "MODULUS", 7)  # nearly all hashes collide
    assert run()[0] == whole


def test_repair_matches_sql_on_odd_rows(spark):
    rows = conv_rows(1, 400)
    table = conv_table(spark, rows)
    want = told(conv_sql(rows))
    assert told(conversations.repaired(conversations.damaged(table)).collect()) == want
    # repeats of long conversations are found by an aggregate: the same result
    assert told(conversations.repaired(conversations.damaged(table), long_rows=8).collect()) == want


def test_repair_of_dropped_rows_and_empty_tables(spark):
    gone = [(k, 0, "user", "Hi.") for k in range(200)]
    out = conversations.repaired(conversations.damaged(conv_table(spark, gone))).collect()
    assert len(out) == 200 and told(out) == told(conv_sql(gone))
    none = [r for r in out if r["audit"] == ""]
    assert none and all(r["cost"] == 0 and r["repaired_sha256"] == hashlib.sha256().hexdigest() for r in none)
    assert conversations.repaired(conversations.damaged(conv_table(spark, []))).count() == 0
    own = conversations.repaired(conversations.given(conv_table(spark, [(5, 0, "assistant", "Hi.")]))).first()
    assert own["audit"] == "IK" and own["cost"] == 2


# --- manifest ---------------------------------------------------------------------

DOCS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "leaf string, rank string, part string, at string, size string, path string, parts string, lo string"
)


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: tuple) -> str:
    doc_id, text, lang, source, n_chars = row
    values = (doc_id, source, lang, n_chars, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(level: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """(root, for each leaf the (left, right) siblings from below)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for path, (n, place) in zip(paths, enumerate(at), strict=True):
            run, k = runs[place // 16], place % 16
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[n] = place // 16
        level = [h(*run) for run in runs]
    return level[0], paths


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in sources}
    trees = {s: brute_tree([leaf_of(r) for r in own]) for s, own in held.items()}
    root, tops = brute_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for row, path in zip(held[s], trees[s][1], strict=True):
            path = path + top
            doc_id, text = row[0], row[1]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                below = leaf_of((doc_id, lower, *row[2:]))
            else:
                below = leaf_of(row)
            for left, right in path:
                below = h(left, below, right)
            proof = h(*(left + right for left, right in path))
            out.append((doc_id, leaf_of(row), trees[s][0], root, proof, below, below == root))
    return out


def docs_table(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefgh") for r in rows], DOCS)


def test_manifest_matches_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "lower only", "Some Capitals", "\u00c9COLE", "x" * 30_000 + "Y"]
    rows = [
        (k, rng.choice(texts), rng.choice(["en", None]), rng.choice(["hot"] * 60 + ["b", "\u00e9", "", None]), 3)
        for k in range(600)
    ]
    rows += [(k, "One Source", None, f"src{k}", None) for k in range(1000, 1040)]
    rows += [(None, "No Id", "en", "hot", 1), (7, "Same id", "en", "hot", 1), *[(9, "Twice", "en", "b", 5)] * 3]
    want = told(brute_manifest(rows))
    assert told(manifest.manifest(docs_table(spark, rows)).collect()) == want
    few = rows[:1]
    assert told(manifest.manifest(docs_table(spark, few)).collect()) == told(brute_manifest(few))
    assert manifest.manifest(docs_table(spark, [])).count() == 0


def test_manifest_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    out = manifest.manifest(docs)
    want = told(brute_manifest(rows))
    assert told(out.collect()) == want
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    assert told(con.sql(oracles.OP12).fetchall()) == want
    assert 0 < out.filter("not verified").count() < len(rows) / 3
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


# --- online packing -----------------------------------------------------------------


def whole(level: int, capacity: int) -> bool:
    return level == 0 or level == capacity or level & (level - 1) == 0


def test_levels_make_the_sum_of_squares_least():
    rng = random.Random(8)
    levels, fills = online.Levels(64), {}
    for _ in range(2000):
        size = rng.randint(1, 63)
        before = Counter(f for f in fills.values() if f < 64)

        def squares(counts):
            return sum(n * n for level, n in counts.items() if not whole(level, 64))

        choices = {}
        for level in [0, *before]:
            if level + size <= 64:
                after = Counter(before)
                after[level] -= 1
                after[level + size] += 1
                after[0] = after[64] = 0
                choices[level] = squares(after)
        window, level = levels.place(size)
        assert fills.get(window, 0) == level
        assert choices[level] == min(choices.values())
        assert level == max(k for k, v in choices.items() if v == choices[level])
        fills[window] = level + size
    assert levels.open == sum(f < 64 for f in fills.values())
    left = levels.close()
    assert left == {w: f for w, f in fills.items() if f < 64} and levels.open == 0


def check_packed(docs, rows, capacity: int) -> None:
    tokenizer = packing.WordTokenizer(*packing.tokenizer_paths()).whole
    want = Counter()
    for r in docs:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"], tuple(ids)] += 1
    # pieces of each document follow one another; repeated ids are told apart by their tokens
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert Counter({(d, len(t)): n for (d, t), n in want.items()}).keys() == by_doc.keys()
    for (doc_id, ids), n in want.items():
        own = Counter((r["start"], r["length"]) for r in by_doc[doc_id, len(ids)])
        assert sum(length * k for (_, length), k in own.items()) == len(ids) * n * sum(
            d == doc_id and len(t) == len(ids) for d, t in want
        )
        sums = {(s, n_): zlib.crc32(np.array(ids[s : s + n_], "<u4").tobytes()) for s, n_ in own}
        if sum(d == doc_id and len(t) == len(ids) for d, t in want) == 1:
            assert all(r["ids_crc32"] == sums[r["start"], r["length"]] for r in by_doc[doc_id, len(ids)])
            if n == 1:
                at = 0
                for start, length in sorted(own):
                    assert start == at
                    at += length
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert whole(at, capacity)


def test_online_packing_of_odd_rows(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "menu \u00a0 \u00a0 x", "<|endoftext|>", "  ", "\n", "caf\u00e9"]
    texts = [None, "", " ", *(" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(300)), "z " * 40_000]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    rows += [(None, "no id", None, None, None), (5, "same id, other text", None, None, None)]
    rows += [(6000, "twice the same row", None, None, None)] * 2
    docs = docs_table(spark, rows).repartition(5)
    given = docs.select("doc_id", "text").collect()
    for capacity, open_windows in ((2048, 2048), (256, 4)):
        out = online.pack_online(docs, capacity=capacity, open_windows=open_windows).collect()
        check_packed(given, out, capacity)
    assert online.pack_online(docs_table(spark, [])).count() == 0


def test_online_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = online.pack_online(docs).collect()
    check_packed(docs.select("doc_id", "text").collect(), out, 2048)


# --- repeated substrings of the given documents ---------------------------------------


def test_removed_bytes_are_those_of_every_repeated_string(spark):
    """All 400-byte strings of all documents, counted one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    starts = [[hash(t[i : i + 400]) for i in range(len(t) - 399)] for _, t in texts]
    seen, again = set(), set()
    for own in starts:
        for code in own:
            (again if code in seen else seen).add(code)
    want = []
    for (doc_id, text), own in zip(texts, starts, strict=True):
        gone = np.zeros(len(text) + 1, dtype=np.int64)
        for i, code in enumerate(own):
            if code in again:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone)[: len(text)] > 0
        kept = np.frombuffer(text, dtype="u1")[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    out = substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert told(out.collect()) == told(want)
    assert sum(w[2] > 0 for w in want) > 100


def test_planted_passages_show_in_removed_bytes_and_not_in_size(spark):
    """Passages of over 50 words in two documents each go from 400 bytes on; clean documents stay."""
    rng = random.Random(12)

    def words(n):
        return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(4, 8))) for _ in range(n))

    rows, want = [], []
    for k, size in enumerate([380, 399, 400, 401, 650, 2000] * 4):
        passage = words(size)[:size]
        assert passage.count(" ") > 50
        gone = size if size >= 400 else 0
        for side in "XY":
            # marks that differ keep the bytes beside the passage from being shared
            before, after = words(rng.randint(5, 400)) + side, side + words(rng.randint(5, 400))
            text = before + passage + after
            kept = before + after if gone else text
            rows.append((2 * k + (side == "Y"), text))
            want.append((rows[-1][0], len(text), gone, int(gone > 0), hashlib.sha256(kept.encode()).hexdigest()))
        clean = words(rng.randint(60, 900))
        rows.append((1000 + k, clean))
        want.append((1000 + k, len(clean), 0, 0, hashlib.sha256(clean.encode()).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, out.collect())) == sorted(want)
