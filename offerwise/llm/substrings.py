"""Exact substring dedup over whole texts by merged Burrows-Wheeler transforms.

Every byte that a repeated string of ``WINDOW`` bytes covers is removed. What repeats is
found without sorting all suffixes of all texts:

1. Every window has an anchor, its leftmost least hash of ``ANCHOR`` bytes. Equal windows
   have equal anchors at equal places, so only occurrences of one anchor have to meet. The
   windows of an occurrence lie in one snippet, some 550 bytes. Texts stay where they are;
   one narrow row per occurrence leaves: the anchor's hash and the snippet's hash.
2. An anchor that occurs once has no repeated window. Snippets that are equal repeat with
   all their windows and count as one variant, so thousands of copies are one row.
3. Only anchors with several variants need bytes. Their variants are cut in two shards, each
   gets its transform (``bwt``), and the transforms are merged; repeated intervals of the
   merged transform are the repeated windows.
4. An anchor with more than ``VARIANTS`` variants is split by ranges of windows and the hash
   of the bytes all windows of a range share. What is still that large after the split is
   settled by exact counts of its windows' hashes, spread over all tasks.

Defined results: a null text is empty; texts shorter than the window keep everything;
repeated rows are repeated texts, so both lose what they share; repeated and null doc_ids
don't matter, as texts are told apart by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerwise.llm.bwt import repeated_windows
from offerwise.llm.common import bounded_broadcast, short_batches, stage, text_of
from offerwise.llm.shingles import CHUNK, mix, prefix_sums, spans

WINDOW = 400
STRIDE = 50
ANCHOR = 100
#: Variants of one anchor that are merged in one task.
VARIANTS = 512
#: Windows of one range of a split anchor.
RANGE = 16
#: Bytes of snippets that a task merges at a time, and bytes of one task.
BATCH_BYTES = 1 << 18
TASK_BYTES = 16 << 20
_PLACE_BITS = 22


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    short = -len(values) % width
    full = np.concatenate([values, np.full(short, np.iinfo(values.dtype).max, values.dtype)])
    blocks = full.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], window: int = WINDOW, size: int = ANCHOR):
    """Per text (lo, hi, off, anchor, snippet): first and last window start of each anchor's
    run, the anchor's place from the first, its hash and that of the bytes its windows cover."""
    none = [np.empty(0, dtype=np.int64)] * 5
    out = [[none] for _ in texts]
    group: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        if not group:
            return
        data = np.frombuffer(b"".join(part for _, _, part in group), dtype=np.uint8)
        sums = prefix_sums(data)
        ends = np.cumsum([len(part) for _, _, part in group])
        place = np.arange(len(data) - size + 1)
        hashes = spans(sums, place, place + size)
        packed = (hashes >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS)
        at = (sliding_min(packed | place.astype(np.uint64), window - size + 1)) & np.uint64(
            (1 << _PLACE_BITS) - 1
        )
        for (number, offset, part), end in zip(group, ends, strict=True):
            begin = end - len(part)
            own = at[begin : end - window + 1].astype(np.int64)
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            lo = np.concatenate([[0], cut]) + begin
            hi = np.concatenate([cut - 1, [len(own) - 1]]) + begin
            snippet = mix(spans(sums, lo, hi + window) + (hi - lo).astype(np.uint64))
            first = at[lo].astype(np.int64)
            shift = offset - begin
            out[number].append(
                [
                    lo + shift,
                    hi + shift,
                    first - lo,
                    hashes[first].view(np.int64),
                    snippet.view(np.int64),
                ]
            )

    for number, text in enumerate(texts):
        # parts of a long text overlap so that every window lies in exactly one
        for offset in range(0, max(1, len(text) - window + 1), CHUNK):
            part = text[offset : offset + CHUNK + window - 1]
            if len(part) < window:
                continue
            if held + len(part) > CHUNK + window:
                flush()
                group, held = [], 0
            group.append((number, offset, part))
            held += len(part)
    flush()
    return [[np.concatenate(column) for column in zip(*parts, strict=True)] for parts in out]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).astype(np.int64))
    )


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = zip(*anchors(batch.column("text").to_pylist()), strict=True)
        columns = [_lists(list(c)) for c in columns] if batch.num_rows else []
        if columns:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), *columns],
                names=["doc_id", "key", "lo", "hi", "off", "anchor", "snippet"],
            )


def _snippet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, variant, anchor, snippet, at, n, bytes): what variants have to meet with."""
    for batch in batches:
        rows = []
        for text, wanted in zip(
            batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True
        ):
            for w in wanted:
                bytes_ = text[w["lo"] : w["hi"] + WINDOW]
                n = w["hi"] - w["lo"] + 1
                if not w["split"]:
                    rows.append((w["anchor"], w["snippet"], w["anchor"], w["snippet"], 0, n, bytes_))
                    continue
                # ranges are counted from the anchor, so that equal windows share one; all
                # windows of a range hold the bytes from its last start to its first end
                data = np.frombuffer(bytes_, dtype=np.uint8)
                sums = prefix_sums(data)
                first = np.arange((-w["off"]) // RANGE * RANGE + w["off"], n, RANGE)
                first = first[first + RANGE > 0]
                start, stop = np.maximum(first, 0), np.minimum(first + RANGE, n)
                shared = spans(sums, first + RANGE - 1, first + WINDOW)
                group = mix(shared + (first - w["off"]).astype(np.uint64)).view(np.int64)
                whole = spans(sums, start, stop - 1 + WINDOW)
                variant = mix(whole + (start - first).astype(np.uint64)).view(np.int64)
                for k in range(len(first)):
                    part = bytes_[start[k] : stop[k] - 1 + WINDOW]
                    rows.append(
                        (
                            int(group[k]), int(variant[k]), w["anchor"], w["snippet"],
                            int(start[k]), int(stop[k] - start[k]), part,
                        )
                    )
        names = ("grp", "variant", "anchor", "snippet", "at", "n", "bytes")
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], SNIPPET)


SNIPPET = pa.schema(
    [
        ("grp", pa.int64()), ("variant", pa.int64()), ("anchor", pa.int64()),
        ("snippet", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary()),
    ]
)


def runs_of(starts: np.ndarray) -> list[dict]:
    """Maximal runs of ascending starts as first and last."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    first = starts[np.concatenate([[0], cut])]
    last = starts[np.concatenate([cut - 1, [len(starts) - 1]])]
    return [{"a": int(a), "b": int(b)} for a, b in zip(first, last, strict=True)]


RUNS = pa.schema(
    [
        ("grp", pa.int64()), ("variant", pa.int64()),
        ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
    ]
)


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of variants; rows come sorted by group."""

    def settle(rows: list[dict]) -> pa.RecordBatch:
        found = repeated_windows([r["bytes"] for r in rows], WINDOW, STRIDE)
        return pa.RecordBatch.from_pylist(
            [
                {"grp": r["grp"], "variant": r["variant"], "runs": runs_of(f)}
                for r, f in zip(rows, found, strict=True)
            ],
            RUNS,
        )

    held: list[dict] = []
    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            if size >= BATCH_BYTES and row["grp"] != held[-1]["grp"]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row["bytes"])
    if held:
        yield settle(held)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, variant, start, window hash) of every window of the variants."""
    for batch in batches:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for row in batch.to_pylist():
            data = np.frombuffer(row["bytes"], dtype=np.uint8)
            start = np.arange(row["n"])
            hashes = spans(prefix_sums(data), start, start + WINDOW).view(np.int64)
            own = (np.full(len(start), row["grp"]), np.full(len(start), row["variant"]))
            for column, values in zip(columns, (*own, start, hashes), strict=True):
                column.append(values)
        if columns[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c), pa.int64()) for c in columns],
                names=["grp", "variant", "start", "hash"],
            )


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes that repeated windows cover."""
    for batch in batches:
        kept, removed, spans_ = [], [], []
        for text, runs in zip(
            batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True
        ):
            out, done, gone, n = [], 0, 0, 0
            for run in sorted((r["a"], r["b"] + WINDOW) for r in runs or ()):
                if run[1] <= done:
                    continue
                if run[0] > done or not n:
                    n += 1
                    out.append(text[done : run[0]])
                    done = run[0]
                gone += run[1] - done
                done = run[1]
            out.append(text[done:])
            kept.append(b"".join(out))
            removed.append(gone)
            spans_.append(n)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t) for t in batch.column("text").to_pylist()], pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans_, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array(kept, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    short_batches(docs.sparkSession)
    text = text_of("text").cast("binary")
    own = docs.select("doc_id", F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    listed = stage(
        own.mapInArrow(
            _anchor_rows,
            "doc_id bigint, key binary, lo array<bigint>, hi array<bigint>, off array<bigint>, "
            "anchor array<bigint>, snippet array<bigint>",
        ),
        "anchors",
    )
    # one row of each text stands for all, with their number
    copies = listed.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    copies = bounded_broadcast(stage(copies.filter("copies > 1"), "copies"))
    only = F.col("copies").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))
    listed = listed.join(copies, "key", "left").filter(only)
    seen = listed.select(
        "key",
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.explode(F.arrays_zip("lo", "hi", "off", "anchor", "snippet")).alias("s"),
    ).select("key", "copies", "s.*")
    variants = seen.groupBy("anchor", "snippet").agg(
        F.sum("copies").alias("n"), F.min(F.struct("key", "lo", "hi", "off")).alias("place")
    )
    variants = stage(variants, "variants")
    shared = variants.groupBy("anchor").agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds")
    )
    shared = stage(shared.filter("total > 1").select("anchor", "kinds"), "shared-anchors")
    variants = stage(variants.join(shared, "anchor"), "shared-variants")

    # bytes of the variants that have to meet
    meet = variants.filter("kinds > 1")
    wanted = meet.select(
        F.col("place.key").alias("key"),
        F.struct(
            F.col("place.lo").alias("lo"),
            F.col("place.hi").alias("hi"),
            "anchor",
            "snippet",
            (F.col("kinds") > VARIANTS).alias("split"),
            F.col("place.off").alias("off"),
        ).alias("w"),
    )
    wanted = stage(wanted.groupBy("key").agg(F.collect_list("w").alias("wanted")), "wanted")
    keys = bounded_broadcast(wanted.select("key"))
    texts = own.join(keys, "key", "left_semi").join(copies, "key", "left").filter(only)
    snippets = texts.join(wanted, "key").select("text", "wanted").mapInArrow(
        _snippet_rows,
        "grp bigint, variant bigint, anchor bigint, snippet bigint, at bigint, n bigint, "
        "bytes binary",
    )
    snippets = stage(snippets, "snippets")
    alike = snippets.groupBy("grp", "variant", "n").agg(F.count("*").alias("times"))
    alike = stage(alike, "alike")
    sizes = stage(alike.groupBy("grp").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "groups")
    bytes_ = snippets.select("grp", "variant", "n", "bytes").dropDuplicates(["grp", "variant"])
    bytes_ = stage(bytes_.join(sizes, "grp"), "group-bytes")
    weight = bytes_.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, weight // TASK_BYTES)
    runs = "grp bigint, variant bigint, runs array<struct<a:bigint,b:bigint>>"
    small = (
        bytes_.filter(F.col("kinds") <= VARIANTS)
        .repartition(parts, "grp")
        .sortWithinPartitions("grp", "variant")
        .select("grp", "variant", "bytes")
        .mapInArrow(_merged_rows, runs)
    )
    windows = stage(
        bytes_.filter(F.col("kinds") > VARIANTS)
        .select("grp", "variant", "n", "bytes")
        .mapInArrow(_window_rows, "grp bigint, variant bigint, start bigint, hash bigint"),
        "windows",
    )
    twice = windows.groupBy("grp", "hash").agg(F.count("*").alias("m")).filter("m > 1")
    large = (
        windows.join(stage(twice.select("grp", "hash"), "repeated-windows"), ["grp", "hash"])
        .groupBy("grp", "variant")
        .agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("start").alias("b"))).alias("runs"))
    )
    # ranges that several snippets share repeat whole
    whole = alike.filter("times > 1").select(
        "grp",
        "variant",
        F.array(F.struct(F.lit(0).cast("bigint").alias("a"), (F.col("n") - 1).alias("b"))).alias("runs"),
    )
    found = small.unionByName(large).filter(F.size("runs") > 0).unionByName(whole)
    found = stage(found, "repeats")
    moved = F.transform(
        "runs", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b"))
    )
    met = (
        snippets.select("grp", "variant", "anchor", "snippet", "at")
        .join(found, ["grp", "variant"])
        .select("anchor", "snippet", moved.alias("runs"))
    )
    # snippets with copies repeat with all their windows
    span = F.struct(
        F.lit(0).cast("bigint").alias("a"), (F.col("place.hi") - F.col("place.lo")).alias("b")
    )
    copied = variants.filter("n > 1").select("anchor", "snippet", F.array(span).alias("runs"))
    repeats = copied.unionByName(met).groupBy("anchor", "snippet").agg(
        F.flatten(F.collect_list("runs")).alias("runs")
    )
    repeats = stage(repeats, "repeated")
    placed = seen.select("key", "lo", "anchor", "snippet").join(repeats, ["anchor", "snippet"])
    shifted = F.transform(
        "runs", lambda r: F.struct((r["a"] + F.col("lo")).alias("a"), (r["b"] + F.col("lo")).alias("b"))
    )
    by_text = placed.groupBy("key").agg(F.flatten(F.collect_list(shifted)).alias("runs"))
    by_text = stage(by_text, "text-runs")
    return (
        own.join(by_text, "key", "left")
        .select("doc_id", "text", "runs")
        .mapInArrow(
            _cut_rows,
            "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
            "kept_sha256 string, kept binary",
        )
    )
