"""Best-fit packing of token sequences by a configuration linear program.

1. Tasks tokenize the texts and cut documents of more than ``capacity`` ids into pieces; the
   first piece takes the remainder. Only narrow rows leave the tasks.
2. The histogram of piece lengths has at most ``capacity`` bars however many documents there
   are; it goes to the driver.
3. A configuration is a multiset of lengths that fits in one sequence. The covering program
   (fewest configurations that hold all pieces) is solved by multiplicative weights: bars
   have prices, an unbounded knapsack over the prices finds the best configuration, and the
   prices of bars it covers fall. Rounding down keeps whole sequences; what is left over is
   packed best-fit, longest first, also into the room that configurations leave.
4. Pieces are numbered within their length, chunk by chunk, and the n-th piece of a length
   takes the n-th slot of that length. No piece's neighbours are gathered anywhere.

Defined results: a null or empty text is one id (the closing 0); repeated rows are packed
each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerwise.llm.common import bounded_broadcast, short_batches, stage, text_of

CAPACITY = 2048
ROUNDS = 30
STEP = 0.5
#: Pieces of one length that are numbered together.
CHUNK_ROWS = 1000
#: Bytes of text that are tokenized at a time; a longer text is alone.
SLICE_BYTES = 8_000_000


class WordTokenizer:
    """Byte-level BPE ids of whole texts; a batch's distinct words are encoded once.

    Texts are cut before every blank, which changes no ids unless a token spans the cut. Texts
    that hold the string of a token with a blank behind its first byte (in this vocabulary blank
    and no-break blank in turn, as ``&nbsp; &nbsp;`` leaves them), runs of blanks or the special
    token are encoded whole. Ranks are the same vocabulary as the JSON file, in the form of the
    faster library.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding(
            "words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # a character that such a token holds only in part is left out, so the rest still occurs
        across = {t.decode("utf-8", "ignore") for t in ranks if b" " in t[1:]}
        self.uncut: list[str] = []
        for string in sorted({"  ", *special, *across}, key=len):
            if not any(short in string for short in self.uncut):
                self.uncut.append(string)
        self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def ids(self, text: str) -> np.ndarray:
        return next(self.each(pa.array([text], pa.string())))

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, none of them null, at most ``SLICE_BYTES`` or one text at a time."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield from self._each(texts.slice(start, end - start))

    def _each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        apart = np.zeros(len(texts), dtype=bool)
        for string in self.uncut:
            apart |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~apart)), " ")
        words, firsts = split.flatten(), np.append(0, np.cumsum(pc.list_value_length(split)))
        later = np.ones(len(words), dtype=bool)
        later[firsts[:-1]] = False
        ids, starts, lengths, word = self._encoded(words.filter(pa.array(later)))
        # of the words behind the first, the n-th text has those from ends[n] to ends[n + 1]
        ends = firsts - np.arange(len(firsts))
        text = 0
        for k, alone in enumerate(apart):
            if alone:
                yield self._whole(texts[k].as_py())
                continue
            own = word[ends[text] : ends[text + 1]]
            sizes = lengths[own]
            upto = np.cumsum(sizes)
            rest = ids[np.repeat(starts[own] - (upto - sizes), sizes) + np.arange(sizes.sum())]
            first = self.words.encode_ordinary(words[int(firsts[text])].as_py())
            text += 1
            yield np.concatenate([np.array(first, dtype="<u4"), rest]) if first else rest

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, ...]:
        """Ids of all distinct words with a blank before each, where each distinct word's ids
        start, their number, and which of them each word is."""
        held = words.dictionary_encode()
        distinct = held.dictionary
        if not len(distinct):
            return np.empty(0, "<u4"), *[np.empty(0, np.int64)] * 3
        empty = pc.equal(distinct, "").to_numpy(zero_copy_only=False)
        listed = pa.ListArray.from_arrays([0, len(distinct)], pc.if_else(pa.array(empty), "x", distinct))
        joined = pc.binary_join(listed, " ")[0].as_py()
        ids = np.array(self.words.encode_ordinary(" " + joined), dtype="<u4")
        starts = np.flatnonzero(self.opens[ids])
        lengths = np.diff(starts, append=len(ids))
        if len(starts) != len(distinct):
            raise ValueError("a token spans two words")
        # a blank at the end of a text has no word behind it
        ids = np.append(ids, np.array(self.words.encode_ordinary(" "), dtype="<u4"))
        starts[empty], lengths[empty] = len(ids) - 1, 1
        return ids, starts, lengths, held.indices.to_numpy()


def piece_bounds(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; the first takes the remainder."""
    first = total % capacity or capacity
    cuts = [0, *range(first, total + 1, capacity)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _piece_rows(paths: tuple[str, str, str], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(*paths)
        for batch in batches:
            docs, pieces, starts, lengths, sums = [], [], [], [], []
            texts = tokenizer.each(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    docs.append(doc_id)
                    pieces.append(k)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(ids[start : start + length].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()),
                    pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def knapsack(
    prices: np.ndarray, lengths: np.ndarray, capacity: int
) -> tuple[np.ndarray, np.ndarray]:
    """For every room the highest total price that fits, and the length to take first (0:
    leave one place empty). Lengths ascend and may be taken any number of times."""
    value = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if n := upto[room]:
            gain = prices[:n] + value[room - lengths[:n]]
            k = n - 1 - int(gain[::-1].argmax())
            if gain[k] > value[room]:
                value[room], take[room] = gain[k], lengths[k]
    return value, take


def solve_configurations(
    histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, step: float = STEP
) -> dict[tuple, float]:
    """Fractional configurations that cover the histogram, by multiplicative weights.

    Prices start in proportion to the length, which is the dual of a perfect packing. Each
    round's dynamic program prices all rooms at once, so it yields the best configuration
    with each single length; those close to the best of all enter with a ``step`` of the
    scarcest bar they use.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[int(k)] for k in lengths], dtype=float)
    place = {int(k): i for i, k in enumerate(lengths)}
    prices = lengths / capacity
    covered = np.zeros(len(lengths))
    amounts: dict[tuple, float] = {}
    for _ in range(rounds):
        value, take = knapsack(prices, lengths, capacity)
        gained = np.zeros(len(lengths))
        for i in np.flatnonzero(prices + value[capacity - lengths] >= 0.99 * value[capacity]):
            if covered[i] + gained[i] >= 1:
                continue
            config, room = Counter([int(lengths[i])]), capacity - int(lengths[i])
            while room > 0:
                config[int(take[room])] += 1
                room -= int(take[room]) or 1
            config.pop(0, None)
            amount = step * min(need[place[k]] / c for k, c in config.items())
            key = tuple(sorted(config.items()))
            amounts[key] = amounts.get(key, 0.0) + amount
            for k, c in config.items():
                gained[place[k]] += amount * c / need[place[k]]
        covered += gained
        prices = prices * np.exp(-step * gained)
        prices[covered >= 1] *= 0.9
        prices /= prices.max()
        if covered.min() >= 1:
            break
    return amounts


def best_fit(
    left: dict[int, int], capacity: int, open_bins: dict[tuple, int]
) -> dict[tuple, int]:
    """Pack the histogram best-fit, longest first, bins of equal content at a time.

    Bins are ``((length, count), ...)`` patterns with the number of bins alike.
    """
    room: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []

    def put(pattern: tuple, free: int, bins: int) -> None:
        if free not in room:
            room[free] = {}
            insort(rooms, free)
        room[free][pattern] = room[free].get(pattern, 0) + bins

    for pattern, bins in open_bins.items():
        put(pattern, capacity - sum(k * c for k, c in pattern), bins)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect_left(rooms, length)
            free = rooms[at] if at < len(rooms) else capacity
            pattern, bins = next(iter(room[free].items())) if at < len(rooms) else ((), count)
            each = min(free // length, count)
            used = min(bins, count // each)
            if at < len(rooms):
                if used == bins:
                    del room[free][pattern]
                    if not room[free]:
                        del room[free], rooms[at]
                else:
                    room[free][pattern] -= used
            merged = Counter(dict(pattern))
            merged[length] += each
            put(tuple(sorted(merged.items())), free - each * length, used)
            count -= each * used
    out: dict[tuple, int] = {}
    for patterns in room.values():
        for pattern, bins in patterns.items():
            out[pattern] = out.get(pattern, 0) + bins
    return out


def plan_bins(histogram: dict[int, int], capacity: int) -> dict[tuple, int]:
    """Whole bins that hold the histogram exactly: the rounded program and what it leaves."""
    if not histogram:
        return {}
    left = dict(histogram)
    bins: dict[tuple, int] = {}
    for config, amount in solve_configurations(histogram, capacity).items():
        # rounding: as many whole sequences as the pieces that are left allow
        whole = min([int(np.ceil(amount)), *(left[k] // c for k, c in config)])
        if whole:
            bins[config] = bins.get(config, 0) + whole
            for k, c in config:
                left[k] -= whole * c
    return best_fit({k: n for k, n in left.items() if n}, capacity, bins)


def slot_rows(bins: dict[tuple, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, copies, first sequence, first offset): which ranks go where."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, count in sorted(bins.items()):
        offset = 0
        for length, copies in pattern:
            lo = taken[length]
            taken[length] += count * copies
            rows.append((length, lo, taken[length], copies, sequence, offset))
            offset += length * copies
        sequence += count
    return rows


def tokenizer_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return (
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def pack(
    docs: DataFrame, paths: tuple[str, str, str] | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    short_batches(docs.sparkSession)
    spark = docs.sparkSession
    pieces = stage(
        docs.select("doc_id", text_of("text").alias("text")).mapInArrow(
            _piece_rows(paths or tokenizer_paths(), capacity),
            "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint",
        ),
        "pieces",
    )
    bars = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(
        slot_rows(plan_bins(bars, capacity)),
        "length bigint, lo bigint, hi bigint, copies bigint, sequence bigint, place bigint",
    )
    # a length's pieces in chunks of about CHUNK_ROWS; one row per length, at most ``capacity``
    cuts = spark.createDataFrame(
        [(k, 1 + n // CHUNK_ROWS) for k, n in bars.items()], "length bigint, chunks bigint"
    )
    chunk = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("chunks"))
    pieces = pieces.join(F.broadcast(cuts), "length").withColumn("chunk", chunk)
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    offsets = bounded_broadcast(stage(offsets, "length-offsets"))
    ranked = (
        pieces.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets, ["length", "chunk"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    # at most a few thousand rows: patterns of a histogram of at most ``capacity`` bars
    slot = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    at = F.col("rank") - F.col("lo")
    return ranked.join(
        slot,
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("lo"))
        & (F.col("rank") < F.col("hi")),
    ).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("copies"))).alias("sequence_id"),
        (F.col("place") + F.pmod(at, F.col("copies")) * F.col("length")).alias("offset"),
    )
