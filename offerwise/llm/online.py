"""Online packing by sums of squares: documents go into windows as they come.

1. A task tokenizes its texts. Whole windows of a long document are sequences at once. What is
   left of it, or a shorter document, goes to the fill level that makes the sum of the squared
   counts of partly filled windows least: a level array holds how many windows are open at each
   level, so the choice is one pass over 2,048 numbers however many windows are open. Levels
   that need no padding, the powers of two, don't count as partly filled.
2. Windows that are full, or at a power of two in the end, are sequences. What other windows
   hold at the end of a task, or once ``OPEN_WINDOWS`` are open, is left over.
3. What is left over stands in one row by task: a task's total is one row, and tasks start where
   those before them end. Pieces are cut where that row crosses a multiple of the capacity; its
   last ones are cut at powers of two. So nothing is padded, and no task sees more than its own.

Defined results: a null or empty text is one id (the closing 1); every row is packed, also
repeated ones; an empty table gives no rows. Which documents share a sequence follows the
input's partitions and order.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerwise.llm.common import bounded_broadcast, short_batches, stage, text_of
from offerwise.llm.packing import WordTokenizer, tokenizer_paths

CAPACITY = 2048
CLOSING = 1
#: Windows that a task holds open, 8 kB of ids each at most.
OPEN_WINDOWS = 2048
FAR = 1 << 60

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def padded(level: int | np.ndarray) -> bool | np.ndarray:
    """Whether a sequence of so many ids is padded; a power of two, or none, isn't."""
    return (level & (level - 1)) != 0


class Levels:
    """How many windows are open at each fill level, and which."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.weight = padded(np.arange(capacity + 1)).astype(np.int64)
        self.weight[capacity] = 0
        # what one window more or less at a level adds to or takes from the sum of squares
        self.more = self.weight.copy()
        self.less = np.full(capacity + 1, -FAR)
        self.less[0] = 0
        self.windows: dict[int, list[int]] = defaultdict(list)
        self.open, self.made = 0, 0

    def _count(self, level: int, change: int) -> None:
        n = self.counts[level] = self.counts[level] + change
        self.open += change
        self.more[level] = self.weight[level] * (2 * n + 1)
        self.less[level] = self.weight[level] * (2 * n - 1) if n else -FAR

    def place(self, size: int) -> tuple[int, int]:
        """(window, level before) for ``size`` ids; the fullest window among equals."""
        change = self.more[size:] - self.less[: self.capacity + 1 - size]
        level = self.capacity - size - int(change[::-1].argmin())
        if level:
            window = self.windows[level].pop()
            self._count(level, -1)
        else:
            window, self.made = self.made, self.made + 1
        if level + size < self.capacity:
            self.windows[level + size].append(window)
            self._count(level + size, 1)
        return window, level

    def close(self) -> dict[int, int]:
        """All open windows with their level; none is open any more."""
        found = {w: level for level, windows in self.windows.items() for w in windows}
        for level in list(self.windows):
            self._count(level, -len(self.windows.pop(level)))
        return found


ROWS = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "sequence", "offset")]
    + [("ids", pa.binary())]
)


def _placed(paths: tuple[str, str, str], capacity: int, open_windows: int):
    """Rows of sequences, and with ids those left over: ``offset`` is their place in the task's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(*paths)
        part = TaskContext.get().partitionId()
        levels, left = Levels(capacity), 0
        held: dict[int, list[tuple]] = defaultdict(list)
        out: list[tuple] = []

        def row(piece: tuple, sequence: int | None, offset: int) -> None:
            doc_id, start, ids, total = piece
            kept = ids.tobytes() if sequence is None else None
            out.append((doc_id, start, len(ids), zlib.crc32(ids), total, part, sequence, offset, kept))

        def finish(window: int) -> None:
            offset = 0
            for piece in held.pop(window):
                row(piece, window, offset)
                offset += len(piece[2])

        def close() -> None:
            nonlocal left
            for window, level in levels.close().items():
                if not padded(level):
                    finish(window)
                    continue
                for piece in held.pop(window):
                    row(piece, None, left)
                    left += len(piece[2])

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(ROWS)
            made = [pa.array(list(c), f.type) for c, f in zip(columns, ROWS, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, schema=ROWS)

        for batch in batches:
            found = tokenizer.each(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids = np.append(ids, np.uint32(CLOSING)).astype("<u4")
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    row((doc_id, start, ids[start : start + capacity], len(ids)), levels.made, 0)
                    levels.made += 1
                if whole == len(ids):
                    continue
                window, level = levels.place(len(ids) - whole)
                held[window].append((doc_id, whole, ids[whole:].copy(), len(ids)))
                if level + len(ids) - whole == capacity:
                    finish(window)
                elif levels.open >= open_windows:
                    close()
            yield flush()
        close()
        yield flush()

    return run


def ends(total: int, capacity: int) -> list[int]:
    """Where the sequences of the last ``total % capacity`` ids end: powers of two, largest first."""
    found, at = [], total - total % capacity
    for bit in range(capacity.bit_length() - 1, -1, -1):
        if total % capacity >> bit & 1:
            at += 1 << bit
            found.append(at)
    return found


def _cut(total: int, capacity: int):
    tail = ends(total, capacity)
    full = total - total % capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids, at = np.frombuffer(r["ids"], dtype="<u4"), r["at"]
                done = 0
                while done < len(ids):
                    here = at + done
                    if here < full:
                        number = here // capacity
                        begin = number * capacity
                        end = begin + capacity
                    else:
                        k = next(k for k, end in enumerate(tail) if here < end)
                        number, end = full // capacity + k, tail[k]
                        begin = tail[k - 1] if k else full
                    piece = ids[done : done + end - here]
                    out.append(
                        (r["doc_id"], r["start"] + done, len(piece), zlib.crc32(piece), r["doc_tokens"], -1 - number, here - begin)
                    )
                    done += len(piece)
            if out:
                columns = [pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    columns,
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def pack_online(
    docs: DataFrame,
    paths: tuple[str, str, str] | None = None,
    capacity: int = CAPACITY,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    ``capacity`` is a power of two."""
    short_batches(docs.sparkSession)
    placed = stage(
        docs.select("doc_id", text_of("text").alias("text")).mapInArrow(
            _placed(paths or tokenizer_paths(), capacity, open_windows),
            f"{PIECE}, part bigint, sequence bigint, offset bigint, ids binary",
        ),
        "placed",
    )
    open_rows = placed.filter("sequence is null")
    totals = open_rows.groupBy("part").agg(F.sum("length").alias("n"))
    # one row per task
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        totals.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), "left-over"
    )
    total = starts.agg(F.sum("n")).first()[0] or 0
    rest = (
        open_rows.join(bounded_broadcast(starts.drop("n")), "part")
        .select("doc_id", "start", "doc_tokens", "ids", (F.col("begin") + F.col("offset")).alias("at"))
        .mapInArrow(_cut(total, capacity), f"{PIECE}, sequence_id bigint, offset bigint")
    )
    names = [part.split()[0] for part in PIECE.split(", ")]
    sequence = F.shiftleft("part", 32) + F.col("sequence")
    done = placed.filter("sequence is not null").select(*names, sequence.alias("sequence_id"), "offset")
    return done.unionByName(rest)
