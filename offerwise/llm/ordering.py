"""Training order: sequences in keyed random order as fixed-stride binary shards.

1. Tasks tokenize texts, join the ids (each document closed by id 0) and cut them into
   sequences of ``LENGTH`` ids; only a task's last one is shorter. They are staged once,
   compressed, with their number in the task.
2. Counts per task give every sequence an index from 0 to n - 1. A keyed Feistel network over
   the least even number of bits that hold n permutes the indexes; what falls outside is
   permuted again until it falls inside (cycle-walking). So every index gets one slot, every
   slot one index, and nobody keeps a table.
3. Slots are dealt out by range, ``SHARD_ROWS`` to a shard. A record is the index, the number
   of ids and the ids, padded to one stride, so slot s is in shard s // SHARD_ROWS at byte
   (s % SHARD_ROWS) * stride: readers go on from any slot without reading what lies before.

Rows come sorted and file names depend on the shard only, so a task that runs again writes
the same files; a shard gets its final name when it is complete.

Defined results: a null or empty text is one id (the closing 0); repeated rows are written
each; an empty table has no shards; which documents share a sequence follows the input's
partitions and order, the permutation only the number of sequences and the key.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerwise.llm.common import bounded_broadcast, shared_folder, short_batches, stage, text_of
from offerwise.llm.packing import WordTokenizer, tokenizer_paths

LENGTH = 2048
SHARD_ROWS = 4096
#: Records that a reader takes at a time.
READ_ROWS = 512
KEY = 0x5EED
ROUNDS = 4
#: index, number of ids
HEAD = np.dtype([("index", "<u8"), ("length", "<u4")])
#: ids of vocabularies of at most 65,536 tokens
ID = np.dtype("<u2")


def feistel(values: np.ndarray, half: int, key: int) -> np.ndarray:
    """A permutation of the numbers of 2 * ``half`` bits, set by ``key``."""
    mask = np.uint64((1 << half) - 1)
    left, right = values >> np.uint64(half), values & mask
    for step in range(ROUNDS):
        x = right ^ np.uint64((key * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03) % (1 << 64))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        left, right = right, left ^ ((x >> np.uint64(32)) & mask)
    return (left << np.uint64(half)) | right


def slots(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots below ``n`` of indexes below ``n``."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    out = feistel(index.astype(np.uint64), half, key)
    while (far := out >= np.uint64(n)).any():
        out[far] = feistel(out[far], half, key)
    return out.astype(np.int64)


def _sequence_rows(paths: tuple[str, str, str], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(*paths)
        part, made = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        size = 0

        def rows(cut: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal made
            numbers = list(range(made, made + len(cut)))
            made += len(cut)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(cut), pa.int64()),
                    pa.array(numbers, pa.int64()),
                    pa.array([len(c) for c in cut], pa.int64()),
                    pa.array([c.tobytes() for c in cut], pa.binary()),
                ],
                names=["part", "number", "length", "ids"],
            )

        for batch in batches:
            for found in tokenizer.each(batch.column("text")):
                ids = np.append(found, np.uint32(0)).astype(ID)
                held.append(ids)
                size += len(ids)
            whole = size // length * length
            flat = np.concatenate(held) if held else np.empty(0, dtype=ID)
            yield rows([flat[i : i + length] for i in range(0, whole, length)])
            held, size = [flat[whole:]], size - whole
        if size:
            yield rows([np.concatenate(held)])

    return run


def ordered(docs: DataFrame, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """(index, slot, length, ids): every sequence with its slot; ids compressed.

    Staged sequences are compressed by the page, as neighbours share words; each one is
    compressed alone only for the shuffle, which takes it away from them.
    """
    short_batches(docs.sparkSession)
    cut = stage(
        docs.select(text_of("text").alias("text")).mapInArrow(
            _sequence_rows(tokenizer_paths(), length),
            "part bigint, number bigint, length bigint, ids binary",
        ),
        "sequences",
        compression="zstd",
    )
    counts = cut.groupBy("part").agg(F.count("*").alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    # one row per task
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = bounded_broadcast(stage(starts, "sequence-starts"))

    @F.pandas_udf("bigint")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(slots(index.to_numpy(), n, key))

    @F.pandas_udf("binary")
    def packed(ids: pd.Series) -> pd.Series:
        packer = zstandard.ZstdCompressor(level=3)
        return ids.map(packer.compress)

    rows = cut.join(starts, "part").withColumn("index", F.col("start") + F.col("number"))
    return rows.select("index", slot_of("index").alias("slot"), "length", packed("ids").alias("ids"))


def _shard_rows(folder: str, length: int, shard_rows: int):
    stride = HEAD.itemsize + ID.itemsize * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        reader = zstandard.ZstdDecompressor()
        out, shard, count = None, -1, 0

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                system.move(f"{root}/_{shard}-{context.taskAttemptId()}", f"{root}/{name(shard)}")
                yield pa.RecordBatch.from_pydict({"shard": [shard], "records": [count]})

        for batch in batches:
            for row in batch.to_pylist():
                if row["slot"] // shard_rows != shard:
                    yield from close()
                    shard, count = row["slot"] // shard_rows, 0
                    out = system.open_output_stream(f"{root}/_{shard}-{context.taskAttemptId()}")
                if row["slot"] % shard_rows != count:
                    raise ValueError(f"slot {row['slot']} does not follow")
                head = np.array([(row["index"], row["length"])], dtype=HEAD).tobytes()
                out.write((head + reader.decompress(row["ids"])).ljust(stride, b"\0"))
                count += 1
        yield from close()

    return run


def name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(
    sequences: DataFrame, folder: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Write ``ordered`` sequences; (shard, records) of the shards."""
    spark = sequences.sparkSession
    shard = F.floor(F.col("slot") / shard_rows)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # ranges of whole shards, so no two tasks write one
    dealt = sequences.repartitionByRange(parts, shard).sortWithinPartitions("slot")
    return stage(
        dealt.mapInArrow(_shard_rows(folder, length, shard_rows), "shard bigint, records bigint"),
        "shards",
    )


def read_shards(
    spark: SparkSession,
    folder: str,
    start: int = 0,
    length: int = LENGTH,
    shard_rows: int = SHARD_ROWS,
    with_ids: bool = True,
) -> DataFrame:
    """(slot, index, length, ids_crc32, ids) from slot ``start`` on. Shards before it aren't
    opened, and its own is read from the slot's byte on. Without ``with_ids`` the ids are read
    and summed, but stay in the task (null)."""
    stride = HEAD.itemsize + ID.itemsize * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        for shard in (x for batch in batches for x in batch.column("shard").to_pylist()):
            slot = max(start, shard * shard_rows)
            with system.open_input_file(f"{root}/{name(shard)}") as file:
                file.seek((slot - shard * shard_rows) * stride)
                while data := file.read(READ_ROWS * stride):
                    rows = []
                    for at in range(0, len(data), stride):
                        record = memoryview(data)[at : at + stride]
                        head = np.frombuffer(record[: HEAD.itemsize], dtype=HEAD)[0]
                        ids = np.frombuffer(
                            record[HEAD.itemsize :], dtype=ID, count=int(head["length"])
                        ).astype("<u4")
                        rows.append(
                            {
                                "slot": slot, "index": int(head["index"]), "length": len(ids),
                                "ids_crc32": zlib.crc32(ids), "ids": ids.tobytes() if with_ids else None,
                            }
                        )
                        slot += 1
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [
            ("slot", pa.int64()), ("index", pa.int64()), ("length", pa.int64()),
            ("ids_crc32", pa.int64()), ("ids", pa.binary()),
        ]
    )
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    found = [x.base_name for x in system.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))]
    last = max((int(m[1]) for x in found if (m := re.fullmatch(r"shard-(\d+)\.bin", x))), default=-1)
    first = start // shard_rows
    parts = max(1, min(last + 1 - first, 4 * spark.sparkContext.defaultParallelism))
    numbers = spark.range(first, max(first, last + 1), 1, parts).toDF("shard")
    return numbers.mapInArrow(
        run, "slot bigint, index bigint, length bigint, ids_crc32 bigint, ids binary"
    )


def training_order(docs: DataFrame) -> DataFrame:
    """Write the shards below the shared folder and read them back: slot, shard, offset in
    bytes, index, length, ids_crc32."""
    spark = docs.sparkSession
    folder = re.sub("^file:/*", "file:///", shared_folder(spark, "training-order"))
    stride = HEAD.itemsize + ID.itemsize * LENGTH
    if write_shards(ordered(docs), folder).isEmpty():
        return spark.createDataFrame(
            [], "slot bigint, shard bigint, offset bigint, index bigint, length bigint, ids_crc32 bigint"
        )
    return read_shards(spark, folder, with_ids=False).select(
        "slot",
        F.floor(F.col("slot") / SHARD_ROWS).alias("shard"),
        (F.col("slot") % SHARD_ROWS * stride).alias("offset"),
        "index",
        "length",
        "ids_crc32",
    )
