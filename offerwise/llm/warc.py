"""WARC archives in Zstandard: writing and reading.

An archive starts with a skippable frame that holds the dictionary; every record is one
frame with a checksum, compressed with that dictionary. Readers load the dictionary, cut the
file at frame ends and decode records one by one.

Archives are written by tasks into one shared folder, through a file system named by its
URI. A task's rows are sorted and its file names depend on its partition only, so a task that
runs again writes the same files; each gets its final name when it is complete.

Of records with equal payloads of at least ``REVISIT_BYTES``, all but the one with the
smallest page_id are revisit records, which carry headers and no payload.

Defined results: a null html is an empty payload; a null url leaves out the target header;
rows that share both payload and the smallest page_id are all responses; null page_ids
revisit others but are never revisited. Records that don't validate come back with an
``error`` and nulls for what couldn't be read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerwise.llm.common import bounded_broadcast, shared_folder, short_batches, stage

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_BYTES = 100
#: Raw bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 16 << 20
#: Raw bytes of an archive's first records from which its dictionary is trained.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, payload binary, error string"
)


def record(page_id, url, payload: bytes, digest: str, original) -> bytes:
    """One WARC record: a response, or with ``original`` a revisit of that page's record."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if original is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if original is not None:
        head += [f"WARC-Refers-To: <urn:page:{original}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """Trained on the first records; their plain beginning where there is too little."""
    sample, size = [], 0
    for one in records:
        sample.append(one[: SAMPLE_BYTES // 8])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def archive(records: list[bytes]) -> bytes:
    held = dictionary(records)
    packer = zstandard.ZstdCompressor(
        level=3, dict_data=zstandard.ZstdCompressionDict(held), write_checksum=True
    )
    head = struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held
    return head + b"".join(packer.compress(one) for one in records)


def frame_end(data: memoryview, at: int) -> int:
    """The end of the frame that starts at ``at``, from its block headers."""
    head = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
    end = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        if end + 3 > len(data):
            raise ValueError("truncated frame")
        mark = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if mark >> 1 & 3 == 1 else mark >> 3)
        if mark & 1:
            end += 4 * head.has_checksum
            if end > len(data):
                raise ValueError("truncated frame")
            return end


def parse(raw: bytes) -> dict:
    """A validated record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    length = int(fields["Content-Length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError("wrong Content-Length")
    http, found, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])
    if not found or b"Content-Length" not in http_fields:
        raise ValueError("no HTTP header")
    size = int(http_fields[b"Content-Length"])
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size:
            raise ValueError("wrong payload length")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("wrong payload digest")
    elif kind != "revisit" or "WARC-Refers-To" not in fields:
        raise ValueError("unknown record type")

    def page(name: str):
        own = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(own) if own else None

    url = fields.get("WARC-Target-URI")
    return {
        "page_id": page("WARC-Record-ID"),
        "url": None if url is None else unquote(url),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": page("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
        "error": None,
    }


def records_of(data: bytes) -> Iterator[dict]:
    """The records of an archive; what can't be decoded is a row with an error."""
    view = memoryview(data)
    broken = dict.fromkeys(
        ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
    )
    try:
        magic, size = struct.unpack("<II", view[:8])
        if magic != DICTIONARY_MAGIC or 8 + size > len(data):
            raise ValueError("no dictionary frame")
        held = bytes(view[8 : 8 + size])
        if held[:4] == ZSTD_MAGIC:
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    except (ValueError, struct.error, zstandard.ZstdError) as why:
        yield broken | {"error": str(why)}
        return
    at = 8 + size
    while at < len(data):
        try:
            end = frame_end(view, at)
        except (ValueError, zstandard.ZstdError) as why:
            yield broken | {"error": str(why)}
            return
        try:
            yield parse(reader.decompressobj().decompress(view[at:end]))
        except (ValueError, UnicodeDecodeError, zstandard.ZstdError) as why:
            yield broken | {"error": str(why)}
        at = end


def _write_rows(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        made, records, size = 0, [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{context.partitionId():06d}-{made:05d}.warc.zst"
            temporary = f"{root}/_{name}-{context.taskAttemptId()}"
            with system.open_output_stream(temporary) as out:
                out.write(archive(records))
            system.move(temporary, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "records": [len(records)]})

        for batch in batches:
            for row in batch.to_pylist():
                one = record(**row)
                records.append(one)
                size += len(one)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    made, records, size = made + 1, [], 0
        if records:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row as a record; the names of the archives and their numbers of records."""
    short_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    large = F.octet_length("payload") >= REVISIT_BYTES
    # payloads that more than one record has, one row each
    originals = rows.filter(large).groupBy("digest").agg(
        F.min("page_id").alias("original"), F.count("*").alias("n")
    )
    originals = stage(originals.filter("n > 1").drop("n"), "originals")
    originals = bounded_broadcast(originals.withColumnRenamed("digest", "_digest"))
    revisits = ~F.col("page_id").eqNullSafe(F.col("original"))
    rows = rows.join(originals, (F.col("digest") == F.col("_digest")) & large, "left").select(
        "page_id", "url", "payload", "digest", F.when(revisits, F.col("original")).alias("original")
    )
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, total // (4 * ARCHIVE_BYTES))
    dealt = rows.repartition(parts, F.xxhash64("page_id", "digest")).sortWithinPartitions(
        F.col("page_id"), "digest", "url"
    )
    return stage(dealt.mapInArrow(_write_rows(folder), "name string, records bigint"), "archives")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    payload (null for revisits), error."""

    schema = pa.schema(
        [
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held: list[dict] = []
                for one in records_of(content.as_py()):
                    held.append(one)
                    if len(held) >= 256:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(run, READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages into archives in the shared folder and read them back."""
    spark = pages.sparkSession
    # file:/x and file:///x are one path; the file systems of tasks want the second form
    folder = re.sub("^file:/*", "file:///", shared_folder(spark, "warc"))
    if write_archives(pages, folder).isEmpty():
        return spark.createDataFrame([], READ_SCHEMA)
    return read_archives(spark, folder)
