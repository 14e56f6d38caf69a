"""Zstandard WARC archives: a writer, and a reader that checks what it reads.

An archive starts with a skippable frame that holds its dictionary; each record is one
Zstandard frame that uses it. A task's archives are named by its number and hold its
sorted pages, so a task that runs again writes the same files over; a file appears under
its name only when it is whole. Reading goes through Spark's own binary reader, one archive a row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import lean, materialise, scratch_path

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Bytes of the dictionary, and of the records that it is trained on (an archive's first ones).
DICTIONARY_BYTES = 1 << 14
TRAINING_BYTES = 1 << 20
#: Payload bytes from which equal payloads are written once.
REVISIT_BYTES = 1000
#: Payload bytes that an archive is meant to hold.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: First halves of the record URIs of pages with an id, and without one.
WITH_ID, WITHOUT_ID = 0x77617263_0000_4000, 0x77617263_0000_4FFF


class WarcError(ValueError):
    """An archive that breaks the format."""


def record_id(page_id: int | None) -> str:
    """A URI that carries the page's id in its low 64 bits."""
    high = WITH_ID if page_id is not None else WITHOUT_ID
    return f"<urn:uuid:{uuid.UUID(int=(high << 64) | ((page_id or 0) % (1 << 64)))}>"


def page_of(uri: str) -> int | None:
    """The page's id in a URI of ``record_id``; null for others' URIs and for pages without an id."""
    try:
        number = uuid.UUID(uri.strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    if number >> 64 != WITH_ID:
        return None
    low = number % (1 << 64)
    return low - (1 << 64) if low >> 63 else low


def sha1_of(field: str | None) -> str | None:
    """A ``sha1:`` digest field (base 16 or base 32, as writers differ) in lower-case hex; null for none and for other algorithms."""
    name, _, value = (field or "").partition(":")
    if name.strip().lower() != "sha1":
        return None
    value = value.strip()
    try:
        raw = base64.b32decode(value.upper()) if len(value) == 32 else bytes.fromhex(value)
    except ValueError as e:
        raise WarcError(f"no SHA-1 digest: {value!r}") from e
    if len(raw) != 20:
        raise WarcError(f"no SHA-1 digest: {value!r}")
    return raw.hex()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and drops the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "urn:unknown"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def make_archive(records: list[bytes], level: int = 3) -> bytes:
    """The dictionary's skippable frame, then one frame for each record.

    Few or small records cannot train a dictionary; their archive's first record bytes
    serve as raw content then.
    """
    import zstandard

    samples, size = [], 0
    for r in records:
        samples.append(r[: 1 << 14])
        size += len(samples[-1])
        if size >= TRAINING_BYTES:
            break
    trained = b""
    if len(samples) >= 16:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            trained = b""
    trained = trained or b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True)
    stored = zstandard.ZstdCompressor(level=level).compress(trained)
    return struct.pack("<II", DICTIONARY_MAGIC, len(stored)) + stored + b"".join(map(packer.compress, records))


def frames(archive: bytes) -> Iterator[bytes]:
    """Each record's bytes: the leading dictionary is loaded, then one frame a record is decoded."""
    import zstandard

    if len(archive) < 8:
        raise WarcError("the archive ends inside its first frame")
    magic, size = struct.unpack_from("<II", archive)
    at, dictionary = 0, None
    if magic == DICTIONARY_MAGIC:
        stored = archive[8 : 8 + size]
        if len(stored) != size:
            raise WarcError("the dictionary is cut off")
        if stored[:4] == b"\x28\xb5\x2f\xfd":
            stored = zstandard.ZstdDecompressor().decompress(stored)
        dictionary, at = zstandard.ZstdCompressionDict(stored), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(archive)
    while at < len(archive):
        frame = reader.decompressobj()
        try:
            parts, begin = [], at
            while not frame.eof:
                if begin >= len(archive):
                    raise WarcError("the archive ends inside a frame")
                parts.append(frame.decompress(view[begin : begin + (1 << 16)]))
                begin += 1 << 16
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame does not decode: {e}") from e
        at = min(begin, len(archive)) - len(frame.unused_data)
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; checks version, mandatory headers, length, end and digests."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise WarcError(f"no colon in header {name!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no header {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("the length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes; its header says {n}")
    block = rest[:n]
    if (digest := sha1_of(headers.get("warc-block-digest"))) and digest != hashlib.sha1(block).hexdigest():
        raise WarcError("the block does not have its digest")
    return headers, block


def parse_http(headers: dict[str, str], block: bytes) -> tuple[int, str | None, bytes | None]:
    """(full payload's bytes, its SHA-1, payload or None for a revisit)."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("no HTTP head")
    said = next((x.split(b":", 1)[1].strip() for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    if said is not None and not said.isdigit():
        raise WarcError(f"the HTTP length is no number: {said!r}")
    length, digest = None if said is None else int(said), sha1_of(headers.get("warc-payload-digest"))
    if headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise WarcError("a revisit with a payload or without its target")
        return length or 0, digest, None
    if length is not None and length != len(payload):
        raise WarcError("the payload does not have its HTTP length")
    found_digest = hashlib.sha1(payload).hexdigest()
    if digest is not None and digest != found_digest:
        raise WarcError("the payload does not have its digest")
    return len(payload), found_digest, payload


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write a file whole under its name, on any file system that Arrow knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    attempt = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        out.write(data)
    system.move(attempt, f"{path}/{name}")
    return f"{folder}/{name}"


WRITTEN = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
READ = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, kind, refers_to``: what is written for each page.

    Of pages with one payload of at least ``REVISIT_BYTES`` bytes, those of the largest
    ``page_id`` are responses. The groups are found on ids and digests alone; payloads
    only meet the revisits, by page.
    """
    each = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    slim = materialise(each.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest"), "digests")
    groups = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    revisits = slim.distinct().join(groups, "digest").where("page_id IS NULL OR page_id < refers_to")
    revisits = materialise(revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to"), "revisits")
    return each.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("kind"), "refers_to"
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages``: each task sorts its pages by id and starts a new archive after ``archive_bytes`` of payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = TaskContext.get().partitionId(), 0
        records: list[bytes] = []
        names, counts, sizes = [], [], []

        def close() -> None:
            data = make_archive(records)
            names.append(put_file(folder, f"part-{part:06d}-{len(names):04d}.warc.zst", data))
            counts.append(len(records))
            sizes.append(len(data))
            records.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                records.append(make_record(*row))
                size += len(records[-1])
                if size >= archive_bytes:
                    close()
                    size = 0
        if records:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=WRITTEN.names)

    rows = plan_records(pages).select("page_id", "url", "payload", "digest", "kind", "refers_to")
    return rows.sortWithinPartitions("page_id", "digest", "url").mapInArrow(lean(run), WRITTEN)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in ``folder``; a broken archive raises ``WarcError``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out: list[list] = [[] for _ in range(7)]
                for raw in frames(content.as_buffer().to_pybytes()):
                    headers, block = parse_record(raw)
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    n, digest, payload = parse_http(headers, block)
                    target = headers.get("warc-refers-to")
                    url = headers.get("warc-target-uri")
                    row = (page_of(headers["warc-record-id"]), None if url == "urn:unknown" else url, headers["warc-type"], n, digest, page_of(target) if target else None, payload if payloads else None)
                    for column, x in zip(out, row):
                        column.append(x)
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out[0]), pa.string()), *(pa.array(x, t) for x, t in zip(out, types))], names=READ.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(lean(run), READ)


def archive_and_read(pages: DataFrame, folder: str | None = None, payloads: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write each row of ``pages`` as a WARC record, then read the archives back.

    A null html is an empty payload; very long ones are one record each. Control characters
    and spaces of a url are read back escaped (``%20``); a null url is written as ``urn:unknown`` and read as
    null; a null ``page_id`` is read as null, and such a page only revisits pages with an
    id. Repeated rows are written each, and the rows of the largest id are all responses.
    Other columns are ignored. An empty table writes nothing and gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    written = write_archives(pages, folder, archive_bytes).agg(F.sum("records")).first()[0]
    if not written:
        return spark.createDataFrame([], READ)
    return read_archives(spark, folder, payloads)
