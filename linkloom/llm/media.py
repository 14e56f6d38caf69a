"""Interleaved document sequences with media columns.

HTML is parsed into an ordered list of text and media-reference structs; a media
reference names its payload by digest, and payloads are resolved by a join on that
digest. Media are stored once per distinct payload of a partition as 8-bit grey PNG
images, 64 samples wide; decoding gives the payload back byte for byte.
"""

from __future__ import annotations

import hashlib
import html
import math
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import lean, materialise

#: Samples in an image's row; payloads are padded with zeros to a positive multiple of it.
ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:sha256:"
#: Digests that a task remembers while it looks for repeated payloads; repeats beyond are stored again.
REMEMBERED = 1 << 16


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """``payload`` (a positive multiple of ``ROW`` bytes) as an 8-bit grey image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> bytes:
    """The samples of an unfiltered 8-bit grey image, every chunk's checksum checked."""
    if stored[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, data, ended = 8, None, [], False
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is broken")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not an 8-bit grey image")
            size = (height, width)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("a PNG chunk is missing")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[0], size[1] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not expected")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Image features: an 8x8 mean hash (16 hex digits), the mean sample and the entropy in bits."""
    samples = np.frombuffer(payload, np.uint8)
    rows = samples.reshape(-1, 8, ROW // 8).sum(2, dtype=np.int64)
    edges = [len(rows) * i // 8 for i in range(9)]
    sums = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(rows, 0)])
    cells = np.array([(sums[b] - sums[a]) / (b - a) if b > a else np.zeros(8) for a, b in zip(edges, edges[1:])]).ravel()
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    return f"{bits}:{samples.mean():.3f}:{abs(float(-(share * np.log2(share)).sum())):.4f}"


class Sequence(HTMLParser):
    """Ordered ``(kind, value, caption)``: text runs, and media references with their captions."""

    BREAKS = frozenset(("p", "div", "article", "section", "figure", "figcaption", "li", "h1", "h2", "h3", "br", "td", "img", "audio", "video"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list[str | None]] = []
        self.text: list[str] = []
        #: Open figures: the first item of each, and its caption so far.
        self.figures: list[list] = []
        self.caption = self.skip = False

    def flush(self) -> None:
        run = "".join(self.text)
        self.text.clear()
        if not run.strip():
            return
        if self.caption and self.figures:
            known = self.figures[-1][1]
            self.figures[-1][1] = f"{known} {run.strip()}" if known else run.strip()
        else:
            self.items.append(["text", run, None])

    def end_figure(self) -> None:
        """A figure's caption goes to all its media, before it or after it."""
        start, caption = self.figures.pop()
        for item in self.items[start:]:
            if item[0] == "media" and caption:
                item[2] = caption

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.skip = True
        if tag in self.BREAKS:
            self.flush()
        named = dict(attrs)
        if tag == "figure":
            self.figures.append([len(self.items), None])
        elif tag == "figcaption":
            self.caption = True
        elif tag in ("img", "audio", "video") and (named.get("src") or ""):
            self.items.append(["media", named["src"], named.get("alt")])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = False
        if tag in self.BREAKS:
            self.flush()
        if tag == "figcaption":
            self.caption = False
        elif tag == "figure" and self.figures:
            self.end_figure()

    def finish(self) -> None:
        self.close()
        self.flush()
        while self.figures:
            self.end_figure()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def parse_sequence(page: str | None) -> list[tuple[str, str, str | None]]:
    parser = Sequence()
    parser.feed(page or "")
    parser.finish()
    return [tuple(x) for x in parser.items]


def page_of(digest: str, caption: str) -> str:
    """A page that shows one medium with its caption."""
    return f'<article><figure><img src="{SCHEME}{digest}" alt=""><figcaption>{html.escape(caption)}</figcaption></figure></article>'


STORED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("html", T.StringType()), T.StructField("media", T.BinaryType()),
])
SEQUENCE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("position", T.IntegerType()),
    T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("caption", T.StringType()),
])
FEATURES = T.StructType([
    T.StructField("digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])


def store_media(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n_bytes, html, media``: each text as a medium and the page that shows it.

    ``media`` is null where the same task stored that digest before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, sizes, pages, media = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                payload = pad(data)
                key = hashlib.sha256(payload).digest()
                digests.append(key.hex())
                sizes.append(len(data))
                pages.append(page_of(key.hex(), f"{len(payload)} samples"))
                media.append(None if key in seen else encode_png(payload))
                if len(seen) < REMEMBERED:
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pa.array(sizes, pa.int64()), pa.array(pages), pa.array(media, pa.binary())], names=STORED.names)

    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), STORED), "media")


def sequences(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, position, kind, value, caption`` of ``doc_id, html``: each page's text and media in order; columns ``keep`` go with them."""
    schema = T.StructType([*SEQUENCE.fields, *(pages.schema[k] for k in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[], [], [], []]
            for i, page in enumerate(batch.column(1).to_pylist()):
                for position, item in enumerate(parse_sequence(page)):
                    rows.append(i)
                    for column, x in zip(out, (position, *item)):
                        column.append(x)
            at = pa.array(rows, pa.int64())
            found = [batch.column(0).take(at), pa.array(out[0], pa.int32()), *(pa.array(x, pa.string()) for x in out[1:]), *(batch.column(2 + k).take(at) for k in range(len(keep)))]
            yield pa.RecordBatch.from_arrays(found, names=schema.names)

    return pages.select(F.col("doc_id").cast("long"), "html", *keep).mapInArrow(lean(run), schema)


def media_features(stored: DataFrame) -> DataFrame:
    """Features of each distinct stored medium, computed from its bytes as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload = decode_png(media)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"the medium {digest} reads back as {found}")
                for column, x in zip(out, (len(payload), found, zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))):
                    column.append(x)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, types))], names=FEATURES.names)

    each = stored.where("media IS NOT NULL").select("digest", "media").mapInArrow(lean(run), FEATURES)
    # Written, so that the join to come has plain shuffles on both sides, whose hot digests Spark can split.
    # One whole row a digest: builds of zlib may differ in the bytes that they store.
    rest = FEATURES.names[1:]
    return materialise(each.groupBy("digest").agg(F.min(F.struct("media_sha256", *(c for c in rest if c != "media_sha256"))).alias("m")).select("digest", *(f"m.{c}" for c in rest)), "media-features")


def resolve(pages: DataFrame, stored: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The sequences of ``pages`` (``doc_id, html``) with their media from ``stored`` (``digest, media``).

    Columns: ``doc_id, position, kind, value, caption``, ``keep``, and the medium's
    ``payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``: null
    for text, and for references that name no stored digest (addresses, unknown digests).
    A figure's caption goes with each of its media, others keep their ``alt``. A null or
    empty page gives no rows, a null id stays null, repeated rows stay.
    """
    items = sequences(pages, keep).withColumn("digest", F.expr(f"CASE WHEN kind = 'media' AND startswith(value, '{SCHEME}') THEN substr(value, {len(SCHEME) + 1}) END"))
    return items.join(media_features(stored), "digest", "left").select(*SEQUENCE.names, *keep, *FEATURES.names[1:])


def interleave(docs: DataFrame) -> DataFrame:
    """One row per document: the page that shows its text as a medium, resolved by digest.

    Columns as in ``resolve``, with ``n_bytes``. A null text is empty and is stored as 64
    zeros; very long texts are stored whole. Equal texts share one digest; a digest is
    decoded where it is stored and only its features are joined, so a hot payload moves a
    few bytes a row. Repeated rows stay, a null ``doc_id`` stays null, other columns are
    ignored, an empty table gives no rows.
    """
    stored = store_media(docs)
    return resolve(stored, stored, ("n_bytes",))
