"""Packing documents into fixed token windows by concatenating and cutting.

Pass one tokenizes each scan partition once and stores, per document, its ids, the
partition's number and the running token total inside the partition. The partitions'
totals are then summed into global bases (one row per partition). Pass two adds base
and running total, which places every document on one global token line, and cuts that
line at multiples of the window. A document that crosses a boundary gives one record
on either side. Only the partition totals meet in one task.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import bounded, give_back, lean, materialise

#: Tokens in a packed sequence.
WINDOW = 1024
#: Bytes of chunks and ids that a task remembers; a full memory takes no more, which changes no result.
REMEMBERED = 32 << 20
#: What a remembered chunk takes beside its letters and ids.
ENTRY = 180
#: A private-use character that marks where a text is split; texts that hold it are encoded whole.
MARK = "\ue000"
#: Where a space is not the last of its white space, a chunk would not end with a piece.
WIDE_SPACE = re.compile(r" \s")


def default_tokenizer() -> str:
    """Path of the byte-level vocabulary used where no path is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How byte-level vocabularies spell the bytes that do not print, from this code point on.
SPELLED_FROM = 256
#: The pre-tokenizer's own split, for chunks that hold more than letters.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_spelling() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(SPELLED_FROM + i): b for i, b in enumerate(rest)}


class ChunkEncoder:
    """Encodes texts by a Tokenizers file, remembering the ids of chunks.

    A byte-level pre-tokenizer always starts a new piece before a space that a
    non-space follows, so such chunks can be encoded one by one. Unknown chunks go
    through a merge table built from the same file where its ids follow the order of
    its merges; texts with other white space next to a space or with special tokens,
    and files of other kinds, go through the file's own tokenizer whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path, self.left = path, remembered
        self.known: dict[str, bytes] = {}
        self.merges = self.tokenizer = None
        self._load(path)
        # The file's tables take more memory than what was made of them.
        give_back()

    def _load(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [x["content"] for x in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        most = max([len(vocab) - 1, *(x["id"] for x in spec["added_tokens"]), *(vocab.values() if isinstance(vocab, dict) else ())])
        self.dtype = np.dtype("<u4" if most >= 1 << 16 else "<u2")
        step = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] == "BPE" and spec["normalizer"] is None and step.get("type") == "ByteLevel" and step.get("use_regex") and not step["add_prefix_space"]:
            merges = spec["model"]["merges"]
            made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
            if made == sorted(made) and not spec["model"]["dropout"]:
                import tiktoken

                spelled = byte_spelling()
                ranks = {bytes(spelled[c] for c in t): i for t, i in vocab.items() if t not in self.special}
                self.merges = tiktoken.Encoding("file", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})
                self.piece = self.merges._core_bpe.encode_single_piece
                self.code = "HI"[self.dtype.itemsize == 4]
                self.marks = {x: array(self.code, self.piece(x.encode())).tobytes() for x in ".,;:"}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        """The ids by the file's own tokenizer, which is loaded for the first such text."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        word, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in ".,;:" else (chunk, "")
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            packed = array(self.code, self.piece(word.encode())).tobytes() + (self.marks[mark] if mark else b"")
        else:
            packed = array(self.code, self.merges.encode_ordinary(chunk)).tobytes()
        if self.left > 0:
            self.known[chunk] = packed
            self.left -= ENTRY + len(chunk) + len(packed)
        return packed

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.merges is None or MARK in text or WIDE_SPACE.search(text) or any(x in text for x in self.special):
            return self.whole(text)
        chunks = text.replace(" ", MARK + " ").split(MARK)
        known = self.known.get
        return b"".join([known(c) or self._chunk(c) if c else b"" for c in chunks])


TOKENIZED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("local_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """``doc_id, part, local_start, n_tokens, ids`` with ``end_id`` closing each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        part, total, width = TaskContext.get().partitionId(), 0, encoder.dtype.itemsize
        for batch in batches:
            ids = [encoder.encode(t or "") + end for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) // width for x in ids], np.int64)
            starts = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())],
                names=TOKENIZED.names,
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), TOKENIZED)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Pieces of the documents in sequences of ``window`` tokens.

    Returns ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``; ``ids``
    holds the piece's ids as little-endian unsigned 32-bit numbers. A null text counts
    as empty and still gives its closing id, so each row has one piece at least; a very long
    text gives as many pieces as windows it reaches into. A null
    ``doc_id`` is kept as null, repeated rows are packed each, other columns are ignored,
    and an empty table gives no rows. Only the last sequence can be short.
    """
    path = tokenizer or default_tokenizer()
    tokens = materialise(tokenize(docs, path, end_id), "tokens", "zstd")
    order = Window.orderBy("part")
    bases = (
        tokens.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
        .select("part", (F.sum("part_tokens").over(order) - F.col("part_tokens")).alias("base"))
    )
    bases = materialise(bases, "bases")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, size, width, out, ids = [], [], [], [], [], []
            for i, (begin, n, packed) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                wide = np.frombuffer(packed, f"<u{len(packed) // n}").astype("<u4", copy=False).tobytes()
                edges = [begin, *range((begin // window + 1) * window, begin + n, window), begin + n]
                for a, b in zip(edges, edges[1:]):
                    doc.append(i)
                    at.append(a)
                    out.append(a - begin)
                    size.append(b - a)
                    width.append(n)
                    ids.append(wide[4 * (a - begin) : 4 * (b - begin)])
            at = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(out, pa.int64()), pa.array(size, pa.int64()), pa.array(width, pa.int64()), pa.array(at // window), pa.array(at % window), pa.array(ids, pa.binary())],
                names=PIECES.names,
            )

    # One row per scan partition of the input; sent to all executors only while those are few.
    placed = tokens.join(bounded(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("begin"), "n_tokens", "ids")
    return placed.mapInArrow(lean(cut), PIECES)
