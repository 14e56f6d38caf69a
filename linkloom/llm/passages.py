"""Substring dedup by hashing lines and pieces of lines.

A text's words are normalised (ASCII case and punctuation go) and cut into pieces: at
every line end, and inside lines where the hash of two neighbouring words is the smallest
within ``REACH`` words. Those cuts follow from the words around them alone, so a passage
pasted into the middle of a line has the same inner pieces as its source. Units are chains
of neighbouring pieces of at least ``least_words`` words, and whole lines. Their digests are
grouped over the whole corpus; a unit is a repeat if an earlier document (or an earlier
place in its own) has all its words in a row. Repeats are removed, and their offsets in the
original text are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import HELPER, lean, materialise

#: Words on either side that a cut's hash must be below; pieces have REACH + 1 words at least, about 2 * REACH + 1 on average.
REACH = 2
#: Words in a row that must repeat to be removed from inside lines.
LEAST_WORDS = 25
#: Words of a whole line that is removed where it repeats; shorter ones meet by chance in clean documents.
LEAST_LINE = 4
#: Lower-cases A-Z and blanks other ASCII characters that are no digit or letter; line ends stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c == 10 or 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Scripts that put no spaces between words (Thai to Khmer, Han, kana): each of their characters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
ALONE = re.compile(f"[{UNSPACED}]")
WORD = re.compile(f"[{UNSPACED}]|(?:(?![{UNSPACED}])[0-9A-Za-z\x80-\U0010ffff])+")


def units(text: str | None, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Each unit's first word and the word after its last, and its digest (signed 64 bits).

    Units are the chains of pieces that no piece can leave at one end without falling below
    ``least_words``, and the whole lines of ``LEAST_LINE`` words or more.
    """
    words, ends, text = [], [0], text or ""
    if not text.isascii() and ALONE.search(text):
        text = ALONE.sub(r" \g<0> ", text)
    for line in text.encode().translate(PLAIN).split(b"\n"):
        words += line.split()
        ends.append(len(words))
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    cut[0] = cut[n] = True
    if n > 1:
        h = np.fromiter(map(zlib.crc32, words), np.uint32, n).astype(np.uint64)
        pair = ((h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)
        padded = np.full(len(pair) + 2 * REACH, np.iinfo(np.uint64).max)
        padded[REACH : REACH + len(pair)] = pair
        low = np.ones(len(pair), bool)
        for d in range(1, REACH + 1):
            low &= (pair <= padded[REACH - d : REACH - d + len(pair)]) & (pair < padded[REACH + d : REACH + d + len(pair)])
        cut[1:n] |= low
    edges = np.flatnonzero(cut)
    # The shortest chain from each cut onwards, and the shortest up to each cut.
    after = np.searchsorted(edges, edges + least_words)
    before = np.searchsorted(edges, edges - least_words, side="right") - 1
    onwards, upto = after < len(edges), before >= 0
    first = np.concatenate([edges[onwards], edges[before[upto]]])
    last = np.concatenate([edges[after[onwards]], edges[upto]])
    line = np.array(ends)
    whole = line[1:] - line[:-1] >= LEAST_LINE
    spans = np.unique(np.concatenate([first * (n + 1) + last, line[:-1][whole] * (n + 1) + line[1:][whole]]))
    begin, end = spans // (n + 1), spans % (n + 1)
    joined = b" ".join(words)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)])
    digest = xxhash.xxh64_intdigest
    found = np.array([digest(joined[a:b]) for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist())], np.uint64).view(np.int64).tolist()
    return begin, end, found


def repeats(text: str, earlier: set[int], least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Spans (in characters) of ``text`` to remove: what its units in ``earlier``, or before in the text itself, cover."""
    begin, end, digests = units(text, least_words)
    until: dict[int, int] = {}
    runs: list[list[int]] = []
    for a, b, digest in zip(begin.tolist(), end.tolist(), digests):
        # A unit repeats one of its own text only if that has ended: overlapping copies do not remove each other.
        if digest in earlier or until.setdefault(digest, b) <= a:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
    if not runs:
        return []
    places = [(m.start(), m.end()) for m in WORD.finditer(text)]
    spans = []
    for first, after in runs:
        start, last = places[first][0], places[after - 1][1]
        stop = places[after][0] if after < len(places) else len(text)
        line = text.find("\n", last, stop)
        if line >= 0 and text[text.rfind("\n", 0, start) + 1 : start].strip():
            stop = line  # the run starts inside a line: its line end stays
        spans.append((start, stop))
    return spans


DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("digests", T.ArrayType(T.LongType()))])
#: The column of removed spans, unless another name is given.
REMOVED = "removed"


def unit_digests(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, h, digests``: the distinct unit digests of each document, and its text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.array(units(t, least_words)[2], np.int64)) for t in batch.column(2).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=DIGESTS.names)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(lean(run), DIGESTS)


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, spans: str = REMOVED) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut (and ``n_chars`` counted again, where there is one),
    and ``spans``: the ``(start, end)`` that went, in characters of the original text.

    Documents rank by ``doc_id``, null ids last; the earliest keeps a passage. Rows that
    share an id (or have none) rank alike and keep the same passages; what a document
    repeats of its own goes too. A null text stays null, a text that repeats whole becomes
    empty, very long texts are cut like short ones, and no row is dropped. An input column
    named like ``spans`` is replaced. An empty table gives no rows.
    """
    listed = materialise(unit_digests(docs, least_words), "units")
    each = listed.select("doc_id", "h", F.explode("digests").alias("digest"))
    shared = each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    later = each.join(shared, "digest").where("doc_id IS NULL OR doc_id > first")
    # Rows meet their digests by id and text: rows without an id are no group of their own.
    docs, rank, h = docs.drop(spans), f"{HELPER}id", f"{HELPER}h"
    earlier = later.groupBy(F.col("doc_id").alias(rank), F.col("h").alias(h)).agg(F.collect_set("digest").alias(f"{HELPER}earlier"))
    joined = docs.join(earlier, F.col("doc_id").cast("long").eqNullSafe(F.col(rank)) & (F.xxhash64("text") == F.col(h)), "left").drop(rank, h)

    names, schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField(spans, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    at, count_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    counted = count_at is not None and isinstance(docs.schema["n_chars"].dataType, (T.IntegerType, T.LongType))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column(at).to_pylist(), []
            for i, (text, known) in enumerate(zip(texts, batch.column(len(names)))):
                gone = repeats(text, set(known.values.to_numpy().tolist()) if known.is_valid else set(), least_words) if text else []
                removed.append([{"start": a, "end": b} for a, b in gone])
                if gone:
                    kept, done = [], 0
                    for a, b in gone:
                        kept.append(text[done:a])
                        done = b
                    texts[i] = "".join([*kept, text[done:]])
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            if counted:
                columns[count_at] = pa.array([None if t is None else len(t) for t in texts], columns[count_at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, span)], names=schema.names)

    return joined.mapInArrow(lean(run), schema)


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with their texts cut by ``remove_repeats``, and no other column changed or added."""
    return remove_repeats(docs, least_words, f"{HELPER}{REMOVED}").select(*docs.columns)
