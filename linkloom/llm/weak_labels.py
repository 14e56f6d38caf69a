"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. The votes of
all documents are counted by pattern (at most 3 ** labellers rows), and expectation-
maximisation on those counts estimates each labeller's votes given the class, which
yields a posterior for each pattern. The posteriors of a bounded sample of documents
train a logistic scorer on hashed word features, and the scorer judges every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import HELPER, lean, materialise

UPPER, LETTERS, DIGITS = bytes(range(65, 91)), bytes((*range(65, 91), *range(97, 123), *range(128, 256))), bytes(range(48, 58))
SYMBOLS = b"*$%&#@^~=+<>{}[]\\_"
#: Words that are a mark alone.
BARE = frozenset(bytes([c]) for c in b"|*$%&#@^~=+<>-_/\\.,;:!?")
#: Words per block of the distinct-word share, so that long texts are judged like short ones.
BLOCK = 500


#: Labellers in the order of ``votes``. All but the last vote bad or nothing; "prose" votes either way.
LABELLERS = ("capitals", "shouting", "symbols", "tables", "bare", "stutter", "variety", "letters", "prose")
GOOD, BAD = 1, 2
#: Documents that train the scorer at most (in expectation), whatever the corpus has.
TRAIN_ROWS = 20_000
#: Bytes of hashed features that the driver collects for training (in expectation).
TRAIN_BYTES = 32 << 20
#: Hash bits of the sample's threshold: fine enough for a share of any corpus.
SAMPLE_BITS = 60
DIMENSIONS = 1 << 15


def votes(data: bytes, words: list[bytes]) -> tuple[int, ...]:
    """Each labeller's vote (0: none); a text of under three words gets none."""
    n = len(words)
    if n < 3:
        return (0,) * len(LABELLERS)
    solid = sum(map(len, words))
    letters = len(data) - len(data.translate(None, LETTERS))
    capitals = (len(data) - len(data.translate(None, UPPER))) / letters if letters else 0.0
    marks = len(data) - len(data.translate(None, SYMBOLS))
    stutter = sum(map(eq, words, words[1:])) / n
    alone = [w for w in words if len(w) == 1]
    bare = sum(w in BARE for w in alone) / n
    lettered = (len(data) - len(data.translate(None, LETTERS + DIGITS))) / solid
    variety = sum(len(set(words[i : i + BLOCK])) for i in range(0, n, BLOCK)) / n if n >= 20 else 1.0
    bad = (capitals >= 0.5, data.count(b"!!") / n >= 0.3, marks / n >= 1, alone.count(b"|") / n >= 0.15, bare >= 0.15, stutter >= 0.25, variety <= 0.25, lettered <= 0.65)
    plain = lettered >= 0.85 and capitals <= 0.2 and stutter <= 0.05 and bare <= 0.02 and marks / n <= 0.1
    odd = lettered <= 0.7 or capitals >= 0.4 or stutter >= 0.2 or bare >= 0.1
    return (*(BAD * x for x in bad), GOOD if plain else BAD if odd else 0)


def pattern(data: bytes, words: list[bytes]) -> int:
    """All votes as one number in base 3."""
    code = 0
    for vote in votes(data, words):
        code = code * 3 + vote
    return code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


def posteriors(counts: dict[int, int], rounds: int = 60) -> tuple[dict[int, float], dict[str, float]]:
    """P(good) of each pattern, and each labeller's accuracy where it votes.

    A vote is right with the labeller's accuracy whatever the class, an absent vote says
    nothing, and the classes start out even. Two labels are counted beforehand.
    """
    codes = sorted(counts)
    if not codes:
        return {}, dict.fromkeys(LABELLERS, 0.9)
    cast, n = np.array([votes_of(c) for c in codes]), np.array([counts[c] for c in codes], float)
    accuracy = np.full(len(LABELLERS), 0.9)
    good = np.full(len(codes), 0.5)
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        good = 1 / (1 + np.exp(-np.clip(((cast == GOOD) * odds - (cast == BAD) * odds).sum(1), -500, 500)))
        right = ((cast == GOOD) * good[:, None] + (cast == BAD) * (1 - good)[:, None]) * n[:, None]
        accuracy = np.clip((right.sum(0) + 1.8) / (((cast != 0) * n[:, None]).sum(0) + 2), 0.51, 0.9999)
    return dict(zip(codes, good.tolist())), dict(zip(LABELLERS, accuracy.tolist()))


#: Every letter to a or A, every digit to 0.
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


def shape(word: bytes) -> bytes:
    """The word's outline: runs of one kind of character count once."""
    s = word.translate(SHAPE)
    return bytes(c for i, c in enumerate(s) if i == 0 or s[i - 1] != c)[:12]


class Features:
    """Hashed features of a text: square roots of the shares of word outlines, word ends and repeats."""

    def __init__(self, dimensions: int = DIMENSIONS, remembered: int = 1 << 17):
        self.dimensions, self.left = dimensions, remembered
        #: Both features of a word as one number.
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        found = zlib.crc32(b"s" + shape(word)) % self.dimensions * self.dimensions + zlib.crc32(b"e" + word[-2:]) % self.dimensions
        if self.left > 0:
            self.known[word] = found
            self.left -= 1
        return found

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        counts = Counter(words)
        pairs = list(map(self.known.get, counts))
        if None in pairs:
            pairs = [self._word(w) if p is None else p for w, p in zip(counts, pairs)]
        outline, end = np.divmod(np.array(pairs, np.int64), self.dimensions)
        weight = np.fromiter(counts.values(), float, len(counts))
        index = np.concatenate([outline, end, [zlib.crc32(b"repeat") % self.dimensions]])
        at, inverse = np.unique(index, return_inverse=True)
        repeated = sum(map(eq, words, words[1:]))
        return at.astype(np.int32), np.sqrt(np.bincount(inverse, np.concatenate([weight, weight, [repeated]])) / n).astype(np.float32)


def train(rows: list[tuple[bytes, bytes, float]], dimensions: int = DIMENSIONS, rounds: int = 250, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights and bias from (indices, values, P(good)), by full-batch Adagrad."""
    weights, bias = np.zeros(dimensions), 0.0
    if not rows:
        return weights.astype(np.float32), 20.0
    index = [np.frombuffer(r[0], np.int32) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in index])
    at = np.concatenate(index).astype(np.int64)
    value = np.concatenate([np.frombuffer(r[1], np.float32) for r in rows]).astype(float)
    label = np.array([r[2] for r in rows])
    steps, bias_step = np.full(dimensions, 1e-6), 1e-6
    for _ in range(rounds):
        z = np.bincount(row, value * weights[at], len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(rows)
        g = np.bincount(at, value * error[row], dimensions) + decay * weights / dimensions
        steps += g * g
        weights -= rate * g / np.sqrt(steps)
        b = error.sum()
        bias_step += b * b
        bias -= rate * b / np.sqrt(bias_step)
    return weights.astype(np.float32), float(bias)


COUNTED = T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("n", T.LongType())])
SAMPLED = T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("dealt", T.LongType())])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    posterior: dict[int, float]
    accuracy: dict[str, float]


def sample_limit(total: int, wanted: int) -> int:
    """The threshold on a hash of ``SAMPLE_BITS`` bits that about ``wanted`` of ``total`` fall below."""
    return (1 << SAMPLE_BITS) if total <= wanted else max(1, (wanted << SAMPLE_BITS) // total)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Count all documents' vote patterns, then train the scorer on ``train_rows`` of them by hash.

    Only documents that get a vote train. Long texts can make their features exceed
    ``train_bytes``; the hash's threshold is lowered then in proportion.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                data = (text or "").encode()
                found[pattern(data, data.split())] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=COUNTED.names)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(dimensions)
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(0).to_pylist():
                data = (text or "").encode()
                words = data.split()
                at, value = features.of(words)
                for column, x in zip(out, (pattern(data, words), at.tobytes(), value.tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), batch.column(1)], names=SAMPLED.names)

    counts = {r.pattern: r.n for r in docs.select("text").mapInArrow(lean(count), COUNTED).groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    posterior, accuracy = posteriors(counts)
    limit = sample_limit(sum(n for p, n in counts.items() if p), train_rows)
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - SAMPLE_BITS)
    some = docs.select("text", hashed.alias("dealt")).where(F.col("dealt") < limit)
    drawn = materialise(some.mapInArrow(lean(sample), SAMPLED).where("pattern > 0"), "training")
    size = drawn.agg(F.sum(F.octet_length("at") + F.octet_length("value"))).first()[0] or 0
    if size > train_bytes:
        drawn = drawn.where(F.col("dealt") < max(1, limit * train_bytes // size))
    rows = [(bytes(r.at), bytes(r.value), posterior[r.pattern]) for r in drawn.select("pattern", "at", "value").collect()]
    return Model(*train(sorted(rows), dimensions), posterior, accuracy)


#: Names of the scorer's two columns.
SCORES = ("quality_score", "weak_posterior")


def score(docs: DataFrame, model: Model, names: tuple[str, ...] = SCORES) -> DataFrame:
    """All columns of ``docs``, and the scorer's P(good) as ``names[0]`` and the labellers' as ``names[1]``, if there is one.

    A column of ``docs`` that has one of these names is replaced.
    """
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    at, dimensions = docs.columns.index("text"), len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(dimensions)
        for batch in batches:
            scores, posterior = [], []
            for text in batch.column(at).to_pylist():
                data = (text or "").encode()
                words = data.split()
                index, value = features.of(words)
                z = float(model.weights[index] @ value) + model.bias
                scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
                if len(names) > 1:
                    posterior.append(model.posterior.get(pattern(data, words), 0.5))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.float64()) for x in (scores, posterior)[: len(names)])], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def classify(docs: DataFrame, least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``quality_score``, ``weak_posterior`` and ``keep`` (score at least ``least``).

    The model is fitted on ``docs`` itself. A null or empty text has no features and gets
    the scorer's bias; texts of under three words get no votes; very long texts are read
    whole. Where no document gets a vote nothing is learnt and all are kept. Repeated rows
    score alike, null ids stay null, input columns of the three names are replaced, and an
    empty table gives no rows.
    """
    return score(docs.drop("keep"), fit(docs, train_rows)).withColumn("keep", F.col("quality_score") >= least)


def keep_good(docs: DataFrame, least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns as they were."""
    name = HELPER + SCORES[0]
    return score(docs, fit(docs, train_rows), (name,)).where(F.col(name) >= least).select(*docs.columns)
