"""SimHash near-duplicates, with candidates by pigeonring chains.

A fingerprint is cut into ``max_bits + 1`` ring segments. If two fingerprints differ in
at most t bits, some segment starts a chain in which any l consecutive segments differ
in at most l * t / m bits together (the pigeonring principle). The first two links of
that chain become a join key: the first segment must agree, the second may differ in one
bit, so each fingerprint stands under its own keys and under those one bit away. The
longer chains prune inside a key, and the full Hamming distance decides. The result is
exact for any corpus: no bucket, partner or candidate is capped.

Equal fingerprints are one class before any link is searched, and inside a key only a
spanning forest of the links is given out, so a group of n copies costs about n rows.
Keys with very many members are dealt out as pairs of blocks.

`near_copies` verifies links by their texts, on wider fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import lean, materialise
from linkloom.llm.components import components

#: Members of a key that one task compares; larger keys become pairs of blocks of this size.
BLOCK = 1 << 16
#: Pairs that one NumPy step compares.
STEP = 1 << 21
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LANES = np.uint64(0x0101010101010101)


@dataclass(frozen=True)
class NearDup:
    """``width``: words in a shingle; ``max_bits``: differing bits that still link."""

    width: int = 5
    max_bits: int = 4
    seed: int = 42


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``width`` lower-cased words, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(begin, end[width - 1 :].tolist())), np.uint64, len(begin))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    at, counts = np.arange(0, n, 255), np.empty((8, 8), np.int64)
    for i in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(i)) & LANES, at)
        counts[:, i] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(counts.ravel() * 2 > n, bitorder="little").view("<u8")[0])


def remix(hashes: np.ndarray) -> np.ndarray:
    """An independent hash of each hash (the SplitMix64 finaliser)."""
    x = (hashes + np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, rule: NearDup) -> DataFrame:
    """``doc_id, fp`` as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(text, rule.width, rule.seed)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=FINGERPRINTS.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), FINGERPRINTS)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the ring's ``max_bits + 1`` segments."""
    m = max_bits + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _keyed(classes: DataFrame, rule: NearDup, own_only: bool = False) -> DataFrame:
    """A row for each class and key: under its own (``own``) and under those one bit off, unless ``own_only``."""
    parts = segments(rule.max_bits)
    rows = []
    for i, (at, n) in enumerate(parts):
        bt, k = parts[(i + 1) % len(parts)]
        head = F.shiftrightunsigned("fp", at).bitwiseAND((1 << n) - 1)
        tail = F.shiftrightunsigned("fp", bt).bitwiseAND((1 << k) - 1)
        own = F.lit(i).cast("long") * F.lit(1 << 40) + head * F.lit(1 << k) + tail
        flips = [0] if own_only else [0, *(1 << b for b in range(k))]
        rows += [F.struct(own.bitwiseXOR(F.lit(x).cast("long")).alias("key"), F.lit(x == 0).alias("own")) for x in flips]
    return classes.select("rep", "fp", F.explode(F.array(*rows)).alias("k")).select("k.key", "k.own", "rep", "fp")


def spread(keyed: DataFrame, heavy: DataFrame, carried: list[str]) -> DataFrame:
    """``key, pair, role`` and ``carried``: the rows of ``keyed`` (``key, own, ...``), a heavy key's as pairs of blocks.

    ``role``: 0 both sides, 1 right only, 2 left only; rows that are not ``own`` stand on
    the right alone. ``heavy``: ``key, n``, the number of blocks. Each pair of blocks is a
    ``pair`` of its own.
    """
    if heavy.isEmpty():
        return keyed.select("key", F.lit(0).alias("pair"), F.when(F.col("own"), 0).otherwise(1).alias("role"), *carried)
    n, own = F.coalesce("n", F.lit(1)), F.pmod(F.xxhash64("rep"), F.coalesce("n", F.lit(1))).cast("int")
    light = F.array(F.struct(F.lit(0).alias("pair"), F.when(F.col("own"), 0).otherwise(1).alias("role")))
    other = F.sequence(F.lit(0), F.col("n") - 1)
    left = F.when(F.col("own"), F.transform(other, lambda j: F.struct((own * F.col("n") + j).alias("pair"), F.lit(2).alias("role")))).otherwise(F.array().cast("array<struct<pair:int,role:int>>"))
    right = F.transform(other, lambda j: F.struct((j * F.col("n") + own).alias("pair"), F.lit(1).alias("role")))
    dealt = F.when(n == 1, light).otherwise(F.concat(left, right))
    return keyed.join(heavy, "key", "left").select("key", *carried, F.explode(dealt).alias("s")).select("key", "s.pair", "s.role", *carried)


def _blocked(classes: DataFrame, rule: NearDup, block: int) -> DataFrame:
    """``_keyed`` by ``spread``. Only keys with over ``block`` own members are cut; there are
    at most (max_bits + 1) * classes / block of them."""
    heavy = _keyed(classes, rule, own_only=True).groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("n"))
    return spread(_keyed(classes, rule), heavy, ["rep", "fp"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links a-b join, one at most for each node."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def nearest(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices of a minimum spanning forest of the links a-b (Boruvka's rounds, ties by index)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, n, m = index[: len(a)], index[len(a) :], len(nodes), len(a)
    order = np.argsort(bits, kind="stable")
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    group, kept = np.arange(n), []
    while True:
        apart = np.flatnonzero(group[x] != group[y])
        if not len(apart):
            return np.concatenate(kept) if kept else apart
        best = np.full(n, m)
        for side in (x, y):
            np.minimum.at(best, group[side[apart]], rank[apart])
        chosen = order[np.unique(best[best < m])]
        kept.append(chosen)
        up, u, v = np.arange(n), group[x[chosen]], group[y[chosen]]
        while (up[u] != up[v]).any():
            low = np.minimum(up[u], up[v])
            np.minimum.at(up, up[u], low)
            np.minimum.at(up, up[v], low)
            up = up[up]
        while (up != up[up]).any():
            up = up[up]
        group = up[group]


LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


#: Members of a group that ``grouped`` hands on with others of its size.
FEW = 8


def grouped(links, unsigned: slice, few=None):
    """A ``mapInArrow`` function that calls ``links(key, role, *others)`` for each key and pair of blocks.

    ``few(i, j, role, *others)``, if given, gets the pairs of rows (``i`` before ``j``) of all
    groups of at most ``FEW`` members at once instead. Batches have ``key, pair, role`` first and come sorted by key and pair; the last group
    waits for the next batch. ``unsigned``: the columns that are passed as unsigned longs.
    """

    def groups(cols: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray] | None]:
        key, pair, role, *others = cols
        edge = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        tail = None
        if not last:
            tail = [c[begin[-1] :].copy() for c in cols]
            begin, end = begin[:-1], end[:-1]
        own = np.concatenate([[0], np.cumsum(role != 1)])
        wanted = (end - begin > 1) & (own[end] > own[begin])
        us, vs = [], []
        if few is not None:
            small = wanted & (end - begin <= FEW)
            wanted &= ~small
            # Each row's group end, or its own place in groups that are not small.
            until = np.repeat(np.where(small, end, 0), end - begin)
            for apart in range(1, FEW):
                i = np.flatnonzero(until[: max(0, len(until) - apart)] > np.arange(apart, max(apart, len(until))))
                if len(i):
                    u, v = few(i, i + apart, role, *others)
                    us.append(u)
                    vs.append(v)
        for a, b in zip(begin[wanted].tolist(), end[wanted].tolist()):
            u, v = links(int(key[a]), role[a:b], *(c[a:b] for c in others))
            if len(u):
                us.append(u)
                vs.append(v)
        found = pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=LINKS.names) if us else None
        return found if found is not None and found.num_rows else None, tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[unsigned] = [c.view(np.uint64) for c in cols[unsigned]]
            waiting.append(cols)
            first = waiting[0]
            if cols[0][-1] == first[0][0] and cols[1][-1] == first[1][0]:
                continue  # one group so far
            cols = [np.concatenate(x) for x in zip(*waiting)] if len(waiting) > 1 else cols
            found, rest = groups(cols, False)
            waiting = [rest]
            if found is not None:
                yield found
        if waiting:
            found, _ = groups([np.concatenate(x) for x in zip(*waiting)], True)
            if found is not None:
                yield found

    return run


def _linker(rule: NearDup):
    """Links of each key: a spanning forest of those within the limit."""
    parts, m = segments(rule.max_bits), rule.max_bits + 1
    chains = []
    for i in range(m):
        mask, steps = 0, []
        for length in range(1, m + 1):
            at, n = parts[(i + length - 1) % m]
            mask |= ((1 << n) - 1) << at
            if 2 < length < m:
                steps.append((np.uint64(mask), length * rule.max_bits // m))
        chains.append(steps or [(np.uint64((1 << 64) - 1), rule.max_bits)])

    def links(key: int, role: np.ndarray, rep: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 2)
        us, vs = [], []
        step = max(1, STEP // max(1, len(right)))
        for at in range(0, len(left), step):
            own = left[at : at + step]
            diff = fp[own][:, None] ^ fp[right][None, :]
            first, most = chains[key >> 40][0]
            i, j = np.nonzero(np.bitwise_count(diff & first) <= most)
            diff = diff[i, j]
            other = rep[own[i]] != rep[right[j]]
            i, j, diff = i[other], j[other], diff[other]
            for mask, most in chains[key >> 40][1:]:
                kept = np.bitwise_count(diff & mask) <= most
                i, j, diff = i[kept], j[kept], diff[kept]
            kept = np.bitwise_count(diff) <= rule.max_bits
            i, j = own[i[kept]], right[j[kept]]
            if len(i):
                a, b = rep[i], rep[j]
                a, b = np.maximum(a, b), np.minimum(a, b)
                a, b = forest(a, b) if len(a) > 8 else (a, b)
                us.append(a)
                vs.append(b)
        if not us:
            return rep[:0], rep[:0]
        u, v = np.concatenate(us), np.concatenate(vs)
        return forest(u, v) if len(us) > 1 else (u, v)

    return grouped(links, slice(4, 5))


def near_duplicates(docs: DataFrame, rule: NearDup = NearDup(), block: int = BLOCK) -> DataFrame:
    """``doc_id, fp, component_id`` for each document.

    ``component_id`` is the smallest ``doc_id`` that links reach. A null text is empty;
    a text without words has fingerprint 0 and links like any other; very long texts count
    whole. Repeated rows give repeated rows. A null ``doc_id`` stays null and takes the
    smallest id of its fingerprint's component (null if no row of that fingerprint has an
    id). Other columns are ignored; an empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, rule), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    # Each class becomes many rows: they are made by as many tasks as will sort them.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = classes.where("rep IS NOT NULL").repartition(tasks)
    if rule.max_bits:
        keyed = _blocked(named, rule, block)
        links = keyed.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(lean(_linker(rule), None), LINKS)
    else:
        links = named.limit(0).select(F.col("rep").alias("u"), F.col("rep").alias("v"))
    found = classes.join(components(links), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")
