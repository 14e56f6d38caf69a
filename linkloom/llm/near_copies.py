"""Near copies: SimHash candidates by pigeonring chains, verified by their shingles.

A text is its set of distinct shingles. Its fingerprint is wide (``segments`` ring segments of
``SEGMENT_BITS`` bits), so that the share of differing bits estimates the similarity well.
Candidates agree in one whole segment and, from there on, must hold a chain of consecutive
segments whose cumulative differences stay within proportional budgets; the chain travels
with the join key. Survivors meet their whole fingerprints for the full Hamming check, and
only then are two texts fetched and their shingles compared.

Two texts of similarity 0.8 differ in 15 % of their bits and agree in a segment of 16 bits
with a chance of 0.07, so 40 segments propose 19 of 20 such pairs and nearly all that are
nearer; unlike texts meet in 40 / 2 ** 16 of all pairs. Texts with one set of shingles are
one class before any link is searched. A key first gives out its nearest links (a minimum
spanning forest), then, where verification leaves a group in parts, every link between two
parts until all are tested or joined. Those groups get three times longer fingerprints
first, so that few of the pairs that are tested fail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import HELPER, bounded, files, lean, materialise
from linkloom.llm.components import components
from linkloom.llm.simhash import BLOCK, LANES, LINKS, STEP, grouped, nearest, remix, shingle_hashes, spread

SEGMENT_BITS = 16
#: Words of 64 bits of the chain that travels with a key.
CARRIED = 3
#: Hashes that one NumPy step counts.
COUNTED = 1 << 17
#: One class in so many is counted to find the keys that are cut into blocks.
SAMPLED = 16
#: Shares of the links' hashes that the rounds after the first one test; a part that a round joins is not tested in the next.
ROUNDS = (0, 1 << 12, 1 << 16)
#: Links whose texts one task compares, so that few links do not make many small files.
TASK_LINKS = 1 << 12


@dataclass(frozen=True)
class NearCopies:
    """``width``: words in a shingle; ``least_jaccard``: share of two texts' distinct
    shingles that links them; ``segments`` (a multiple of 4): ring segments, each a join key;
    ``chain_bits``: differing bits that the chains' budgets share out by segments, above
    ``max_bits``, the limit of the whole fingerprints, as a chain from a given segment can
    have more than its share. Groups that are searched again have fingerprints of
    ``fine_words`` words, whose limit is ``fine_bits``."""

    width: int = 5
    least_jaccard: float = 0.8
    segments: int = 40
    chain_bits: int = 136
    max_bits: int = 120
    fine_words: int = 30
    fine_bits: int = 330
    seed: int = 42

    @property
    def words(self) -> list[str]:
        return [f"w{i}" for i in range(self.segments * SEGMENT_BITS // 64)]

    @property
    def finer(self) -> list[str]:
        """The words of the fine fingerprint beyond ``words``."""
        return [f"w{i}" for i in range(len(self.words), self.fine_words)]


def shingle_set(text: str | None, rule: NearCopies) -> np.ndarray:
    return np.unique(shingle_hashes(text, rule.width, rule.seed))


def wide_prints(sets: list[np.ndarray], words: int, begin: int = 0) -> np.ndarray:
    """A row of ``words`` 64-bit words (from the ``begin``-th on) for each set of hashes: the majority of each bit; zeros for an empty set."""
    out = np.zeros((len(sets), words), np.uint64)
    kept = [i for i, s in enumerate(sets) if len(s)]
    if not kept:
        return out
    hashes, sizes = np.concatenate([sets[i] for i in kept]), np.array([len(sets[i]) for i in kept])
    # Bits are summed in byte lanes, 255 hashes at most in a lane.
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    at = np.repeat(np.cumsum(sizes) - sizes - 255 * first, parts) + 255 * np.arange(parts.sum())
    counts = np.empty((len(kept), 8, 8), np.int64)
    for w in range(words):
        x = remix(hashes + np.uint64((begin + w) * 0xD1342543DE82EF95 % (1 << 64)))
        for i in range(8):
            lanes = np.add.reduceat((x >> np.uint64(i)) & LANES, at)
            counts[:, :, i] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        set_bits = (2 * counts > sizes[:, None, None]).reshape(-1, 64)
        out[kept, w] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def prints(docs: DataFrame, rule: NearCopies) -> DataFrame:
    """``doc_id, d1, d2, w0, w1, ...``: a digest of each text's shingle set, and its fingerprint."""
    names = rule.words
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "d1", "d2", *names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, sets, held = [], [], [], 0
            for text in batch.column(1).to_pylist():
                sets.append(shingle_set(text, rule))
                digests.append(xxhash.xxh3_128_digest(sets[-1].tobytes()))
                held += len(sets[-1])
                if held >= COUNTED:
                    rows.append(wide_prints(sets, len(names)))
                    sets, held = [], 0
            rows.append(wide_prints(sets, len(names)))
            found = np.concatenate(rows).view(np.int64)
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in (*digest.T, *found.T))], names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), schema)


def fine_prints(classes: DataFrame, docs: DataFrame, rule: NearCopies) -> DataFrame:
    """``classes`` (a written table) with the words ``rule.finer``, from the texts of their ``rep`` alone."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("rep", *rule.finer)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = wide_prints([shingle_set(t, rule) for t in batch.column(1).to_pylist()], len(rule.finer), len(rule.words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=schema.names)

    return classes.join(texts_of(classes.select(F.col("rep").alias("doc_id")), docs).mapInArrow(lean(run, 256), schema), "rep")


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of the ids of a written table; of rows that share an id, the smallest text."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(bounded(ids), "doc_id", "left_semi")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"))


def _window(names: list[str], segment: int) -> Column:
    """The four segments from ``segment`` on, around the ring, as one word."""
    word, shift = segment // 4 % len(names), SEGMENT_BITS * (segment % 4)
    if not shift:
        return F.col(names[word])
    return F.shiftrightunsigned(names[word], shift).bitwiseOR(F.shiftleft(names[(word + 1) % len(names)], 64 - shift))


def _keyed(classes: DataFrame, rule: NearCopies) -> DataFrame:
    """``key, own, rep, c0, c1, ...``: a row for each class and segment, with the chain after it.

    Classes with a ``root`` are few: they carry their fine fingerprints and their root as well.
    """
    names, carried = rule.words, ["rep", *([*rule.words, *rule.finer, "root"] if "root" in classes.columns else [])]
    rows = [
        F.struct(
            (F.lit(i << 20) + F.shiftrightunsigned(names[i // 4], SEGMENT_BITS * (i % 4)).bitwiseAND((1 << SEGMENT_BITS) - 1)).alias("key"),
            *(_window(names, i + 1 + 4 * k).alias(f"c{k}") for k in range(CARRIED)),
        )
        for i in range(rule.segments)
    ]
    return classes.select(*carried, F.explode(F.array(*rows)).alias("k")).select("k.key", F.lit(True).alias("own"), "rep", *(f"k.c{k}" for k in range(CARRIED)), *carried[1:])


def _linker(rule: NearCopies, share: tuple[int, int] | None):
    """Links of each key: a minimum spanning forest of the chains, or with ``share`` all those
    between two roots whose hash is in it and whose fine fingerprints are near."""
    budget = [length * rule.chain_bits // rule.segments for length in range(4 * CARRIED + 2)]
    ends = [np.uint64((1 << SEGMENT_BITS * (k + 1)) - 1) for k in range(3)]

    def chained(i: np.ndarray, j: np.ndarray, rep: np.ndarray, rest: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of rows that hold the chain, and its differing bits. The chain's first segment agrees; each prefix must stay within its budget."""
        bits = np.zeros(len(i), np.int64)
        for k, column in enumerate(rest[:CARRIED]):
            diff = column[i] ^ column[j]
            near = np.ones(len(i), bool)
            for s, mask in enumerate(ends):
                near &= bits + np.bitwise_count(diff & mask) <= budget[4 * k + s + 2]
            bits = bits + np.bitwise_count(diff)
            near &= bits <= budget[4 * k + 5]
            i, j, bits = i[near], j[near], bits[near]
        if share is not None:
            words, root = rest[CARRIED:-1], rest[-1]
            dealt = remix(rep[i].view(np.uint64) ^ remix(rep[j].view(np.uint64))) >> np.uint64(48)
            near = (root[i] != root[j]) & (dealt >= share[0]) & (dealt < share[1])
            i, j, bits = i[near], j[near], bits[near]
            near = sum((np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words), np.zeros(len(i), np.int64)) <= rule.fine_bits
            i, j, bits = i[near], j[near], bits[near]
        return i, j, bits

    def few(i: np.ndarray, j: np.ndarray, role: np.ndarray, rep: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = (np.bitwise_count(rest[0][i] ^ rest[0][j]) <= budget[5]) & (rep[i] != rep[j])
        met &= ((role[i] != 1) & (role[j] != 2)) | ((role[j] != 1) & (role[i] != 2))
        i, j = np.where(rep[i] > rep[j], i, j)[met], np.where(rep[i] > rep[j], j, i)[met]
        i, j, _ = chained(i, j, rep, rest)
        return rep[i], rep[j]

    def links(key: int, role: np.ndarray, rep: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 2)
        us, vs, ws = [], [], []
        step = max(1, STEP // max(1, len(right)))
        for at in range(0, len(left), step):
            own = left[at : at + step]
            i, j = np.nonzero(np.bitwise_count(rest[0][own][:, None] ^ rest[0][right][None, :]) <= budget[5])
            i, j = own[i], right[j]
            later = rep[i] > rep[j]
            i, j, bits = chained(i[later], j[later], rep, rest)
            if not len(i):
                continue
            a, b = rep[i], rep[j]
            if share is None and len(a) > 8:
                best = nearest(a, b, bits)
                a, b, bits = a[best], b[best], bits[best]
            us.append(a)
            vs.append(b)
            ws.append(bits)
        if not us:
            return rep[:0], rep[:0]
        u, v, w = np.concatenate(us), np.concatenate(vs), np.concatenate(ws)
        if share is None and len(us) > 1:
            best = nearest(u, v, w)
            return u[best], v[best]
        return u, v

    return grouped(links, slice(4, 4 + CARRIED + (rule.fine_words if share is not None else 0)), few)


def _links(classes: DataFrame, rule: NearCopies, block: int, share: tuple[int, int] | None = None) -> DataFrame:
    """Distinct links of the chains; keys of more than ``block`` members are dealt out as pairs of blocks."""
    keyed = _keyed(classes, rule)
    some = keyed.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0) if block >= 16 * SAMPLED else keyed
    each = SAMPLED if block >= 16 * SAMPLED else 1
    heavy = some.groupBy("key").count().where(F.col("count") * each > block).select("key", F.ceil(F.col("count") * each / block).cast("int").alias("n"))
    dealt = spread(keyed, heavy, [c for c in keyed.columns if c not in ("key", "own")])
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(lean(_linker(rule, share), None), LINKS).distinct()


def within(links: DataFrame, classes: DataFrame, rule: NearCopies) -> DataFrame:
    """The links whose whole fingerprints differ in ``max_bits`` at most."""
    side = lambda name: classes.select(F.col("rep").alias(name), *(F.col(w).alias(f"{name}_{w}") for w in rule.words))
    bits = sum((F.bit_count(F.col(f"u_{w}").bitwiseXOR(F.col(f"v_{w}"))) for w in rule.words), F.lit(0))
    return links.join(side("u"), "u").join(side("v"), "v").where(bits <= rule.max_bits).select("u", "v")


def verified(links: DataFrame, docs: DataFrame, rule: NearCopies) -> DataFrame:
    """The links (a written table) whose texts share ``least_jaccard`` of their distinct shingles; only linked texts are fetched."""
    n = links.count()
    linked = links.select("u").union(links.select("v")).distinct().withColumnRenamed("u", "doc_id")
    linked = materialise(linked.coalesce(files(2 * n)), "linked-ids")
    texts = materialise(texts_of(linked, docs).coalesce(files(linked.count(), TASK_LINKS)), "linked-texts")
    side = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, known = [], {}
            for ids in zip(*(c.to_pylist() for c in batch.columns)):
                for i, t in zip(ids, ids[2:]):
                    if i not in known:
                        known[i] = shingle_set(t, rule)
                x, y = known[ids[0]], known[ids[1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= rule.least_jaccard * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], names=LINKS.names)

    met = links.join(side("u"), "u").join(side("v"), "v").select("u", "v", "text_u", "text_v")
    return met.coalesce(files(n, TASK_LINKS)).mapInArrow(lean(run), LINKS)


def _reach(proposed: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, reach``: the smallest node that proposed links reach. Parts that verified links join (``roots``) are one node each on the way."""
    side = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    ends = proposed.join(side("u"), "u", "left").join(side("v"), "v", "left").select(F.coalesce("u_root", "u").alias("a"), F.coalesce("v_root", "v").alias("b"))
    above = components(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    nodes = proposed.select(F.col("u").alias("node")).union(proposed.select("v")).distinct()
    part = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("part"))
    return part.join(above.select(F.col("node").alias("part"), F.col("root").alias("reach")), "part", "left").select("node", F.coalesce("reach", "part").alias("reach"))


def _in_parts(classes: DataFrame, reach: DataFrame, roots: DataFrame) -> DataFrame:
    """The classes, with ``root``, in groups of proposed links (``reach``) that the verified
    ones (``roots``) leave in parts. Two classes alone have one link, and it failed."""
    parts = reach.join(roots, "node", "left").select("node", "reach", F.coalesce("root", "node").alias("root"))
    parts = materialise(parts.coalesce(files(reach.count())), "parts")
    groups = parts.groupBy("reach").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("n > 2 AND a < b").select("reach")
    return classes.join(parts.join(groups, "reach", "left_semi"), F.col("rep") == F.col("node")).select(*classes.columns, "root")


def near_copies(docs: DataFrame, rule: NearCopies = NearCopies(), block: int = BLOCK) -> DataFrame:
    """``doc_id, component_id`` for each document: the smallest ``doc_id`` that links reach.

    A null text is empty; texts without words are copies of one another. Repeated rows give
    repeated rows. Rows that share an id but not their text are classes that share a name;
    the smallest of their texts is compared. A null ``doc_id`` stays null and takes the
    smallest id of its text's component (null if no such text has an id). Very long texts
    count whole. Other columns are ignored; an empty table gives no rows.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = materialise(prints(docs, rule), "prints")
    classes = listed.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), *(F.first(w).alias(w) for w in rule.words))
    # Each class becomes many rows: they are made by as many tasks as will sort them.
    classes = materialise(classes.repartition(tasks), "classes")
    named = classes.where("rep IS NOT NULL").select("rep", *rule.words)
    proposed = materialise(_links(named, rule, block), "chain-links")
    near = materialise(within(proposed, named, rule).coalesce(files(proposed.count())), "near-links")
    passed = materialise(verified(near, docs, rule), "verified")
    roots, fine = components(passed), None
    reach = materialise(_reach(proposed, roots).coalesce(files(2 * proposed.count())), "reach")
    for share in zip(ROUNDS, ROUNDS[1:]):
        left = materialise(_in_parts(named, reach, roots).coalesce(files(reach.count())), "in-parts")
        if left.isEmpty():
            break
        if fine is None:
            # Later rounds search some of these classes again.
            fine = materialise(fine_prints(left.drop("root"), docs, rule), "fine-prints")
        left = fine.join(left.select("rep", "root"), "rep")
        more = materialise(_links(left.repartition(tasks), rule, block, share), "more-links")
        if more.isEmpty():
            continue
        # Each part is a star already; only the new links join some.
        new = materialise(verified(more, docs, rule), "verified")
        roots = components(new.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    found = classes.join(roots, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("root", "rep").alias("component_id"))
    return listed.select("doc_id", "d1", "d2").join(found, ["d1", "d2"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, rule: NearCopies = NearCopies()) -> DataFrame:
    """``docs`` with one document of each group of near copies: that of the smallest id.

    Exact repeats of a kept row go as well. Rows without an id stay: no link can name
    them. All columns are kept as they were; an empty table stays empty.
    """
    key = f"{HELPER}id"
    found = near_copies(docs, rule).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("root"), F.count("*").alias("n"))
    special = found.select(F.col("doc_id").alias(key), (F.col("doc_id") != F.col("root")).alias("goes"), "n").where("goes OR n > 1")
    special = materialise(special, "special-ids")
    # The ids that go are far fewer than those that stay; texts stay where they are while those fit a broadcast.
    goes, repeated = (bounded(special.where(which).select(key)) for which in ("goes", "NOT goes"))
    same = F.col("doc_id").cast("long") == F.col(key)
    rest = docs.join(goes, same, "left_anti")
    again = rest.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(repeated, same, "left_anti").unionByName(again)
