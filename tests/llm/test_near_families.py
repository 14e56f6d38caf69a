"""Near copies by brute force: large families, and the recall at each similarity."""

import random

import numpy as np
import pytest

from linkloom.llm import near_copies
from linkloom.llm.near_copies import NearCopies, shingle_set

RULE = NearCopies()


def edited(base, rng, edits, tag):
    text = base[:]
    for at in rng.sample(range(len(base)), edits):
        text[at] = f"e{tag}x{at}"
    return " ".join(text)


def jaccard(a, b):
    both = len(a & b)
    return both / max(1, len(a) + len(b) - both)


def brute(rows):
    """The smallest id that links of a similarity of 0.8 reach, for each id; all pairs are compared."""
    sets, root = [set(shingle_set(t, RULE).tolist()) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if find(a) != find(b) and jaccard(sets[a], sets[b]) >= 0.8:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("block", [near_copies.BLOCK, 50])
def test_a_large_family_is_verified_whole(spark, block):
    """Variants of one text with two to six of its 200 words edited: many proposed links fail."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, edited(base, rng, rng.randint(2, 6), i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, RULE, block).collect()}
    assert got == brute(rows)


def test_recall_by_similarity(spark):
    """Pairs alone, of 100 and 300 words: at least 0.9 of those at 0.8 to 0.85, nearly all above; none below 0.8."""
    rng, rows, pairs = random.Random(11), [], []
    for i in range(1200):
        n = rng.choice((100, 300))
        base = [f"{i}w{rng.randrange(5000)}" for _ in range(n)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, edited(base, rng, max(1, round(n * rng.uniform(0.003, 0.026))), i))]
        a, b = (set(shingle_set(t, RULE).tolist()) for _, t in rows[-2:])
        pairs.append(jaccard(a, b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    linked = np.array([got[2 * i + 1] == 2 * i for i in range(len(pairs))])
    near = np.array(pairs)
    recall = {lo: (int(((near >= lo) & (near < hi)).sum()), float(linked[(near >= lo) & (near < hi)].mean())) for lo, hi in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01))}
    print(recall)
    assert not linked[near < 0.8].any()
    assert recall[0.8][1] >= 0.9 and recall[0.85][1] >= 0.97 and recall[0.9][1] >= 0.99 and linked[near >= 0.8].mean() >= 0.95


def test_repeated_lines_do_not_hide_other_words(spark):
    """A line that stands forty times rules a fingerprint that counts repeats; sets do not see it."""
    line = " ".join(f"r{i}" for i in range(15))
    rows = [(k, "\n".join([line] * 40) + "\n" + " ".join(f"{k}u{i}" for i in range(100))) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == {k: k for k in range(6)}


def test_fingerprints_against_counting_bits():
    sets = [np.zeros(0, np.uint64), np.array([5], np.uint64), np.random.default_rng(1).integers(0, 1 << 63, 700).astype(np.uint64)]
    got = near_copies.wide_prints(sets, 2)
    for row, s in zip(got.tolist(), sets):
        for w, word in enumerate(row):
            x = near_copies.remix(s + np.uint64(w * 0xD1342543DE82EF95 % (1 << 64))).tolist()
            assert word == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x))
