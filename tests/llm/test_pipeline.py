"""The pipeline's stages on planted cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    body = real.where("doc_id = 6").first().text
    near = body.replace(" the ", " teh ", 1)
    junk = "BUY!! NOW!! THIS!! IS!! THE!! BEST!! OFFER!! EVER!! CALL!! US!! TODAY!! " * 5
    planted = [(9001, body, "en", "src1", len(body)), (9002, near, "en", "src1", len(near)), (9003, junk, "en", "src1", len(junk))]
    docs = real.select(*COLUMNS).unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = cp.quality(spark, docs, "")
    assert kept.columns == COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    assert 9003 not in ids and {9001, 9002, 6} <= ids
    alone = cp.near_dedup(spark, kept, "")
    assert alone.columns == COLUMNS
    assert {9001, 9002}.isdisjoint(left := {r.doc_id for r in alone.collect()}) and 6 in left
    cut = cp.substring_dedup(spark, alone, "")
    assert cut.columns == COLUMNS and cut.count() == alone.count()
    mixed = cp.source_mix(spark, cut, "")
    assert mixed.columns == COLUMNS
    pieces = cp.packed(spark, mixed, "")
    assert pieces.agg({"length": "sum"}).first()[0] > 0


@pytest.mark.parametrize("k", range(5))
def test_stages_on_messy_rows(messy, nothing, spark, k):
    """Nulls, empty and very long texts, ties, repeats, clashing names; an empty table. No column changes its name, type or place."""
    _, stage = cp.STAGES[k]
    clash = messy.withColumns({n: F.lit("clash") for n in ("quality_score", "weak_posterior", "digests", "component_id", "hash", "copies", "d1", "rep", "earlier")})
    got = stage(spark, clash, "")
    assert stage(spark, nothing, "").count() == 0
    if k == 4:
        assert got.agg(F.sum("length")).first()[0] > 0
        return
    assert got.schema == clash.schema
    rows = got.collect()
    assert {r[c] for r in rows for c in ("keep", "removed", "quality_score", "hash", "rep")} == {"clash"}
    before = Counter((r.doc_id, r.lang, r.source) for r in clash.collect())
    after = Counter((r.doc_id, r.lang, r.source) for r in rows)
    assert set(after) <= set(before)
    if k == 2:
        assert after == before
    if k < 3:
        assert not after - before


def test_run_is_registered():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and [n for n, _ in cp.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "source mixing", "packing"]
    assert sum(n.startswith("op") and n[2].isdigit() for n in entry.queries()) == 10


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_pipeline(rows):
    """The kept documents and how often each is packed, without Spark."""
    import hashlib

    from linkloom.llm import mixing, passages, weak_labels

    # quality
    feats, counts = weak_labels.Features(), Counter()
    seen = {}
    for i, t, _ in rows:
        data = t.encode()
        seen[i] = (weak_labels.pattern(data, data.split()), *feats.of(data.split()))
        counts[seen[i][0]] += 1
    posterior, _ = weak_labels.posteriors(counts)
    weights, bias = weak_labels.train(sorted((at.tobytes(), v.tobytes(), posterior[p]) for p, at, v in seen.values() if p > 0))
    rows = [r for r in rows if float(weights[seen[r[0]][1]] @ seen[r[0]][2]) + bias >= 0]
    # near copies
    prints = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b:
                both = len(prints[a] & prints[b])
                if both >= 0.8 * (len(prints[a]) + len(prints[b]) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    rows = [r for r in rows if find(r[0]) == r[0]]
    # passages
    first = {}
    for i, t, _ in sorted(rows):
        for d in passages.units(t)[2]:
            first.setdefault(d, i)
    cut = []
    for i, t, s in rows:
        done, kept = 0, []
        for a, b in passages.repeats(t, {d for d in passages.units(t)[2] if first[d] < i}):
            kept.append(t[done:a])
            done = b
        cut.append((i, "".join([*kept, t[done:]]), s))
    # mix
    size = {i: len(t.split()) for i, t, _ in cut}
    source = Counter()
    for i, _, s in cut:
        source[s] += size[i]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(source))}
    target, open_, left = {}, set(source), 1.5 * sum(source.values())
    while True:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= 2 * source[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * source[s]
            left -= target[s]
        open_ -= over
    target |= {s: share * weight[s] for s in open_}
    copies = Counter()
    hashed = {i: int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:15], 16) for i in size}
    for s in source:
        for k in (0, 1):
            budget, total = min(max(target[s] - k * source[s], 0), source[s]), 0
            for i in sorted((i for i, _, x in cut if x == s), key=hashed.get):
                total += size[i]
                if total <= budget or (total - size[i] <= budget and 2 * (budget - total + size[i]) >= size[i]):
                    copies[i] += 1
    return {i: t for i, t, _ in cut}, copies


def test_run_against_brute_force(spark):
    from tokenizers import Tokenizer

    from linkloom.llm.packing import default_tokenizer

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    cut, copies = brute_pipeline(rows)
    t = Tokenizer.from_file(default_tokenizer())
    want = Counter({(i, *t.encode(cut[i], add_special_tokens=False).ids, 0): n for i, n in copies.items() if n})
    got, open_ = Counter(), []
    for r in sorted(cp.run(spark, "/root/testdata/sf0.001").collect(), key=lambda r: (r.sequence_id, r.offset)):
        open_ += np.frombuffer(r.ids, "<u4").tolist()
        if len(open_) == r.doc_tokens:
            got[(r.doc_id, *open_)] += 1
            open_ = []
    assert got == want
