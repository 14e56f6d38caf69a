"""Document operators against brute force, on messy rows and on nothing."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkloom.llm import license_scan, media, mixing, near_copies, order_minhash, packing, passages, simhash, weak_labels

SMALL = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# --- licence scan ---


def test_license_scan_against_brute_force(spark):
    from linkloom.llm.queries import op1_license_scan

    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    want = {}
    for i, t in texts(spark).items():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        at = [(k, label) for p, label in phrases.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        want[i] = (len(ws), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
    got = {r.doc_id: r for r in op1_license_scan(spark, SMALL).collect()}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()} == want
    for r in got.values():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_templates_are_found_when_edited(spark):
    text = "intro words Permission is hereby granted, free of charge, to any human person obtaining a copy of this software and associated files to deal in the Software without restriction, outro"
    docs = spark.createDataFrame([(1, text), (2, "permission is a nice word and charge is another"), (3, "This work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert got == {1: "mit", 2: "", 3: "gpl-3"}


def brute_alignments(text, idf, rule):
    """label -> best share over every start and every template."""
    ws, found = license_scan.words(text), {}
    for t in license_scan.TEMPLATES:
        tw = license_scan.words(t.text)
        weight = [idf[w] for w in tw]
        slack = max(rule.slack, len(tw) // 16)
        for start in range(-slack, len(ws)):
            lo = max(0, start - slack)
            window = ws[lo : max(0, start + len(tw) + slack)]
            share = sum(x for i, (w, x) in enumerate(zip(tw, weight)) if w in ws[max(0, start + i - slack) : max(0, start + i + slack + 1)]) / sum(weight)
            joined = b" " + b" ".join(window) + b" "
            if share >= rule.least and all(b" " + b" ".join(license_scan.words(p)) + b" " in joined for p in t.mandatory):
                found[t.label] = max(found.get(t.label, 0.0), min(1.0, share))
    return found


def test_alignments_against_every_start(spark):
    """Whole and edited licence texts inside other words: labels and scores as trying all starts gives them."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        t = license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)]
        ws = t.text.split()
        for at in rng.choice(len(ws), int(rng.integers(0, 1 + len(ws) // 6)), replace=False):
            ws[at] = rng.choice(["", "edited", "two words", ws[at] + " software"])
        ahead, after = (" ".join(rng.choice(["the", "software", "license", "of", "copyright", "x1", "x2"], int(rng.integers(0, 40)))) for _ in range(2))
        rows.append((i, f"{ahead} {' '.join(ws)} {after}" if i % 7 else f"{ahead} {' '.join(ws[: len(ws) // 2])} {after}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = {w for t in (*license_scan.PHRASES, *license_scan.TEMPLATES) for w in license_scan.words(t.text)}
    idf = license_scan.word_weights(docs, vocabulary)
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    hits = 0
    for i, text in rows:
        want = brute_alignments(text, idf, license_scan.ScanRule())
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == base | set(want), i
        assert got[i].score == pytest.approx(1.0 if base else max(want.values(), default=0.0))
        hits += bool(want)
    assert hits > 20


# --- mixing ---


def test_mixing_stays_near_its_targets(messy, spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 50), f"s{i % 5}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    for s, t in target.items():
        assert abs(taken[s] - t) <= 25
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


# --- order minhash ---


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(8 if not isinstance(v, np.int32) else 4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def brute_sketch(text, width=5, length=2, orders=32):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]{1,32}", text)]
    if not words:
        return []
    h = [spark_hash([w]) for w in words]
    kmers = [spark_hash(h[i : i + width]) for i in range(len(h) - width + 1)] if len(h) >= width else [spark_hash(h)]
    seen, ids = Counter(), []
    for k in kmers:
        ids.append(spark_hash([k, np.int32(seen[k])]) if seen[k] else k)
        seen[k] += 1
    out = []
    for i in range(orders // 4):
        whole = [spark_hash([k, np.int32(i)]) if i else k for k in ids]
        for ranks in (whole, [signed((x << 32) % (1 << 64)) for x in whole]):
            for down in (False, True):
                taken = sorted(sorted(ranks, reverse=down)[:length], key=ranks.index)
                out.append(spark_hash(taken) >> 32)
    return out


def test_order_minhash_against_brute_force(spark, messy):
    some = dict(sorted(texts(spark).items())[:25]) | {1000: "a b c d e f a b c d e f a b c d e f", 1001: "one two", 1002: ""}
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in order_minhash.compare_edited(docs).collect()}
    ids = sorted(some)
    share = lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else sum(x == y for x, y in zip(a, b)) / len(a)
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        t, n = some[i], len(some[i]) // 2
        edited = t[: len(t) - n] + some[after][:n]
        r = got[i]
        assert (r.n_chars, r.edited, r.edited_sha256) == (len(t), edited, hashlib.sha256(edited.encode()).hexdigest())
        assert list(r.sketch) == brute_sketch(t) and list(r.edited_sketch) == brute_sketch(edited)
        assert r.near_edited == pytest.approx(share(brute_sketch(t), brute_sketch(edited)))
        assert r.near_next == pytest.approx(share(brute_sketch(t), brute_sketch(some[after])))
    assert order_minhash.compare_edited(messy).count() == messy.count()


def edit_similarity(a, b):
    """1 - (edit distance of the word sequences) / words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def test_likeness_follows_edit_distance(spark):
    """Texts with edited words, and with blocks moved: MinHash takes moved blocks for near, Order MinHash does not."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(160)]
    rows, want, plain = [], [], []
    kmers = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    for i in range(160):
        text = base[:]
        if i % 2:
            size = int(rng.integers(16, 40))
            blocks = [text[k : k + size] for k in range(0, 160, size)]
            text = [w for k in rng.permutation(len(blocks)) for w in blocks[k]]
        for at in rng.choice(160, int(rng.integers(0, 12)), replace=False):
            text[at] = f"e{i}x{at}"
        rows.append((i, " ".join(base), " ".join(text)))
        want.append(edit_similarity(base, text))
        plain.append(len(kmers(base) & kmers(text)) / len(kmers(base) | kmers(text)))
    docs = spark.createDataFrame(rows, "i int, a string, b string")
    near = lambda **k: order_minhash.likeness(order_minhash.sketch(F.col("a"), **k), order_minhash.sketch(F.col("b"), **k))
    got = docs.orderBy("i").select(near(), near(orders=256)).collect()
    few, many = (np.corrcoef([r[k] for r in got], want)[0, 1] for k in (0, 1))
    exact = np.corrcoef(plain, want)[0, 1]  # MinHash's own limit with any number of hashes
    assert few > exact + 0.05 and many > exact + 0.1, (few, many, exact)


@pytest.mark.parametrize("words, least", [(8, 5), (12, 12), (20, 18), (60, 28)])
def test_entries_of_short_texts_differ(words, least):
    """The orders do not repeat a few pairs of neighbours: of n k-mers, n * (n - 1) / 2 pairs can meet."""
    counts = [len(set(brute_sketch(" ".join(f"{k}w{i}" for i in range(words))))) for k in range(30)]
    assert np.mean(counts) >= least


# --- quality ---


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = weak_labels.classify(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("keep", "quality").collect()
    right = sum(r.keep == (r.quality == 1) for r in rows) / len(rows)
    kept = sum(r.keep for r in rows if r.quality == 1) / sum(r.quality for r in rows)
    assert right > 0.97 and kept > 0.98


def brute_votes(text):
    """The nine labellers by plain string operations: 1 good, 2 bad, 0 none."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < 3:
        return [0] * 9
    data, n = text.encode(), len(words)
    letters = [b for b in data if b >= 128 or chr(b).isalpha()]
    solid = sum(len(w.encode()) for w in words)
    capitals = sum(65 <= b <= 90 for b in data) / len(letters) if letters else 0.0
    marks = sum(chr(b) in "*$%&#@^~=+<>{}[]\\_" for b in data) / n
    stutter = sum(a == b for a, b in zip(words, words[1:])) / n
    bare = sum(w in "|*$%&#@^~=+<>-_/\\.,;:!?" and len(w) == 1 for w in words) / n
    lettered = sum(b >= 128 or chr(b).isalnum() for b in data) / solid
    variety = sum(len(set(words[i : i + 500])) for i in range(0, n, 500)) / n if n >= 20 else 1.0
    bad = [capitals >= 0.5, text.count("!!") / n >= 0.3, marks >= 1, words.count("|") / n >= 0.15, bare >= 0.15, stutter >= 0.25, variety <= 0.25, lettered <= 0.65]
    plain = lettered >= 0.85 and capitals <= 0.2 and stutter <= 0.05 and bare <= 0.02 and marks <= 0.1
    odd = lettered <= 0.7 or capitals >= 0.4 or stutter >= 0.2 or bare >= 0.1
    return [2 * x for x in bad] + [1 if plain else 2 if odd else 0]


def brute_shape(word):
    kinds = "".join("A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else "0" if 48 <= b <= 57 else chr(b) for b in word.encode())
    return re.sub(r"(.)\1+", r"\1", kinds, flags=re.S)[:12]


def test_classifier_against_brute_force(spark):
    """EM document by document, and the scorer's scores from features made anew."""
    all_texts = texts(spark)
    votes = {i: brute_votes(t) for i, t in all_texts.items()}
    accuracy = [0.9] * 9
    for _ in range(60):
        good = {}
        for i, v in votes.items():
            odds = sum((1 if x == 1 else -1) * np.log(a / (1 - a)) for x, a in zip(v, accuracy) if x)
            good[i] = 1 / (1 + np.exp(-odds))
        for k in range(9):
            right = sum(good[i] if v[k] == 1 else 1 - good[i] for i, v in votes.items() if v[k])
            accuracy[k] = min(0.9999, max(0.51, (right + 1.8) / (sum(v[k] != 0 for v in votes.values()) + 2)))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = weak_labels.fit(docs)
    assert list(found.accuracy.values()) == pytest.approx(accuracy, abs=1e-6)
    for r in weak_labels.score(docs, found).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", all_texts[r.doc_id])
        bag = Counter()
        for w in words:
            bag[zlib.crc32(b"s" + brute_shape(w).encode()) % 32768] += 1
            bag[zlib.crc32(b"e" + w.encode()[-2:]) % 32768] += 1
        bag[zlib.crc32(b"repeat") % 32768] += sum(a == b for a, b in zip(words, words[1:]))
        z = found.bias + (sum(float(found.weights[k]) * (x / len(words)) ** 0.5 for k, x in bag.items()) if words else 0)
        assert r.weak_posterior == pytest.approx(good[r.doc_id], abs=1e-6)
        assert r.quality_score == pytest.approx(1 / (1 + np.exp(-min(30, max(-30, z)))), abs=1e-4)


@pytest.mark.parametrize("total", [0, 10, 20_001, 10**10, 10**14, 10**17])
def test_a_sample_of_any_corpus(total):
    """The sample never becomes empty, and stays near its bound, whatever the corpus has."""
    limit = weak_labels.sample_limit(total, weak_labels.TRAIN_ROWS)
    assert 0 < limit <= 1 << weak_labels.SAMPLE_BITS
    assert total * limit / (1 << weak_labels.SAMPLE_BITS) == pytest.approx(min(total, weak_labels.TRAIN_ROWS), rel=0.2)


def test_long_texts_train_within_the_bound(spark):
    """Features beyond the byte bound lower the sample's threshold; a model still comes out."""
    rng = np.random.default_rng(2)
    good = [(i, " ".join(f"{''.join(chr(97 + c) for c in rng.integers(0, 26, 6))}" for _ in range(200))) for i in range(60)]
    bad = [(100 + i, "BUY!! NOW!! " * 40 + f"X{i}!!") for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    found = weak_labels.fit(docs, train_bytes=20_000)
    rows = {r.doc_id: r.quality_score for r in weak_labels.score(docs, found).collect()}
    assert np.count_nonzero(found.weights) and all(rows[i] > 0.5 for i, _ in good) and all(rows[i] < 0.5 for i, _ in bad)


def test_em_finds_the_bad_labeller():
    base = {}
    for good, vote in ((True, 1), (False, 2)):
        for caps in (0, 2):
            code = 0
            for name in weak_labels.LABELLERS:
                code = code * 3 + {"prose": vote, "symbols": 0 if good else 2, "bare": 0 if good else 2, "capitals": caps}.get(name, 0)
            base[code] = 100
    posterior, accuracy = weak_labels.posteriors(base)
    assert accuracy["capitals"] < 0.7 < 0.95 < accuracy["symbols"]
    assert sorted(round(p) for p in posterior.values()) == [0, 0, 1, 1]


# --- substring dedup ---


def test_passages_are_removed_once(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    own = lambda k: " ".join(f"d{k}w{i}" for i in range(80))
    docs = [(3, f"{own(3)} {passage} {own(33)}"), (1, f"{own(1)}\n{passage}\n{own(11)}"), (2, own(2)), (None, f"{own(9)} {passage}"), (5, None), (6, "")]
    rows = {r.doc_id: r for r in passages.remove_repeats(spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars long")).collect()}
    assert rows[1].text == docs[1][1] and rows[2].text == docs[2][1] and rows[5].text is None and rows[6].text == ""
    for i in (3, None):
        left = rows[i].text.split()
        gone = [w for w in passage.split() if w not in left]
        assert len(gone) >= 45 and rows[i].n_chars == len(rows[i].text)
        assert [w for w in dict(docs)[i].split() if w.startswith("d")] == [w for w in left if w.startswith("d")]
        a, b = rows[i].removed[0].start, rows[i].removed[0].end
        assert dict(docs)[i][:a] + dict(docs)[i][b:] == rows[i].text


def test_passages_against_brute_force(spark):
    all_texts = texts(spark)
    first = {}
    for i in sorted(all_texts):
        for digest in passages.units(all_texts[i])[2]:
            first.setdefault(digest, i)
    want = {i: passages.repeats(t, {d for d in passages.units(t)[2] if first[d] < i}) for i, t in all_texts.items()}
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in passages.remove_repeats(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert got == want


# --- media ---


def test_media_round_trip(messy):
    rows = media.interleave(messy).where("kind = 'media'").collect()
    assert len(rows) == messy.count()
    by_text = {}
    want = {r.doc_id: (r.text or "").encode() for r in messy.where("doc_id IS NOT NULL").collect()}
    for r in rows:
        if r.doc_id is None:
            continue
        data = want[r.doc_id]
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode_png(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))
        assert media.decode_png(stored) == payload and r.caption == f"{len(payload)} samples"
        by_text.setdefault(data, set()).add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_sequences_keep_order_and_captions():
    page = '<h1>Title</h1><p>one <b>two</b></p><figure><img src="m1" alt="x"><figcaption>cap &amp; tion</figcaption></figure><p>three</p><script>no</script><img src="m2">'
    assert media.parse_sequence(page) == [("text", "Title", None), ("text", "one two", None), ("media", "m1", "cap & tion"), ("text", "three", None), ("media", "m2", None)]
    broken = bytearray(media.encode_png(bytes(64)))
    broken[40] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))


# --- simhash ---


def brute_components(rows, near):
    root = {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in rows:
        for b in rows:
            if a[0] < b[0] and near(a, b):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    return {i: find(i) for i, *_ in rows}


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_simhash_links_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40).tolist()
    prints = []
    for i in range(400):
        fp = base[i % 40] if i % 3 else base[0]
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            fp ^= 1 << int(b)
        prints.append((i, signed(fp % (1 << 64))))
    rule = simhash.NearDup(max_bits=4)
    classes = spark.createDataFrame(prints, "rep long, fp long").dropDuplicates(["fp"])
    kept = [(r.rep, r.fp) for r in classes.collect()]
    keyed = simhash._blocked(classes, rule, block)
    links = keyed.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(simhash._linker(rule), simhash.LINKS)
    from linkloom.llm.components import components

    got = {i: i for i, _ in kept} | {r.node: r.root for r in components(links).collect()}
    assert got == brute_components(kept, lambda a, b: ((a[1] ^ b[1]) & ((1 << 64) - 1)).bit_count() <= 4)


def brute_print(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query_against_brute_force(spark):
    from linkloom.llm.queries import op9_simhash_near_dedup

    rows = [(i, brute_print(t)) for i, t in texts(spark).items()]
    want = brute_components(rows, lambda a, b: (a[1] ^ b[1]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash_near_dedup(spark, SMALL).collect()}
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in rows}


def test_links_are_verified(spark):
    words = [f"w{i}" for i in range(120)]
    vary = lambda *at: " ".join("changed" if i in at else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, vary()), (2, vary(60)), (3, vary(60, 100)), (4, vary(10, 30, 50, 70, 90)), (5, " ".join(reversed(words)))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_nearest_links_are_a_minimum_forest():
    rng = np.random.default_rng(3)
    a, b, w = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 9, 400)
    a, b, w = (x[a != b] for x in (a, b, w))
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0
    for k in np.argsort(w, kind="stable"):
        x, y = find(a[k]), find(b[k])
        if x != y:
            root[x] = y
            total += w[k]
    kept = simhash.nearest(a, b, w)
    assert w[kept].sum() == total and len(kept) == 60 - len({find(i) for i in set(a.tolist()) | set(b.tolist())}) - (60 - len(set(a.tolist()) | set(b.tolist())))


def test_keep_one_of_each_group(messy):
    kept = near_copies.keep_one(messy).collect()
    assert sorted(kept[0].asDict()) == sorted(messy.columns)
    assert sum(r.doc_id == 4 for r in kept) == 1 and sum(r.doc_id == 5 for r in kept) == 0


# --- packing ---


def test_packing_round_trip(spark, messy):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    for docs in (messy, spark.read.parquet(f"{SMALL}/documents.parquet")):
        want = Counter((r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids) + (0,)) for r in docs.collect())
        pieces = sorted(packing.pack(docs).collect(), key=lambda r: (r.sequence_id, r.offset))
        at, open_, got = 0, [], Counter()
        for r in pieces:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert (r.sequence_id * 1024 + r.offset, len(ids), r.start) == (at, r.length, len(open_)) and r.offset + r.length <= 1024
            at += r.length
            open_ += ids
            if len(open_) == r.doc_tokens:
                got[r.doc_id, tuple(open_)] += 1
                open_ = []
        assert got == want and not open_


# --- all of them ---

WHOLE = {
    "scan": license_scan.scan, "mix": mixing.mix, "omh": order_minhash.compare_edited, "classify": weak_labels.classify, "passages": passages.remove_repeats,
    "near": simhash.near_duplicates, "mixed": mixing.mixed, "pack": packing.pack, "interleave": media.interleave, "keep_one": near_copies.keep_one,
}


@pytest.mark.parametrize("name", WHOLE)
def test_empty_tables(nothing, name):
    assert WHOLE[name](nothing).count() == 0


@pytest.mark.parametrize("name", ["scan", "mix", "classify", "passages", "near"])
def test_messy_rows_stay(messy, name):
    assert WHOLE[name](messy).count() == messy.count()


def test_mixed_rows(messy):
    assert Counter(r.doc_id for r in mixing.mixed(messy).collect()) == Counter({r.doc_id: 0 for r in []}) + sum((Counter({r.doc_id: r.copies}) for r in mixing.mix(messy).collect()), Counter())


