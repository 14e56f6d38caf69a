"""WARC archives and URL rules."""

import hashlib
import re
import struct

import pytest
import zstandard

from linkloom.llm import url_rules, warc

SMALL = "/root/testdata/sf0.001"
PAGES = [
    (1, "http://a.com/en/1", "x" * 1500, "clash"), (2, "http://a.com/en/2", "x" * 1500, None), (9, "http://b.org/", "x" * 1500, "clash"), (3, None, "short", "c"), (4, "http://c.net/é x\r\n", "short", "c"),
    (5, "http://d.net", None, "c"), (6, "http://e.net", "", "c"), (None, "http://f.net", "x" * 1500, "c"), (9, "http://b.org/", "x" * 1500, "clash"), (-8, "http://g.net", "é" * 700, "c"), (8, "http://h.net", "é" * 700, "c"),
    (10, "http://i.net", "y " * 400_000, "c"), (11, "http://j.net", "a\r\n\r\nWARC/1.1\r\n", "c"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(3)


def test_archives_read_back(pages):
    rows = warc.archive_and_read(pages, archive_bytes=4000).collect()
    assert len(rows) == len(PAGES)
    best = {}
    for i, _, html, _ in PAGES:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            best[data] = max(best.get(data, i), i)
    left = [(i, (h or "").encode()) for i, _, h, _ in PAGES]
    for r in rows:
        data = next(d for i, d in left if i == r.page_id and hashlib.sha1(d).hexdigest() == r.payload_digest)
        left.remove((r.page_id, data))
        keeper = best.get(data)
        revisit = keeper is not None and (r.page_id is None or r.page_id < keeper)
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(data), "revisit" if revisit else "response", keeper if revisit else None)
        assert (bytes(r.payload) if r.payload is not None else None) == (None if revisit else data)
    assert not left and {r.url for r in rows if r.page_id == 3} == {None}


def squeezed(markup):
    """A page's text without markup and white space, by regular expressions."""
    import html

    bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>|<[^>]*>", "", markup)
    return re.sub(r"\s+", "", html.unescape(bare))


def test_real_pages_with_media(spark):
    """Media at random places of real pages: order, positions, captions and payloads, by construction."""
    import random
    import zlib

    from linkloom.llm import media

    rng = random.Random(3)
    store = [bytes(rng.randrange(256) for _ in range(64 * rng.randint(1, 30))) for _ in range(12)]
    digests = [hashlib.sha256(x).hexdigest() for x in store]
    rows, want = [], {}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        places = sorted(rng.sample(range(len(found := [m.start() for m in re.finditer("<p>", r.html)])), min(len(found), rng.randint(0, 5)))) if "<p>" in r.html else []
        page, done, items = "", 0, []
        for at in (found[k] for k in places):
            kind = rng.randrange(5)
            refs = [rng.randrange(len(store)) for _ in range(rng.randint(1, 3) if kind == 0 else 1)]
            caption = f"Caption {len(items)} & more <b>of</b> it"
            said = caption.replace("<b>", "").replace("</b>", "")
            images = "".join(f'<img src="media:sha256:{digests[k]}" alt="alt {k}">' for k in refs)
            snippet, told = {
                0: (f"<figure>{images}<figcaption>{caption}</figcaption></figure>", [(k, said) for k in refs]),
                1: (f"<figure><figcaption>{caption}</figcaption>{images}</figure>", [(k, said) for k in refs]),
                2: (images, [(k, f"alt {k}") for k in refs]),
                3: (f'<video src="media:sha256:{digests[refs[0]]}"></video>', [(refs[0], None)]),
                4: ('<img src="http://elsewhere/x.png" alt="far">', [(None, "far")]),
            }[kind]
            page += r.html[done:at] + snippet
            done = at
            items += [(k, told_caption, squeezed(r.html[:at])) for k, told_caption in told]
        rows.append((r.page_id, page + r.html[done:], "clash"))
        want[r.page_id] = (items, squeezed(r.html))
    pages = spark.createDataFrame(rows, "doc_id long, html string, digest string")
    stored = spark.createDataFrame([(d, bytearray(media.encode_png(x))) for d, x in zip(digests, store)] * 2, "digest string, media binary")
    got = {i: [] for i in want}
    for r in media.resolve(pages, stored).collect():
        got[r.doc_id].append(r)
    assert sum(len(x[0]) for x in want.values()) > 50
    for i, (items, text) in want.items():
        row = sorted(got[i], key=lambda r: r.position)
        assert [r.position for r in row] == list(range(len(row)))
        before, seen = "", []
        for r in row:
            if r.kind == "text":
                before += re.sub(r"\s+", "", r.value)
                assert r.payload_sha256 is None and r.caption is None
                continue
            seen.append((r, before))
        assert before == text and len(seen) == len(items)
        for (r, prefix), (k, caption, upto) in zip(seen, items):
            assert (r.caption, prefix) == (caption, upto)
            assert (r.payload_sha256, r.tail_crc32) == ((None, None) if k is None else (digests[k], zlib.crc32(store[k][-64:])))


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read(none).count() == 0
    assert url_rules.judge(none).count() == 0


def test_archive_format_and_broken_archives():
    records = [warc.make_record(i, f"http://x/{i}", b"payload %d " % i * 50, hashlib.sha1(b"payload %d " % i * 50).hexdigest(), "response", None) for i in range(40)]
    data = warc.make_archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert list(warc.frames(data)) == records
    for broken in (data[:-5], data[:6], data[: 8 + size // 2]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(broken))
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Lengthx: "), (b"payload", b"pbyload"), (b"\r\n\r\npay", b"\r\n\r\n\r\npay")):
        with pytest.raises(warc.WarcError):
            warc.parse_http(*warc.parse_record(records[3].replace(old, new, 1)))
    import base64

    digest = hashlib.sha1(b"payload 3 " * 50).hexdigest()
    for spelled in (base64.b32encode(bytes.fromhex(digest)).decode(), digest.upper()):
        assert warc.parse_http(*warc.parse_record(records[3].replace(digest.encode(), spelled.encode())))[1] == digest
    inner = records[3].index(b"Content-Length: ", records[3].index(b"HTTP/1.1")) + 16
    with pytest.raises(warc.WarcError):
        warc.parse_http(*warc.parse_record((records[3][:inner] + b"x" + records[3][inner + 1 :]).replace(b"WARC-Block-Digest", b"X-Block-Digest")))
    assert warc.page_of("<urn:uuid:12345678-1234-4234-8234-123456789abc>") is None and warc.page_of("http://elsewhere/1") is None
    for i in (None, 0, -5, 1 << 62):
        assert warc.page_of(warc.record_id(i)) == i


def brute_judgement(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in url_rules.RULES:
        name, tail = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, verdict))
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_urls_against_brute_force(spark):
    odd = [None, "", "no scheme.com/x", "http://", "http://EXAMPLE.com/en/?a=1", "https://x.example.com#f", "http://www.example.com/en/a", "http://com/", "http://notcom/", "ftp://a.net/fr/b?c", "http://a.net/FR/", "x://y://z.com/"]
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()
    rows = [(r.page_id, r.url) for r in pages] + [(1000 + i, u) for i, u in enumerate(odd)]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, verdict string")).collect()}
    for i, url in rows:
        host, path, rule, verdict = brute_judgement(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict in ("allow", "block") and verdict in (None, got[i].verdict)


def test_method_verdicts_against_sql(spark):
    """All judgements, mined ones included, against counting every combination."""
    import duckdb

    from linkloom.llm.queries import op8_sql

    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()]
    deep = [(2000 + i, f"http://a.b.c.d{i % 3}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'fr')[i % 2]}/x/y z/w/{i}.html?k1=1&k2=2&k{i % 4}=3") for i in range(60)]
    rows = pages + deep + [(1000, None), (1001, "http://a.com"), (1002, "no scheme?k1=2"), (1003, "http://a.com/"), (1004, "x://"), (1005, "http://h/" + "p/" * 3000 + "q.html")]
    table = duckdb.connect()
    table.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    table.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    found = table.sql(op8_sql())
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).select(*found.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(found.fetchall(), key=repr)
    assert any(r.mined_rule for r in got)


def test_tokens_that_always_meet_are_one_item(spark):
    """Thirty tokens that all rows share would make 2 ** 30 combinations."""
    shared = [f"dir{i}=p" for i in range(30)]
    judged = spark.createDataFrame([([*shared, "top=com"], "block")] * 20 + [([*shared, "top=net"], "allow")] * 20, "tokens array<string>, verdict string")
    rules = {(tuple(r["items"]), r.verdict) for r in url_rules.mine(judged).collect()}
    assert {(("top=com",), "block"), (("top=net",), "allow"), (tuple(sorted([*shared, "top=com"])), "block")} <= rules and len(rules) == 4


def test_mined_rules_against_counting(spark):
    judged = [(["top=com", "dir1=en"], "block")] * 30 + [(["top=com", "dir1=de"], "allow")] * 50 + [(["top=net", "dir1=en"], "block")] * 9 + [(["top=net", "dir1=en"], "allow")]
    rules = {tuple(r["items"]): (r.verdict, r.confidence) for r in url_rules.mine(spark.createDataFrame(judged, "tokens array<string>, verdict string"), 0.05, 0.8).collect()}
    want = {}
    for items in (("top=com",), ("top=net",), ("dir1=en",), ("dir1=de",), ("dir1=en", "top=com"), ("dir1=de", "top=com"), ("dir1=en", "top=net")):
        has = [v for t, v in judged if set(items) <= set(t)]
        for verdict in ("allow", "block"):
            if has.count(verdict) >= 0.05 * len(judged) and has.count(verdict) / len(has) >= 0.8:
                want[items] = (verdict, pytest.approx(has.count(verdict) / len(has)))
    assert rules == want
    sets = spark.createDataFrame([(["dir1=en", "top=org"],), (["dir1=fr"],)], "tokens array<string>")
    found = url_rules.match(sets, spark.createDataFrame([("a", ["dir1=en"], "block", 0.9, 0.1), ("b", ["dir1=en", "top=org"], "allow", 0.9, 0.2)], "rule_id string, items array<string>, verdict string, confidence double, support double")).collect()
    assert [(r.rule_id, r.verdict) for r in found] == [("b", "allow")]
