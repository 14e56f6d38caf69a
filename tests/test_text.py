"""Normalisation and similarity functions against hand-made and brute-force values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import lexicon, similarity, text

WORDS = st.text(alphabet="abc d", max_size=12)


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, want", [("A & B-c", "a b c"), ("", ""), (None, ""), ("Café  Ünïque", "cafe unique"), ("Straße Øst", "strasse ost"), ("!!", "")])
def test_norm_text(spark, raw, want):
    assert one(spark, raw, text.norm_text) == want


def test_scripts(spark):
    assert one(spark, "क ख Ltd", lambda c: text.norm_text(c, True)) == "ka kha ltd"
    assert text.plain_text("कि") == "ki" and text.plain_text("क्") == "k" and text.plain_text("१२") == "12"


@pytest.mark.parametrize(
    "function, raw, want",
    [
        (text.name_tokens, "The ACME Corporation Pvt. Limited", ["acme", "corp", "pvt", "ltd"]),
        (text.name_tokens, "New York Bagels & Company", ["ny", "bagels", "co"]),
        (text.addr_tokens, "12 Main Street, Ohio", ["12", "main", "st", "oh"]),
        (text.addr_tokens, "P O Box 7", ["pobox", "7"]),
        (text.addr_tokens, "Grand Estate", ["grand", "estate"]),
        (text.addr_tokens, "New York New York", ["ny", "ny"]),
        (text.numeric_tokens, "Flat 12b, 400001", ["12", "400001"]),
        (text.addr_tokens, "", []),
    ],
)
def test_tokens(spark, function, raw, want):
    assert one(spark, raw, lambda c: function(text.norm_text(c))) == want


def test_digits(spark):
    row = spark.createDataFrame([("Flat 12b, 400001, 12",), ("none",)], "x string").select(text.norm_text(F.col("x")).alias("n")).select(
        text.digit_signature(F.col("n")), text.digit_concat(F.col("n")), text.postal(text.digit_runs(F.col("n")))
    ).collect()
    assert [tuple(r) for r in row] == [("12|400001", "1240000112", 400001), ("", "", 0)]


def test_country_code(spark):
    import zlib

    assert one(spark, "France", text.country_code) == zlib.crc32(b"France") % 250 + 1 and one(spark, "", text.country_code) == 0


def test_state_tables():
    assert lexicon.state_tokens()["ohio"] == "oh" and "new" not in lexicon.state_tokens()
    split = lexicon.state_tokens(True)
    assert (split["new"], split["of"], split["de"], split["la"]) == ("nh", "dc", "idf", "pdl")
    assert max(map(len, (lexicon.LEGAL_FORMS, lexicon.STREET_TYPES, lexicon.STATES, lexicon.PHRASES))) < 200 and "inc" in lexicon.generic_tokens()


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_string_scores(a, b):
    assert similarity.common_length(a, b) == brute_lcs(a, b)
    for f in similarity.KERNELS.values():
        assert 0 <= f(a, b) <= 1 + 1e-12 and f(a, b) == pytest.approx(f(b, a))
        assert f(a, a) == 1 or not a.split()
    short, long = sorted((a, b), key=len)
    if short:
        sides = [(short, long), (long, short)] if len(a) == len(b) else [(short, long)]
        windows = [(x, y[max(0, i) : i + len(x)]) for x, y in sides for i in range(1 - len(x), len(y))]
        assert similarity.partial_ratio(a, b) == pytest.approx(max((similarity.ratio(x, w) for x, w in windows if w), default=0.0))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdef", min_size=1, max_size=10), st.text(alphabet="abcdef", min_size=1, max_size=10))
def test_jaro_winkler_against_duckdb(a, b):
    import duckdb

    assert similarity.jaro_winkler(a, b) == pytest.approx(duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=30))
def test_batches_score_like_single_pairs(pairs):
    long = [("x" * 300, "xy" * 200), ("", "é a"), ("a" * 70, "ba" * 40), ("nul \0", "nul")]
    a, b = map(list, zip(*pairs, *long))
    got = similarity.all_scores(a, b)
    for name, kernel in similarity.KERNELS.items():
        assert got[name].tolist() == pytest.approx([kernel(x, y) for x, y in zip(a, b)])


def test_compatible_phrases(spark):
    rows = spark.createDataFrame([("grand estate",), ("a new york grand est",), ("north",)], "norm string")
    merged = lambda compat: [r[0] for r in rows.select(text.merge_phrases(text.tokens(F.col("norm")), compat)).collect()]
    assert merged(True) == [["ges", "ate"], ["a", "ny", "ges"], ["north"]]
    assert merged(False) == [["grand", "estate"], ["a", "ny", "ges"], ["north"]]


def test_known_scores():
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.ratio("this is a test", "this is a test!") == pytest.approx(28 / 29)
    assert similarity.partial_ratio("this is a test", "this is a test!") == 1
    assert similarity.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 1
    assert similarity.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1


def test_bigrams(spark):
    rows = spark.createDataFrame([("aaab", "aab"), ("a", "ab"), ("", "")], "a string, b string")
    got = [r[0] for r in rows.select(similarity.bigram_overlap(similarity.bigrams(F.col("a")), similarity.bigrams(F.col("b")))).collect()]
    assert got == [pytest.approx(2 / 6**0.5), 0.0, 0.0]
