import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, s string, cuts string, hash string, keep string, removed string, fp string, part string, n string"
LONG = " ".join(f"word{i % 4001} thing{i % 37}" for i in range(30_000))
TEXTS = [
    "", "one", "  ", "Two words", "the same sentence comes back again and again in this text", "the same sentence comes back again and again in this text",
    "tab\tand\nnew line\r\n and  spaces   here", "é ü ß 漢字 текст हिन्दी 🙂 end", "a <|endoftext|> b", LONG, "x" * 5000, "THE MIT LICENSE under the MIT license. CC-BY-NC 4.0",
    "Apache License, Version 2.0 and Apache License Version 2", "nul \x00 byte and \x0b vertical", " private mark ",
]


def rows():
    """Nulls in every column, ties, repeated rows, empty and very long texts; other columns' names clash."""
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t)) for i, t in enumerate(TEXTS)]
    out += [(100, None, None, None, None), (None, "no id here but some words", "en", "s1", 25), (None, None, None, None, None)]
    out += [(4, TEXTS[4], "en", "s1", len(TEXTS[4]))] * 2
    out += [(-7, "a negative id " * 3, "en", "Z", 42)]
    return [(*r, *("clash",) * 9) for r in out]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
