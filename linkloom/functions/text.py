"""Text normalisation as Column expressions.

Everything runs inside the JVM but ``transliterate``, which is only needed for scripts
other than Latin.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import lexicon


def literals(items) -> Column:
    """An array literal of plain words, parsed at once."""
    return F.expr("array(" + ",".join(f"'{x}'" for x in items) + ")")


def literal_map(table: dict[str, str]) -> Column:
    return F.expr("map(" + ",".join(f"'{x}'" for pair in sorted(table.items()) for x in pair) + ")")


#: Latin letters that do not decompose, and their plain spelling.
UNDECOMPOSED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŧ": "t", "ŋ": "ng", "ĸ": "k", "ŀ": "l", "ŉ": "n"}


def latin_letters() -> tuple[str, str]:
    """Accented Latin letters (U+00C0 to U+017F) and their base letters, lower case, one to one."""
    marked, plain = [], []
    for code in range(0xC0, 0x180):
        base = unicodedata.normalize("NFKD", chr(code))
        letter = "".join(c for c in base if not unicodedata.combining(c)).lower()
        if len(letter) == 1 and "a" <= letter <= "z":
            marked.append(chr(code))
            plain.append(letter)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = latin_letters()
#: Anything that the Latin tables do not cover and that may be a letter or a digit.
OTHER_SCRIPTS = r"[^\x00-ſ -⁯₠-⃏←-⯿]"


def plain_text(text: str | None) -> str | None:
    """Any script as approximate Latin: decomposed letters, and letters named in Unicode by their sound.

    ``KA`` of an Indic script reads ``ka``; a vowel sign replaces its ``a``, a virama
    drops it. An approximation; no dictionary is used.
    """
    if text is None:
        return None
    out: list[str] = []
    for c in unicodedata.normalize("NFKD", text):
        if c < "\x80":
            out.append(c)
            continue
        if c in UNDECOMPOSED or c.lower() in UNDECOMPOSED:
            out.append(UNDECOMPOSED.get(c) or UNDECOMPOSED[c.lower()])
            continue
        name = unicodedata.name(c, "")
        if "VOWEL SIGN" in name:
            if out and out[-1].endswith("a") and len(out[-1]) > 1:
                out[-1] = out[-1][:-1]
            out.append(name.rsplit(" ", 1)[-1].lower())
        elif name.endswith("VIRAMA"):
            if out and out[-1].endswith("a") and len(out[-1]) > 1:
                out[-1] = out[-1][:-1]
        elif unicodedata.combining(c):
            if name.endswith(("ANUSVARA", "CANDRABINDU")):
                out.append("m")
        elif (number := unicodedata.digit(c, None)) is not None:
            out.append(str(number))
        elif " LETTER " in name:
            out.append(name.rsplit(" ", 1)[-1].lower())
        else:
            out.append(" ")
    return "".join(out)


@F.pandas_udf(T.StringType())
def transliterate(text: pd.Series) -> pd.Series:
    return text.map(plain_text)


def strip_accents(text: Column) -> Column:
    """Lower case with accents dropped, over the Latin letters."""
    plain = F.translate(F.lower(text), MARKED, PLAIN)
    for letter, spelling in UNDECOMPOSED.items():
        plain = F.replace(plain, F.lit(letter), F.lit(spelling))
    return plain


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def norm_text(text: Column, scripts: bool = False) -> Column:
    """Lower-case letters a-z and digits, single spaces between runs; null is empty.

    ``scripts`` also reads scripts other than Latin, by a vectorised function that only
    gets the texts that hold some.
    """
    raw = F.coalesce(text, F.lit(""))
    folded = F.when(is_ascii(raw), F.lower(raw)).otherwise(strip_accents(raw))
    if scripts:
        foreign = raw.rlike(OTHER_SCRIPTS)
        folded = F.when(foreign, F.lower(transliterate(F.when(foreign, raw)))).otherwise(folded)
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def merge_phrases(words: Column, compat: bool = False) -> Column:
    """Phrases of the table become one token each, on token boundaries, longest first.

    ``compat``: in the table's order and inside words too, where some token is the
    phrase's first word (``grand estate`` reads ``ges ate``).
    """
    if compat:
        merged = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        for phrase, code in lexicon.PHRASES.items():
            # Normalised text holds no control character: without the first word nothing is found.
            sought = F.when(F.array_contains(words, phrase.split()[0]), phrase).otherwise("\x01")
            merged = F.replace(merged, sought, F.lit(f" {code} "))
    else:
        merged = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
        for phrase, code in lexicon.ordered_phrases():
            merged = F.replace(merged, F.lit(f" {phrase.replace(' ', '  ')} "), F.lit(f" {code} "))
    return F.when(F.size(words) < 2, words).otherwise(F.filter(F.split(merged, " +"), lambda t: t != ""))


def mapped(words: Column, table: dict[str, str]) -> Column:
    """Each word's entry in ``table``, or the word."""
    lookup = literal_map({k: v for k, v in table.items() if k != v})
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(lookup, t), t))


def name_tokens(norm: Column, compat: bool = False) -> Column:
    """Tokens of a name: phrases merged, legal forms shortened, noise dropped; order and repeats stay."""
    noise = literals(lexicon.NAME_NOISE)
    return F.filter(mapped(merge_phrases(tokens(norm), compat), lexicon.LEGAL_FORMS), lambda t: ~F.array_contains(noise, t))


def addr_tokens(norm: Column, split_states: bool = False, compat: bool = False) -> Column:
    """Tokens of an address: phrases merged, street types and then states shortened."""
    streets = mapped(merge_phrases(tokens(norm), compat), lexicon.STREET_TYPES)
    return mapped(streets, lexicon.state_tokens(split_states))


def without_noise(words: Column) -> Column:
    """Address tokens without the words that say little."""
    noise = literals(lexicon.ADDRESS_NOISE)
    return F.filter(words, lambda t: ~F.array_contains(noise, t))


def without_generic(words: Column) -> Column:
    """Tokens without legal forms, street types and the noise of names and addresses."""
    generic = literals(lexicon.generic_tokens())
    return F.filter(words, lambda t: ~F.array_contains(generic, t))


def numeric_tokens(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(r"(\d+)"), F.lit(1))


def digit_concat(norm: Column) -> Column:
    return F.array_join(numeric_tokens(norm), "")


def digit_runs(norm: Column) -> Column:
    """Sorted distinct digit runs."""
    return F.array_sort(F.array_distinct(numeric_tokens(norm)))


def digit_signature(norm: Column) -> Column:
    return F.array_join(digit_runs(norm), "|")


def postal(runs: Column) -> Column:
    """The first sorted digit run of 5 or 6 digits as a number, else 0."""
    return F.coalesce(F.get(F.filter(runs, lambda d: F.length(d).isin(5, 6)), 0).cast("long"), F.lit(0).cast("long"))


def country_code(country: Column) -> Column:
    """0 for an empty label, else CRC-32 folded into 1 to 250."""
    label = F.coalesce(country, F.lit(""))
    return F.when(label == "", F.lit(0).cast("long")).otherwise(F.crc32(F.encode(label, "UTF-8")) % 250 + 1)


def country_label(country: Column) -> Column:
    return F.lower(F.trim(F.coalesce(country, F.lit(""))))
