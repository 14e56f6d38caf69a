"""Blocking keys: each record becomes a set of prefixed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text


def prepare(normalised: DataFrame, split_states: bool = False, compat: bool = False) -> DataFrame:
    """Adds ``name_toks, addr_toks, digits, postal, keys``: what blocking and features need, once per record."""
    with_tokens = (
        normalised.withColumn("digits", text.digit_runs(F.col("addr_norm"))).withColumn("name_toks", text.name_tokens(F.col("name_norm"), compat))
        .withColumn("addr_toks", text.addr_tokens(F.col("addr_norm"), split_states, compat)).withColumn("postal", text.postal(F.col("digits")))
    )
    return with_tokens.withColumn("keys", record_keys(F.col("name_toks"), F.col("addr_toks"), F.col("digits"), F.col("country")))


def _neighbours(words: Column, tag: str) -> Column:
    """Keys of adjacent token pairs, either order alike."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.concat(F.lit(tag), F.least(x, y), F.lit("+"), F.greatest(x, y)))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(pairs)


def record_keys(name_toks: Column, addr_toks: Column, digits: Column, country: Column) -> Column:
    """The distinct keys of a record: n, a (tokens), B, C (token pairs), D (all digit runs), z (postal)."""
    label = text.country_label(country)
    prefix = F.when(label == "", F.lit("")).otherwise(F.concat(label, F.lit("|")))
    tagged = lambda words, tag: F.transform(words, lambda t: F.concat(F.lit(tag), t))
    none = F.array().cast("array<string>")
    bodies = F.concat(
        tagged(name_toks, "n"), tagged(addr_toks, "a"), _neighbours(name_toks, "B"), _neighbours(addr_toks, "C"),
        F.when(F.size(digits) > 0, F.array(F.concat(F.lit("D"), F.array_join(digits, "|")))).otherwise(none),
        tagged(F.filter(digits, lambda d: F.length(d).isin(5, 6)), "z"),
    )
    return F.array_distinct(F.transform(bodies, lambda b: F.concat(prefix, b)))


def blocking_keys(prepared: DataFrame) -> DataFrame:
    """``src, entity_id, key, key_class``, one row per record and key.

    ``explode_outer``: from a plain ``explode`` Spark infers a filter on the array, which
    repeats the whole expression behind it where the records are not written.
    """
    label = text.country_label(F.col("country"))
    at = F.when(label == "", 1).otherwise(F.length(label) + 2)
    long = prepared.select("src", "entity_id", at.alias("at"), F.explode_outer("keys").alias("key")).where("key IS NOT NULL")
    return long.select("src", "entity_id", "key", F.expr("substr(key, at, 1)").alias("key_class"))
