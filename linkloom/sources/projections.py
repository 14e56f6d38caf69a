"""Company records and truth derived from the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States by nation, in turn.
STATE_NAMES = ("Ohio", "Texas", "California", "New York", "Maharashtra", "Tamil Nadu", "West Virginia", "Delaware", "Kerala", "Utah")

# Latin letters and the Cyrillic letters that stand in for them.
CYRILLIC = {"a": "а", "b": "б", "d": "д", "e": "е", "g": "г", "i": "и", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "r": "р", "s": "с", "t": "т", "u": "у"}
# How these letters are named in Unicode, in the same order.
CYRILLIC_NAMES = ("a", "be", "de", "ie", "ghe", "i", "ka", "el", "em", "en", "o", "pe", "er", "es", "te", "u")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, entity_id, business_name, business_address, country, h``: name and address are a
    document's first two lines; source 1 keeps the lowest id of each normalised text."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    src = F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 3, 3).otherwise(2)
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))
    rows = table(spark, sf_dir, "documents").select(
        src.cast("int").alias("src"), "doc_id", F.get(lines, 0).alias("business_name"), F.coalesce(F.get(lines, 1), F.lit("")).alias("business_address"),
        F.col("lang").alias("country"), F.md5(plain).alias("h"),
    )
    first = rows.where("src = 1").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    kept = rows.where("src = 1").join(first, ["h", "doc_id"], "left_semi").unionByName(rows.where("src > 1"))
    return kept.select("src", F.concat(F.lit("S"), "src", F.lit("-"), "doc_id").alias("entity_id"), "business_name", "business_address", "country", "h")


def document_truth(records: DataFrame) -> DataFrame:
    """``s1_id, t_id`` of records with one text."""
    s1 = records.where("src = 1").select(F.col("entity_id").alias("s1_id"), "h")
    return s1.join(records.where("src > 1").select(F.col("entity_id").alias("t_id"), "h"), "h").select("s1_id", "t_id")


def company_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, entity_id, business_name, business_address, country``: a company for each
    customer in source 1, and noisy copies, decoys and nothing at all in sources 2 and 3."""
    state = F.element_at(F.array(*map(F.lit, STATE_NAMES)), (F.col("c_nationkey") % len(STATE_NAMES) + 1).cast("int"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    base = (
        table(spark, sf_dir, "customer").join(part, F.col("c_custkey") == F.col("k"), "left").join(nation, "c_nationkey")
        .select(
            F.col("c_custkey").alias("c"), F.col("n_name").alias("country"),
            F.concat_ws(" ", F.coalesce("p_name", F.lit("plain works")), "c_mktsegment").alias("stem"),
            (F.col("c_custkey") % 900 + 1).cast("string").alias("number"), state.alias("state"), (F.col("c_custkey") + 10000).cast("string").alias("zip"),
        )
    )
    c, text = F.col("c"), F.concat_ws
    words = F.array_join(F.reverse(F.split(text(" ", "stem", F.lit("Corporation")), " ")), " ")
    copy = lambda src, name, address: F.struct(F.lit(src).alias("src"), name.alias("business_name"), address.alias("business_address"))
    street = text(" ", "number", F.lit("Main Street,"), "state")
    copies = F.array_compact(F.array(
        copy(1, text(" ", "stem", F.lit("Corporation")), text(", ", street, "zip")),
        F.when(c % 10 < 7, copy(2, F.upper(text(" ", "stem", F.lit("Corp."))), F.upper(text(", ", text(" ", "number", F.lit("Main St,"), "state"), "zip")))),
        F.when(c % 10 < 4, copy(3, words, street)),
        F.when(c % 10 == 9, copy(3, text(" ", "stem", F.lit("Corporation")), text(" ", ((c * 7) % 900 + 1).cast("string"), F.lit("Station Road")))),
    ))
    rows = base.select("c", "country", F.explode(copies).alias("r"))
    return rows.select(F.col("r.src").alias("src"), F.concat(F.lit("S"), "r.src", F.lit("-"), "c").alias("entity_id"), "r.business_name", "r.business_address", "country")


def company_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s1_id, t_id`` of the copies (decoys are none)."""
    c = F.col("c_custkey")
    targets = F.explode(F.array_compact(F.array(F.when(c % 10 < 7, F.concat(F.lit("S2-"), c)), F.when(c % 10 < 4, F.concat(F.lit("S3-"), c)))))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("S1-"), c).alias("s1_id"), targets.alias("t_id"))
