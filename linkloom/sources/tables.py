"""Tab-separated company tables, their normalised Parquet form, and truth tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import text
from linkloom.scratch import stored

COLUMNS = ("entity_id", "business_name", "business_address", "country")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # Quotes are ordinary characters and "NA" is text; the reader turns an empty field into null.
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", escape="", encoding="UTF-8", enforceSchema=True).na.fill("")


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """``src, entity_id, business_name, business_address, country`` of one table; ``src`` is the id's number."""
    rows = _read(spark, path, SCHEMA)
    return rows.select(F.regexp_extract("entity_id", r"^S(\d+)-", 1).cast("tinyint").alias("src"), *COLUMNS)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Only the ids of a source table, for checks and for outputs."""
    return read_source(spark, path).select("entity_id")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``s1_id, t_id``, one row per true pair; an empty list gives none."""
    return explode_lists(_read(spark, path, TRUTH))


def read_lists(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``source1_entity_id`` and the comma-joined list ``name`` of a result file."""
    return _read(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", name)]))


def explode_lists(lists: DataFrame) -> DataFrame:
    ids = F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","))
    return lists.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("t_id")).where("t_id <> ''").distinct()


def normalise(records: DataFrame, scripts: bool = True) -> DataFrame:
    """``src, entity_id, name_norm, addr_norm, country``."""
    return records.select(
        "src", "entity_id", text.norm_text(F.col("business_name"), scripts).alias("name_norm"), text.norm_text(F.col("business_address"), scripts).alias("addr_norm"),
        F.coalesce("country", F.lit("")).alias("country"),
    )


def known_truth(truth: DataFrame, records: DataFrame) -> DataFrame:
    """The true pairs whose records both exist."""
    ids = lambda which, name: records.where(which).select(F.col("entity_id").alias(name)).distinct()
    return truth.join(ids("src = 1", "s1_id"), "s1_id", "left_semi").join(ids("src > 1", "t_id"), "t_id", "left_semi").select("s1_id", "t_id")


def write_normalised(records: DataFrame, path: str, scripts: bool = True) -> int:
    """Write the normalised form as Parquet (zstd) unless it is there whole, and return its rows."""
    return stored(normalise(records, scripts), path).count()


def read_normalised(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The normalised form, only the columns asked for."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def write_metrics(row: DataFrame, path: str) -> None:
    """A one-row table as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
