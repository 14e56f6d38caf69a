"""Candidate pairs: document frequencies, rarest keys, postings, score and top-m."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from linkloom.config import LinkConfig
from linkloom.functions import ranking
from linkloom.scratch import in_partitions, kept_out, materialise, partitions_by, scope, scratch_path, shuffle_partitions, stored

#: Source-1 records of a part, at about: fewer parts need less postings sent, smaller ones less memory.
PART_RECORDS = 1 << 14
PROBES = "array<struct<key_id: long, df: long>>"
PAIRED = [("s1_ids", StringType()), ("t_ids", StringType()), ("places", LongType()), ("scores", DoubleType()), ("counts", LongType())]
RANKED = "part int, s1_id string, carried array<string>, t_ids array<string>, scores array<double>, counts array<long>"


def key_df(keys: DataFrame) -> DataFrame:
    """``key, df`` over the target records (sources 2 and 3)."""
    return keys.where("src > 1").groupBy("key").agg(F.count("*").alias("df"))


def idf(df, n_targets):
    return F.log(1 + n_targets / (df + 1))


def rarest_keys(keys: DataFrame, frequency: DataFrame, cfg: LinkConfig, *more: str) -> DataFrame:
    """``s1_id, key, df`` (and columns ``more`` of ``frequency``): the ``k`` rarest admissible keys of each source-1 record, ties by key.

    Digit signatures (class D) never probe. Keys that no target has count among the k.
    """
    own = keys.where("src = 1 AND key_class <> 'D'").select(F.col("entity_id").alias("s1_id"), "key")
    met = own.join(kept_out(frequency), "key", "left").select("s1_id", "key", F.coalesce("df", F.lit(0)).cast("long").alias("df"), *more)
    order = Window.partitionBy("s1_id").orderBy("df", "key")
    chosen = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cfg.k)
    if cfg.soft_cap is not None:
        # Keys over the soft cap probe only for records whose rarest key is over it.
        chosen = chosen.withColumn("rarest", F.min("df").over(Window.partitionBy("s1_id"))).where((F.col("df") <= cfg.soft_cap) | (F.col("rarest") > cfg.soft_cap)).drop("rarest")
    chosen = chosen.drop("r")
    return chosen.where(F.col("df") <= cfg.hard_cap) if cfg.hard_cap is not None else chosen


def posting_join(chosen: DataFrame, keys: DataFrame) -> DataFrame:
    """``s1_id, t_id, key, df``: each chosen key meets the targets that have it.

    Only keys that some target has are sent to the join; frequent ones are split at run
    time, as any skewed join key.
    """
    postings = keys.where("src > 1 AND key_class <> 'D'").select("key", F.col("entity_id").alias("t_id"))
    return chosen.where("df > 0").join(kept_out(postings), "key").select("s1_id", "t_id", "key", "df")


def scored_pairs(joined: DataFrame, n_targets: int, cfg: LinkConfig) -> DataFrame:
    """``s1_id, t_id, key_score, key_count``: the summed IDF and number of shared chosen keys."""
    pairs = joined.groupBy("s1_id", "t_id").agg(F.round(F.sum(idf(F.col("df"), F.lit(n_targets))), 6).alias("key_score"), F.count("*").alias("key_count"))
    return pairs.where(F.col("key_count") >= cfg.min_shared)


def probes(keys: DataFrame, cfg: LinkConfig, carried: DataFrame | None = None, s1: DataFrame | None = None) -> DataFrame:
    """``part, s1_id, probes, carried``, written: each record's chosen keys that some target has, rarest first.

    Records that share their most frequent chosen key stand in one part, or in a few, and
    parts hold ``PART_RECORDS`` records at about, so that a key's targets go to few parts.
    Each part has a partition of its own: more of them than Spark's shuffle partitions, if
    there are more parts. A task then holds one part however many there are, and sorts it in
    memory.
    ``carried`` (``s1_id, carried``: a list of strings) goes along with its records. ``s1``:
    ids of all records, if those without keys are wanted too.
    """
    path = scratch_path(keys.sparkSession, "probes")
    with scope(keys.sparkSession):
        return stored(_probes(keys, cfg, carried, s1), path, "snappy")


def _probes(keys: DataFrame, cfg: LinkConfig, carried: DataFrame | None, s1: DataFrame | None) -> DataFrame:
    spark = keys.sparkSession
    frequency = materialise(key_df(keys).withColumn("key_id", F.monotonically_increasing_id()), "frequencies")
    chosen = rarest_keys(keys, frequency, cfg, "key_id")
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("df") > 0, F.struct("df", "key", "key_id")))), lambda x: F.struct(x["key_id"].alias("key_id"), x["df"].alias("df"), x["key"].alias("key")))
    rows = chosen.groupBy("s1_id").agg(own.alias("probes"), F.max(F.struct("df", "key")).getField("key").alias("heavy"))
    if s1 is not None:
        rows = s1.join(kept_out(rows), "s1_id", "left")
    rows = rows.withColumn("carried", F.lit(None).cast("array<string>")) if carried is None else rows.join(kept_out(carried), "s1_id", "left")
    rows = materialise(rows, "chosen")
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PART_RECORDS))
    n = max(shuffle_partitions(spark), parts)
    names = F.lit(part_names(spark, parts, n)).cast("array<int>")
    rows = rows.repartitionByRange(parts, "heavy", "s1_id").select(F.get(names, F.spark_partition_id()).alias("part"), "s1_id", "probes", "carried")
    return in_partitions(rows, "part", n)


def part_names(spark: SparkSession, parts: int, n: int | None = None) -> list[int]:
    """Numbers of ``parts`` parts that Spark's hash deals out evenly: none of ``n`` partitions (the shuffle's, if not given) gets two as long as another has none."""
    n = n or shuffle_partitions(spark)
    tried = spark.range(64 * n * -(-parts // n)).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)))
    taken, names = [0] * n, []
    for name, at in tried.collect():
        names.append((taken[at], at, name))
        taken[at] += 1
    return [name for _, _, name in sorted(names)[:parts]]


def beside_postings(probing: DataFrame, keys: DataFrame) -> DataFrame:
    """What ``ranking.probing`` takes: the records of each part of ``probing`` after the targets of their keys, each target once for a key and part.

    Records go by their most frequent keys, so that those that share them follow each other.
    """
    asked = probing.select("part", F.explode("probes").alias("k")).select("part", "k.key", "k.key_id").distinct()
    targets = keys.where("src > 1 AND key_class <> 'D'").select("key", F.col("entity_id").alias("t_id"))
    # Empty lists and not null ones: Spark asks for a batch's size at each row that it sends to Python, and each time goes over all null lists at its end again.
    met = asked.join(kept_out(targets), "key").select("part", "key_id", "t_id", F.lit(None).cast("string").alias("s1_id"), F.array().cast(PROBES).alias("probes"), F.array().cast("array<string>").alias("carried"))
    bare = F.transform("probes", lambda x: F.struct(x["key_id"].alias("key_id"), x["df"].alias("df"))).cast(PROBES)
    own = probing.select("part", F.lit(None).cast("long").alias("key_id"), F.lit(None).cast("string").alias("t_id"), "s1_id", bare.alias("probes"), "carried")
    return met.unionByName(own).repartition(partitions_by(probing, "part"), "part").sortWithinPartitions("part", F.col("s1_id").isNotNull(), F.reverse("probes"))


def record_pairs(probing: DataFrame, keys: DataFrame, n_targets: int, cfg: LinkConfig, m: int | None) -> DataFrame:
    """``part, s1_id, carried, t_ids, scores, counts``: the pairs of each record of ``probing`` in lists, all or the ``m`` best in order.

    Pairs are never shuffled: a part's records and the targets of their keys come together,
    and the pairs are counted in memory.
    """
    cap, least = cfg.posting_cap, cfg.min_shared
    made = beside_postings(probing, keys).mapInArrow(lambda batches: ranking.ranked(batches, n_targets, m, cap, least), RANKED)
    return in_partitions(made, "part", partitions_by(probing, "part"))


def unfolded(lists: DataFrame) -> DataFrame:
    """``s1_id, t_id, key_score, key_count``, a row per pair of ``record_pairs``.

    Scores and counts are taken from their lists by place; zipped lists would make an object of each pair first.
    """
    at = lists.select("s1_id", "scores", "counts", F.posexplode("t_ids").alias("at", "t_id"))
    return at.select("s1_id", "t_id", F.get("scores", "at").alias("key_score"), F.get("counts", "at").alias("key_count"))


def all_pairs(keys: DataFrame, cfg: LinkConfig, n_targets: int, counted: bool = True) -> DataFrame:
    """What ``scored_pairs`` gives for all records, without a shuffle of the pairs; without ``key_count`` if that is not wanted.

    The pairs of some records come together, with each id once, so that numbers alone are copied before they are unfolded.
    """
    least, schema = cfg.min_shared, StructType([StructField(name, ArrayType(kind, False), False) for name, kind in PAIRED[: 4 + counted]])
    made = beside_postings(probes(keys, cfg), keys).mapInArrow(lambda batches: ranking.paired(batches, n_targets, least, counted), schema)
    at = made.select("*", F.posexplode("places").alias("at", "place"))
    low = F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    counts = [F.get("counts", "at").alias("key_count")] if counted else []
    return at.select(F.get("s1_ids", F.shiftright("place", 32).cast("int")).alias("s1_id"), F.get("t_ids", low).alias("t_id"), F.get("scores", "at").alias("key_score"), *counts)


def candidate_lists(keys: DataFrame, cfg: LinkConfig, n_targets: int, carried: DataFrame | None = None, s1: DataFrame | None = None) -> DataFrame:
    """The ``top_m`` pairs of each record that has keys (or is in ``s1``) in lists: score, then shared keys, then the target's id."""
    return record_pairs(probes(keys, cfg, carried, s1), keys, n_targets, cfg, cfg.top_m)


def candidates(keys: DataFrame, cfg: LinkConfig, n_targets: int) -> DataFrame:
    """The ``top_m`` pairs of each record."""
    return unfolded(candidate_lists(keys, cfg, n_targets))
