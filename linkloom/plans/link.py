"""The whole linkage, from source tables to match lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import LinkConfig
from linkloom.operators import blocking, features, keys, labels, metrics, model, output
from linkloom.scratch import dealt, kept_out, materialise, scratch_path, stored
from linkloom.sources.tables import known_truth, normalise

GRID = tuple(i / 20 for i in range(1, 20))


@dataclass(frozen=True)
class Prepared:
    """``records`` is a written table; ``keys`` unfolds its key lists wherever they are read."""

    records: DataFrame
    keys: DataFrame
    n_targets: int


def prepare(records: DataFrame, cfg: LinkConfig, store: str | None = None) -> Prepared:
    """Normalised records with their tokens and keys, written once.

    Frequencies, probes, postings and features all read them. They are written below
    ``store`` (a folder that all executors share) unless they are there whole, else to the
    scratch folder. Tokens cost far more than moving names, so records that come in few
    files are dealt out first.
    """
    spark = records.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    rows = records.select("src", "entity_id", "business_name", "business_address", "country")
    if len(records.inputFiles()) < tasks:
        rows = rows.repartition(tasks, "entity_id")
    ready = keys.prepare(normalise(rows, cfg.scripts), cfg.split_states, cfg.compat)
    ready = stored(ready, f"{store or scratch_path(spark, 'records')}/records")
    return Prepared(ready, keys.blocking_keys(ready), ready.where("src > 1").count())


def candidates(p: Prepared, cfg: LinkConfig) -> DataFrame:
    return blocking.candidates(p.keys, cfg, p.n_targets)


def candidate_lists(p: Prepared, cfg: LinkConfig, truth: DataFrame | None = None) -> DataFrame:
    """The candidates of every source-1 record in lists (see ``blocking.candidate_lists``); ``carried``: its true targets, if ``truth`` is given."""
    carried = None if truth is None else truth.groupBy("s1_id").agg(F.collect_list("t_id").alias("carried"))
    return blocking.candidate_lists(p.keys, cfg, p.n_targets, carried, source_ids(p.records))


def featured(p: Prepared, cfg: LinkConfig, pairs: DataFrame | None = None) -> DataFrame:
    return features.pair_features(dealt(candidate_lists(p, cfg), "listed", "part") if pairs is None else pairs, p.records)


def source_ids(records: DataFrame) -> DataFrame:
    return records.where("src = 1").select(F.col("entity_id").alias("s1_id"))


def train(records: DataFrame, truth: DataFrame, cfg: LinkConfig, grid: tuple[float, ...] = GRID, pairs: DataFrame | None = None):
    """The fitted model and the threshold of the best macro F0.5 on the validation records.

    ``pairs``: featured candidates already written somewhere, if there are any. Only pairs
    of the training and validation records are featured and written otherwise. Truth on
    records that do not exist is left out.
    """
    truth = known_truth(truth, records)
    if pairs is None:
        p = prepare(records, cfg)
        some = candidates(p, cfg).where(labels.split_of(F.col("s1_id"), cfg) != "rest")
        pairs = featured(p, cfg, some)
    labelled = materialise(labels.label_pairs(pairs, truth, cfg).where("split <> 'rest'"), "labelled")
    return _fitted(labelled, truth, records, cfg, grid)


def train_lists(lists: DataFrame, p: Prepared, truth: DataFrame, cfg: LinkConfig, grid: tuple[float, ...] = GRID):
    """``train`` on candidates in lists that carry their record's true targets, written in buckets (``scratch.dealt``).

    Pairs are labelled where they are featured, without a shuffle, and only those of the
    training and validation records are featured and written.
    """
    some = features.pair_features(lists.where(labels.split_of(F.col("s1_id"), cfg) != "rest"), p.records, "hit")
    labelled = materialise(some.withColumnRenamed("hit", "label").withColumn("split", labels.split_of(F.col("s1_id"), cfg)), "labelled")
    return _fitted(labelled, known_truth(truth, p.records), p.records, cfg, grid)


def _fitted(labelled: DataFrame, truth: DataFrame, records: DataFrame, cfg: LinkConfig, grid: tuple[float, ...]):
    fitted = model.fit(labelled, rounds=cfg.rounds, least_gain=cfg.least_gain)
    val = source_ids(records).where(labels.split_of(F.col("s1_id"), cfg) == "val")
    scored = materialise(model.predict(fitted, labelled.where("split = 'val'")), "validated")
    best = metrics.best_threshold(metrics.threshold_sweep(scored, truth.join(val, "s1_id", "left_semi"), val, grid)).first()
    return fitted, best.threshold


def infer(records: DataFrame, fitted, threshold: float, cfg: LinkConfig, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The candidate lists and the match lists of all source-1 records; ``pairs``: featured candidates, if written already."""
    if pairs is None:
        pairs = materialise(featured(prepare(records, cfg), cfg), "featured")
    s1 = source_ids(records)
    found = output.matches(model.predict(fitted, pairs), threshold)
    return output.id_lists(s1, pairs, "candidate_entity_ids"), output.id_lists(s1, found, "matched_entity_ids")


def infer_lists(lists: DataFrame, p: Prepared, fitted, threshold: float) -> DataFrame:
    """``infer`` for candidates in lists of all source-1 records, written in buckets: both lists of each record in a row.

    Pairs are featured and scored where their lists lie, and neither written nor shuffled; only matches are.
    """
    found = output.matches(model.predict(fitted, features.pair_features(lists, p.records)), threshold)
    matched = output.id_lists(source_ids(p.records), found, "matched_entity_ids")
    # The candidate lists are many times as large as their files.
    return output.joined_lists(lists, "candidate_entity_ids").join(kept_out(matched), "source1_entity_id")
