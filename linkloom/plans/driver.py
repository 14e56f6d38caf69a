"""The linkage stage by stage, from tab-separated tables to match lists, with resume.

``python -m linkloom.plans.driver STAGE DATASET WORK OUTPUT`` runs one stage, or ``all``.
``DATASET`` holds ``train/train_source{1,2,3}.tsv``, ``train/train_ground_truth.tsv`` and
``test/test_source{1,2,3}.tsv``; ``WORK`` and ``OUTPUT`` are folders that all executors
share. A stage whose output is there whole is skipped, so a stopped run goes on where it was.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.config import LinkConfig
from linkloom.operators import labels, metrics, model, output, validate
from linkloom.plans import link
from linkloom.scratch import exists, stored
from linkloom.sources import tables

SPLITS = ("train", "test")


class Driver:
    """One method per stage; each reads what the stages before have written."""

    def __init__(self, spark: SparkSession, dataset: str, work: str, out: str, cfg: LinkConfig = LinkConfig()):
        self.spark, self.dataset, self.work, self.out, self.cfg = spark, dataset, work, out, cfg

    def records(self, split: str) -> DataFrame:
        """All three sources of a split."""
        each = [tables.read_source(self.spark, f"{self.dataset}/{split}/{split}_source{i}.tsv") for i in (1, 2, 3)]
        return each[0].unionByName(each[1]).unionByName(each[2])

    def truth(self) -> DataFrame:
        return tables.known_truth(tables.read_truth(self.spark, f"{self.dataset}/train/train_ground_truth.tsv"), self.prepared("train").records)

    def prepared(self, split: str) -> link.Prepared:
        return link.prepare(self.records(split), self.cfg, f"{self.work}/{split}")

    def pairs(self, split: str) -> DataFrame:
        return stored(link.candidates(self.prepared(split), self.cfg), f"{self.work}/{split}/candidates")

    def featured(self, split: str) -> DataFrame:
        return stored(link.featured(self.prepared(split), self.cfg, self.pairs(split)), f"{self.work}/{split}/features")

    def prep(self) -> None:
        """Normalised records, tokens and keys of both splits."""
        for split in SPLITS:
            self.prepared(split)

    def candidates(self) -> None:
        for split in SPLITS:
            self.pairs(split)

    def recall(self) -> None:
        """The recall of the training candidates as JSON, and the true pairs among them."""
        if exists(self.spark, f"{self.work}/recall/_SUCCESS"):
            return
        pairs, truth = self.pairs("train"), self.truth()
        stored(labels.positives(pairs, truth), f"{self.work}/positives")
        tables.write_metrics(metrics.candidate_recall(pairs, truth, link.source_ids(self.prepared("train").records)), f"{self.work}/recall")

    def features(self) -> None:
        for split in SPLITS:
            self.featured(split)

    def train(self) -> None:
        """The model and its threshold."""
        if exists(self.spark, f"{self.work}/model/threshold/_SUCCESS"):
            return
        fitted, threshold = link.train(self.prepared("train").records, self.truth(), self.cfg, pairs=self.featured("train"))
        model.save(fitted, f"{self.work}/model", threshold)

    def inference(self) -> None:
        """The candidate and match lists of the test records."""
        if all(exists(self.spark, f"{self.out}/{name}/_SUCCESS") for name in ("candidate_pairs", "matching_results")):
            return
        fitted, threshold = model.load(f"{self.work}/model"), model.load_threshold(f"{self.work}/model")
        listed, matched = link.infer(self.prepared("test").records, fitted, threshold, self.cfg, self.featured("test"))
        output.write_lists(listed, f"{self.out}/candidate_pairs")
        output.write_lists(matched, f"{self.out}/matching_results")

    def check(self) -> DataFrame:
        """The report on the written match lists."""
        records = self.prepared("test").records
        targets = records.where("src > 1").selectExpr("entity_id AS t_id")
        lists = tables.read_lists(self.spark, f"{self.out}/matching_results", "matched_entity_ids")
        listed = tables.read_lists(self.spark, f"{self.out}/candidate_pairs", "candidate_entity_ids")
        rows, candidates = validate.lists_of(lists, "matched_entity_ids"), validate.lists_of(listed, "candidate_entity_ids")
        return validate.report(rows, link.source_ids(records), targets, candidates)

    def stages(self) -> dict[str, Callable[[], object]]:
        """Keys are written with the records, so ``keys`` is ``prep``."""
        return {"prep": self.prep, "keys": self.prep, "candidates": self.candidates, "recall": self.recall, "features": self.features, "train": self.train, "inference": self.inference}

    def run(self, stage: str = "all") -> None:
        for name, step in self.stages().items():
            if stage in ("all", name):
                step()


def main(args: list[str]) -> int:
    if len(args) != 4:
        print(__doc__)
        return 2
    stage, dataset, work, out = args
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    driver = Driver(spark, dataset, work, out)
    if stage == "check":
        found = driver.check()
        found.orderBy("rule").show(truncate=False)
        return int(validate.verdict(found).first().verdict != "PASS")
    if stage != "all" and stage not in driver.stages():
        print(f"no stage {stage}; there are all, {', '.join(driver.stages())}, check")
        return 2
    driver.run(stage)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
