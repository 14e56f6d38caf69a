"""Checks of match and candidate lists: each rule's offenders as a table, and one report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.scratch import bounded, exists, materialise

#: Offenders of a rule that the report names, and the groups that pick them.
EXAMPLES, GROUPS = 5, 64
HEADERS = {"matches": ("source1_entity_id", "matched_entity_ids"), "candidates": ("source1_entity_id", "candidate_entity_ids")}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` (from 1, in each file) and ``value``.

    Files are read by splits. A row's number inside its split comes from the reader's own
    order; the splits' row counts are summed in the order of their offsets (one row a split).
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = materialise(splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "splits")
    return rows.join(bounded(splits), ["file", "block"]).select((F.col("base") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def parsed(lines: DataFrame) -> DataFrame:
    """``line, s1_id, ids`` of the rows after the header; a row without a tab has null ``ids``."""
    cut = F.instr("value", "\t")
    rest = F.expr("substr(value, instr(value, '\t') + 1)")
    ids = F.when(cut == 0, None).when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    return lines.where("line > 1 AND trim(value) <> ''").select("line", F.when(cut == 0, F.col("value")).otherwise(F.expr("substr(value, 1, instr(value, '\t') - 1)")).alias("s1_id"), ids.alias("ids"))


def lists_of(table: DataFrame, name: str) -> DataFrame:
    """The same shape from a table of comma-joined lists (no lines)."""
    ids = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.split(name, ","))
    return table.select(F.col("source1_entity_id").alias("s1_id"), ids.alias("ids"))


def header_errors(lines: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """``rule, example`` if the first line is missing, has commas for tabs, or other names."""
    first = lines.where("line = 1").agg(F.max("value").alias("value"))
    names = F.transform(F.split(F.coalesce("value", F.lit("")), "\t"), lambda x: F.lower(F.trim(x)))
    rule = (
        F.when(F.coalesce("value", F.lit("")) == "", "empty file").when((F.instr("value", "\t") == 0) & (F.instr("value", ",") > 0), "comma separated")
        .when(names != F.array(*map(F.lit, expected)), "wrong header")
    )
    return first.select(rule.alias("rule"), F.col("value").alias("example")).where("rule IS NOT NULL")


def malformed(rows: DataFrame) -> DataFrame:
    return rows.where("ids IS NULL").select(F.col("line").cast("string").alias("offender")).distinct()


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return rows.where("ids IS NOT NULL").groupBy("s1_id").count().where("count > 1").select(F.col("s1_id").alias("offender"))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.col("s1_id").alias("offender")).distinct()


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("ids").alias("offender")).distinct()


def self_matches(rows: DataFrame) -> DataFrame:
    return _ids(rows).where(F.col("offender").startswith("S1-"))


def wrong_prefix(rows: DataFrame) -> DataFrame:
    return _ids(rows).where(~F.col("offender").rlike("^S[123]-"))


def unknown_ids(rows: DataFrame, valid: DataFrame) -> DataFrame:
    """Target ids that no target table has; ``valid``: ``t_id``."""
    targets = _ids(rows).where(F.col("offender").rlike("^S[23]-"))
    return targets.join(valid.select(F.col("t_id").alias("offender")), "offender", "left_anti")


def missing_records(rows: DataFrame, required: DataFrame) -> DataFrame:
    return required.select(F.col("s1_id").alias("offender")).distinct().join(rows.where("ids IS NOT NULL").select(F.col("s1_id").alias("offender")), "offender", "left_anti")


def extra_records(rows: DataFrame, required: DataFrame) -> DataFrame:
    return rows.where("ids IS NOT NULL").select(F.col("s1_id").alias("offender")).distinct().join(required.select(F.col("s1_id").alias("offender")), "offender", "left_anti")


def outside_candidates(matched: DataFrame, listed: DataFrame) -> DataFrame:
    """Matched pairs that are no candidates: ``s1_id, t_id``."""
    pairs = lambda rows: rows.select("s1_id", F.explode("ids").alias("t_id")).distinct()
    return pairs(matched).join(pairs(listed), ["s1_id", "t_id"], "left_anti")


def report(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """``rule, severity, n, examples``, a row per rule that finds something; the first five offenders are named."""
    found = [
        ("malformed row", malformed(rows)) if "line" in rows.columns else None,
        ("duplicate record", duplicate_rows(rows)), ("duplicate id in a list", duplicate_ids(rows)), ("self match", self_matches(rows)),
        ("wrong prefix", wrong_prefix(rows)), ("missing record", missing_records(rows, required)), ("extra record", extra_records(rows, required)),
        ("unknown id", unknown_ids(rows, valid)) if valid is not None else None,
        ("match outside candidates", outside_candidates(rows, candidates).select(F.concat_ws(" ", "s1_id", "t_id").alias("offender"))) if candidates is not None else None,
    ]
    whole = None
    for entry in found:
        if entry is None:
            continue
        rule, offenders = entry
        part = offenders.select(F.lit(rule).alias("rule"), F.lit("warning" if rule.startswith("match outside") else "error").alias("severity"), "offender")
        whole = part if whole is None else whole.unionByName(part)
    # Each group's first offenders, then the rule's: no task sorts all offenders of a rule.
    dealt = F.pmod(F.xxhash64("offender"), F.lit(GROUPS))
    first = lambda *by: Window.partitionBy("rule", *by).orderBy("offender")
    some = whole.withColumn("g", dealt).withColumn("r", F.row_number().over(first("g"))).where(F.col("r") <= EXAMPLES)
    some = some.withColumn("r", F.row_number().over(first())).where(F.col("r") <= EXAMPLES)
    examples = some.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("offender")), ", ").alias("examples"))
    return whole.groupBy("rule", "severity").agg(F.count("*").alias("n")).join(examples, "rule")


def verdict(found: DataFrame) -> DataFrame:
    """One row: PASS or FAIL and the number of rules with errors."""
    return found.agg(F.count_if(F.col("severity") == "error").alias("errors")).select(F.when(F.col("errors") == 0, "PASS").otherwise("FAIL").alias("verdict"), "errors")


def check_file(spark: SparkSession, path: str, kind: str, required: DataFrame, valid: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """The report of one file; a missing file or a wrong header ends it."""
    if not exists(spark, path):
        return spark.createDataFrame([("file not found", "error", 1, path)], "rule string, severity string, n long, examples string")
    lines = read_lines(spark, path)
    head = header_errors(lines, HEADERS[kind]).select("rule", F.lit("error").alias("severity"), F.lit(1).cast("long").alias("n"), F.col("example").alias("examples"))
    if not head.isEmpty():
        return head
    return report(parsed(lines), required, valid, candidates)
