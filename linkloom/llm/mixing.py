"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash of 60 bits that follows from its id and the seed. A source's
token budget becomes thresholds on that hash: a document is taken once for each
threshold above its hash. Thresholds come from histograms: sizes are summed by source
and leading hash bits, the bucket in which the running total crosses the budget is found,
and only that bucket is summed again by the next bits, until it holds a single hash.
Nothing is sorted by hash and no document is read more than once as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import HELPER, bounded, materialise

#: Hash bits of a level's histogram: at most 4096 buckets a source and budget.
LEVEL_BITS = 12
HASH_BITS = 60
WEIGHTS = (5, 2, 1)
#: All targets together, and each at most, as multiples of the sizes.
SHARE, MOST = 1.5, 2


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """The first 60 bits of the MD5 of ``seed:key``; a null key hashes as ``seed:``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")


#: Sources that one task orders; more of them are dealt out by ranges.
RANGE_ROWS = 1 << 17


def before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over all rows that come before in ``order``.

    Rows are dealt out by ranges and summed in each; the ranges' totals (one row a range)
    are summed in turn, so no task holds all rows.
    """
    part, ranges = f"{HELPER}part", 1 + rows.count() // RANGE_ROWS
    ranged = materialise(rows.select("*", *(c.alias(n) for n, c in sums.items())).repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id()), "ranges")
    until = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(part).agg(*(F.sum(n).alias(n) for n in sums))
    bases = materialise(totals.select(part, *(F.coalesce(F.sum(n).over(until), F.lit(0)).alias(f"{HELPER}{n}") for n in sums)), "range-bases")
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.join(bounded(bases), part)
    return found.select(*rows.columns, *((F.col(f"{HELPER}{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(n) for n in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``, a written table.

    Targets share ``share`` times all sizes by weight; none is above ``most`` times its
    source's size, and the excess is shared again by weight. In order of size per weight
    the sources that stop are the first ones, so prefix sums give the final share. Sources
    are ordered by ranges, so there may be any number of them.
    """
    name = F.col("source").asc_nulls_last()
    place = before(sizes, [name], n=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")).cast("long")
    listed = materialise(place.withColumn("weight", weight).drop("n"), "weights")
    total = listed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    ratio = F.col("source_size") / F.col("weight")
    sums = before(listed, [ratio, name], size_before=F.col("source_size"), weight_before=F.col("weight"))
    level = (F.lit(share) * F.lit(total["size"] or 0) - most * F.col("size_before")) / (F.lit(total["weight"] or 0) - F.col("weight_before"))
    leveled = sums.withColumn("level", level)
    opened = leveled.where(F.col("level") * F.col("weight") < most * F.col("source_size"))
    # Of the sources that do not stop, the first in order has the final share: one row.
    final = opened.agg(F.min_by("level", F.struct(ratio, F.col("source").isNull(), "source")).alias("level")).first()["level"]
    capped = (F.lit(most) * F.col("source_size")).cast("double")
    shared = capped if final is None else F.lit(final) * F.col("weight")
    return listed.select("source", "source_size", "weight", F.least(shared, capped).alias("target"))


def thresholds(slim: DataFrame, budgets: DataFrame, most: int) -> DataFrame:
    """``source, copy, threshold``: a document is taken for ``copy`` if its hash is below ``threshold``.

    ``slim``: ``source, hash, size``; ``budgets``: ``source, copy, budget`` with budgets
    that a source's size bounds. The budgets of one source are nested, and so are their
    thresholds. The crossing hash is taken if that brings the total nearer to the budget.
    """
    full = F.lit(1 << HASH_BITS).cast("long")
    # prefix: the leading bits of the open bucket; left: what the budget has left before it.
    open_ = budgets.select("source", "copy", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"))
    done = None
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("hash", shift)
        if level:
            wanted = open_.select("source", "prefix").distinct()
            inside = slim.withColumn("prefix", F.shiftright("hash", shift + LEVEL_BITS)).join(
                wanted.withColumnRenamed("source", "s").withColumnRenamed("prefix", "p"), F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p")), "left_semi"
            )
        else:
            inside = slim.withColumn("prefix", F.lit(0).cast("long"))
        sums = inside.groupBy("source", "prefix", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        running = Window.partitionBy("source", "prefix").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("size").over(running)).select(F.col("source").alias("s"), F.col("prefix").alias("p"), "bucket", "size", "low", "high", "upto")
        # Of each budget, the first bucket whose running total is above it.
        crossed = (
            open_.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p")) & (F.col("upto") > F.col("left")), "left")
            .groupBy("source", "copy", "left", "prefix").agg(F.min(F.struct("bucket", "size", "low", "high", "upto")).alias("b"))
        )
        crossed = materialise(crossed, f"mix-level-{level}")
        gap = F.col("left") - (F.col("b.upto") - F.col("b.size"))
        single = F.col("b.low") == F.col("b.high")
        ended = crossed.where(F.col("b.bucket").isNull() | single).select(
            "source", "copy",
            F.when(F.col("b.bucket").isNull(), full).when(2 * gap >= F.col("b.size"), F.col("b.low") + 1).otherwise(F.col("b.low")).alias("threshold"),
        )
        done = ended if done is None else done.unionByName(ended)
        open_ = crossed.where(F.col("b.bucket").isNotNull() & ~single).select("source", "copy", gap.alias("left"), F.col("b.bucket").alias("prefix"))
        if open_.isEmpty():
            break
    return done


def mix_plan(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, source, size, hash`` of each document, and ``s, source_size, target, cuts`` of each source."""
    slim = materialise(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), unit_hash(F.col("doc_id").cast("long"), seed).alias("hash")), "sizes")
    sizes = materialise(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    aims = materialise(targets(sizes, weights, share, most), "targets")
    copy = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy")
    budgets = aims.select("source", "source_size", "target", copy).select(
        "source", "copy", F.least(F.greatest(F.col("target") - F.col("copy") * F.col("source_size"), F.lit(0.0)), F.col("source_size").cast("double")).alias("budget")
    )
    cuts = thresholds(slim.select("source", "hash", "size"), budgets, most).groupBy("source").agg(F.collect_list("threshold").alias("cuts"))
    plan = aims.withColumnRenamed("source", "s").join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("s", "source_size", "target", "cuts")
    return slim, materialise(plan, "mix-plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for each document.

    ``copies`` (0 to ``most``) says how often the mix takes the document and ``taken`` =
    ``copies * size``. A source's taken words differ from its target by half of its
    boundary document at most; a source without words takes none. A null or empty text has
    size 0, a very long one is counted whole and is never split;
    a null source is a source of its own, the last in the order. Rows with one ``doc_id``
    share a hash and are taken together; null ids are such a group as well. Other columns
    are ignored; an empty table gives no rows.
    """
    slim, plan = mix_plan(docs, weights, share, most, seed)
    copies = F.size(F.filter("cuts", lambda c: F.col("hash") < c))
    return slim.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with all their columns as they were.

    Only the plan of the sources is joined. Nulls, ties, repeats, empty and very long texts
    and an empty table as in ``mix``.
    """
    _, plan = mix_plan(docs, weights, share, most, seed)
    source, cuts, hashed, cut = (f"{HELPER}{x}" for x in ("source", "cuts", "hash", "cut"))
    plan = plan.select(F.col("s").alias(source), F.col("cuts").alias(cuts))
    met = docs.withColumn(hashed, unit_hash(F.col("doc_id").cast("long"), seed)).join(plan, F.col("source").eqNullSafe(F.col(source)))
    taken = F.filter(cuts, lambda c: F.col(hashed) < c)
    return met.select(*docs.columns, F.explode(taken).alias(cut)).drop(cut)
