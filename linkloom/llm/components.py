"""Connected components of a link table, by alternating stars.

Each round points every node at the smallest node among its neighbours (first its larger
neighbours, then its smaller ones) and writes the links to the shared folder, until they are
stars. The rounds grow with the logarithm of the longest chain; no neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import files, materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node points at one other, which points at none."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (``u > v``, longs) that is not its own root.

    ``root`` is the smallest node that links reach. No links give no rows.
    """
    links = materialise(links.distinct(), "links")
    while not _are_stars(links):
        # A round never adds links; few links need few files.
        links = materialise(_small_star(_large_star(links)).coalesce(files(links.count())), "stars")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
