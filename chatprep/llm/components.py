"""Connected components of a graph of links, by stars that grow and shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import written

#: Each round shortens the longest chain at least by a half.
MAX_ROUNDS = 64


def _large_stars(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest one that it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_least")).select("a", F.least("a", "_least").alias("_least"))
    larger = both.where("b > a")
    return larger.join(least, "a").select(F.col("_least").alias("a"), "b").where("a < b").distinct()


def _small_stars(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("_least"))
    moved = links.join(least, "b").select(F.col("_least").alias("a"), F.col("a").alias("b")).where("a < b")
    return moved.unionByName(least.select(F.col("_least").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node but the smallest of each.

    ``links`` has columns a < b, without nulls. Each round is written to the shared
    folder. A star's centre may have any number of links: they are counted and
    joined by Spark, never gathered.
    """
    links = written(links.where("a < b").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        stars = written(_small_stars(_large_stars(links)), "links")
        # Done when nothing moved: stars of stars are the same stars.
        if stars.exceptAll(links).isEmpty() and links.exceptAll(stars).isEmpty():
            return stars.select(F.col("b").alias("node"), F.col("a").alias("component"))
        links = stars
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
