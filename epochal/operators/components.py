"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, saved


def _least(e: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Each vertex's neighbours (all, or for a small star the smaller ones), and its least neighbour as a written table."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Written, so that the join meets two plain exchanges and a hub's rows can be split.
    return both, saved(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")


def _star(both: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """Hangs each vertex's larger (or, small star: smaller) neighbours on its least neighbour."""
    out = both.join(least, "a")
    hung = out.filter(F.col("b") > F.col("a")).select("b", "m") if large else out.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
    return hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether every vertex hangs on one root at most, and no root hangs itself."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """``(v, root)`` for every vertex of ``links (a, b)``: the least vertex reachable.

    Each round is a written table; the tables of the round before are deleted.
    Rounds grow with the square of the logarithm of the vertices at most. The
    result reads the last table, which the caller may discard.
    """
    e = saved(links.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _is_forest_of_stars(e):
        before = [e]
        for large in (True, False):
            both, least = _least(e, large)
            e = saved(_star(both, least, large), name)
            before += [least, e]
        discard(*before[:-1])
    roots = e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    out = e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots)
    out._saved = e._saved
    return out
