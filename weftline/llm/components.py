"""Connected components of a large graph, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on its least neighbour, itself included."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for each node of an edge whose ends differ.

    ``edges`` has columns a and b. Large and small stars alternate until nothing changes,
    about log2 of the longest chain times; each round is written to the shared folder.
    Nodes without edges don't appear; empty edges give an empty table.
    """
    now = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        after = staged(_small_star(_large_star(now)), "stars")
        mark = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        unstage(now)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
