"""Connected parts of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settled import settled


def parts(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root``, the least node it reaches, of every node that a link names.

    Each round points every node at the least root among its neighbours', then each root at the
    root it was pointed to, and follows pointers twice: the number of rounds grows with the
    logarithm of the longest path. Nothing but the number of changes reaches the driver.
    """
    ways = links.select(F.col(a).alias("node"), F.col(b).alias("near")).where("node is not null and near is not null")
    ways = settled(ways.unionAll(ways.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct())
    now = ways.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("root"))
    while True:
        now = settled(now)
        seen = ways.join(now.select(F.col("node").alias("near"), F.col("root").alias("there")), "near").groupBy("node").agg(F.min("there").alias("there"))
        lower = now.join(seen, "node").select("node", "root", F.least("root", "there").alias("to"))
        # A root goes where the lowest of its members goes, so whole parts move at once.
        moved = lower.groupBy("root").agg(F.min("to").alias("down"))
        hung = lower.join(moved, "root").select("node", F.col("root").alias("was"), F.least("to", "down").alias("root"))
        up = hung.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = settled(hung.join(up, "root", "left").select("node", "was", F.coalesce("above", "root").alias("root")))
        if after.where("root <> was").isEmpty():
            return after.select("node", "root")
        now = after.select("node", "root")
