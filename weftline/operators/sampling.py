"""Draws by hash, ranks, lots and plans. The same seed draws the same rows at any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.bounds import upper
from ..functions.hashing import draw, seeded


def drawn(df: DataFrame, row_id: str, mode: str, seed: int, share: float) -> DataFrame:
    """Rows whose draw falls under ``share``."""
    return df.where(draw(seeded(seed, F.col(row_id), F.lit(mode))) < share)


def audit_sample(df: DataFrame, groups: Sequence[str], key: Column, share: float) -> DataFrame:
    """Of each group the first ceil(n x share) rows in hash order of ``key``, one at least.

    Ranks need a sort of each group; the count comes from a join, so that a hot group is
    split by adaptive execution rather than counted in the sorting task.
    """
    counts = df.groupBy(*groups).agg(F.count("*").alias("_n"))
    order = W.Window.partitionBy(*groups).orderBy(F.sha2(key.cast("binary"), 256), key)
    rows = df.withColumn("_rank", F.row_number().over(order)).join(counts, list(groups))
    return rows.where(F.col("_rank") <= F.greatest(F.ceil(F.col("_n") * share), F.lit(1))).drop("_rank", "_n")


def top_rows(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank``; Spark keeps only k rows a group and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def sample_size(n: Column, least: int, share: float) -> Column:
    return F.least(n, F.greatest(F.lit(least), F.ceil(n * share)))


def lots(df: DataFrame, groups: Sequence[str], row_id: str, seed: int, least: int, share: float, defect: Column, accept: float) -> DataFrame:
    """Acceptance sampling: each lot with its size, sample, defects in the sample, and verdict."""
    order = W.Window.partitionBy(*groups).orderBy(draw(seeded(seed, F.col(row_id), F.lit("lot"))), row_id)
    counts = df.groupBy(*groups).agg(F.count("*").alias("n"))
    rows = df.withColumn("_defect", defect).withColumn("_rank", F.row_number().over(order)).join(counts, list(groups))
    rows = rows.where(F.col("_rank") <= sample_size(F.col("n"), least, share))
    out = rows.groupBy(*groups, "n").agg(F.count("*").alias("sampled"), F.sum(F.col("_defect").cast("int")).alias("defects"))
    return out.withColumn("accepted", F.col("defects") <= accept * F.col("sampled"))


def plan(units: DataFrame, unit_id: str, priority: Column, reviewers: Sequence[str]) -> DataFrame:
    """``reviewer`` of each unit: units in order of priority go round the reviewers, there and back, so that loads differ by one at most."""
    k = len(reviewers)
    # A global order without one sorting task: ranks within buckets of priority, after the buckets' sizes.
    rows = units.withColumn("_p", priority.cast("double"))
    rows = rows.withColumn("_bucket", F.floor(F.col("_p")))
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.Window.orderBy(F.desc("_bucket")).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.col("_start") + F.row_number().over(W.Window.partitionBy("_bucket").orderBy(F.desc("_p"), unit_id)) - 1
    rows = rows.join(starts, "_bucket").withColumn("_place", place)
    turn = F.col("_place") % (2 * k)
    seat = F.when(turn < k, turn).otherwise(2 * k - 1 - turn)
    return rows.withColumn("reviewer", F.element_at(F.array(*map(F.lit, reviewers)), (seat + 1).cast("int"))).drop("_p", "_bucket", "_start", "_place")


def binomial_upper(k: int, n: float, confidence: float = 0.95) -> float:
    """Exact one-sided upper bound of a proportion: the p at which k or fewer of n are as rare as 1 - confidence. ``n`` may be an effective size."""
    return float(upper([k], [n], confidence)[0])
