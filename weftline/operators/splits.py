"""Dataset splits without leaks: rows that share a worker or a site, directly or through others, stay on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw, seeded
from .graph import parts
from .settled import settled


def assigned(groups: DataFrame, key: str, seed: int, shares: dict[str, float]) -> DataFrame:
    """``split`` of each row by a draw on its group key: a group is never divided, and new groups don't move old ones."""
    split, low = F.lit(None).cast("string"), 0.0
    d = draw(seeded(seed, F.col(key)))
    for name, share in shares.items():
        split = F.coalesce(split, F.when((d >= low) & (d < low + share), F.lit(name)))
        low += share
    return groups.withColumn("split", F.coalesce(split, F.lit(list(shares)[-1])))


def linked_groups(rows: DataFrame, worker: str, site: str) -> DataFrame:
    """``group`` of each (worker, site): the least worker reachable by shared sites and workers."""
    pairs = rows.select(worker, site).distinct()
    return pairs.join(worker_groups(rows, worker, site), worker).select(worker, site, "group")


def worker_groups(rows: DataFrame, worker: str, site: str) -> DataFrame:
    """``group`` of each worker of a site: the least worker reachable by shared sites and workers."""
    # A site stands for a star around its least worker: as many links as pairs at most, whatever the site's size. Rows needn't be distinct
    # for that: links are, and they are far fewer, so that no task holds the pairs.
    least = rows.groupBy(site).agg(F.min(worker).alias("_least"))
    links = rows.select(worker, site).join(least.hint("shuffle_hash"), site).select(worker, "_least").distinct()
    return parts(links, worker, "_least").select(F.col("node").alias(worker), F.col("root").alias("group"))


def held_apart(sessions: DataFrame, session: str, worker: str, site: str, golden: DataFrame) -> DataFrame:
    """``side`` of each session: ``golden``, ``holdout`` where it shares a worker or a site with a golden one, else ``pool``."""
    chosen = golden.select(F.col(session)).distinct().withColumn("_golden", F.lit(True))
    rows = sessions.join(chosen, session, "left")
    workers = rows.where("_golden").select(F.col(worker), F.lit(True).alias("_worker")).distinct()
    sites = rows.where("_golden").select(F.col(site), F.lit(True).alias("_site")).distinct()
    side = F.when(F.col("_golden"), "golden").when(F.col("_worker").isNotNull() | F.col("_site").isNotNull(), "holdout").otherwise("pool")
    return rows.join(workers, worker, "left").join(sites, site, "left").withColumn("side", side).drop("_golden", "_worker", "_site")


def greedy_validation(pool: DataFrame, worker: str, site: str, share: float) -> DataFrame:
    """``split`` of each session of the pool: ``val`` where both its worker and its site are on the validation side, ``train`` where neither is, else ``holdout``.

    Workers join the validation side one by one, with their sites, until ``share`` of the sessions
    are ``val``: the one that leaves the fewest sessions between the sides, then the one that adds
    most, then the least. One that adds none is passed over. A choice depends on all before it; each
    is one aggregation over the pool's (worker, site) counts, and only the chosen worker reaches
    the driver.
    """
    cells = settled(pool.groupBy(F.col(worker).alias("w"), F.col(site).alias("s")).agg(F.count("*").alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    state = cells.withColumn("w_in", F.lit(False)).withColumn("s_in", F.lit(False))
    have = 0
    while have < share * total:
        # What a candidate changes: sessions at its own sites, of itself and of workers already in.
        own = state.where("not w_in").select(F.col("w").alias("c"), "s").distinct()
        at_sites = state.groupBy("s").agg(F.sum(F.when(F.col("w_in"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("whole"), F.max("s_in").alias("s_in"))
        mine = state.where("not w_in").select(F.col("w").alias("c"), "s", "n", "s_in")
        gained = mine.join(at_sites.drop("s_in"), "s").groupBy("c").agg(
            F.sum(F.col("n") + F.when(~F.col("s_in"), F.col("inside")).otherwise(0)).alias("val_more"),
            F.sum(F.when(F.col("s_in"), -F.col("n")).otherwise(F.col("whole") - F.col("n") - 2 * F.col("inside"))).alias("mixed_more"),
        )
        best = gained.where("val_more > 0").orderBy("mixed_more", F.desc("val_more"), "c").limit(1).collect()
        if not best:
            break
        chosen = best[0]["c"]
        sites = own.where(F.col("c") == F.lit(chosen)).select("s", F.lit(True).alias("_new"))
        state = settled(state.join(sites, "s", "left").select("w", "s", "n", (F.col("w_in") | (F.col("w") == F.lit(chosen))).alias("w_in"), (F.col("s_in") | F.coalesce("_new", F.lit(False))).alias("s_in")))
        have += int(best[0]["val_more"])
    split = F.when(F.col("w_in") & F.col("s_in"), "val").when(F.col("w_in") | F.col("s_in"), "holdout").otherwise("train")
    return pool.join(state.select(F.col("w").alias(worker), F.col("s").alias(site), split.alias("split")), [worker, site])


def shared_across(rows: DataFrame, member: str, split: str) -> DataFrame:
    """Members found in more than one split: must be empty."""
    return rows.groupBy(member).agg(F.count_distinct(split).alias("splits")).where("splits > 1")
