"""Append-only histories in which a record may correct or retract its parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .settled import settled


def _linked(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """``id`` and ``up`` of each record; a parent that is no record counts as none."""
    rows = edges.select(F.col(child).alias("id"), F.col(parent).alias("up"))
    known = rows.select(F.col("id").alias("up"), F.lit(True).alias("_known")).distinct()
    return rows.join(known, "up", "left").select("id", F.when(F.col("_known"), F.col("up")).alias("up"))


def closure(edges: DataFrame, roots: DataFrame, child: str, parent: str) -> DataFrame:
    """Ids in ``roots`` (column ``id``) and all that descend from them.

    Every record looks up its ancestor at double the distance of the round before, and stops at
    the first one in ``roots``: about log2 of the longest chain rounds, whatever its length. A
    cycle ends after as many rounds as the number of records has bits.
    """
    marked = roots.select("id").distinct()
    hit = marked.select("id", F.lit(True).alias("_hit"))
    rows = edges.select(F.col(child).alias("id"), F.col(parent).alias("up"))
    # Only records that still look up are joined: ends of chains have no ancestor to meet, and would all be in one task.
    own = rows.join(hit, "id", "left")
    above = hit.select(F.col("id").alias("up"), F.col("_hit").alias("_above"))
    first = own.where("up is not null").join(above, "up", "left").select("id", "up", F.coalesce("_hit", "_above", F.lit(False)).alias("hit"))
    now = settled(first.unionByName(own.where("up is null").select("id", "up", F.coalesce("_hit", F.lit(False)).alias("hit"))))
    open_ = F.col("up").isNotNull() & ~F.col("hit")
    for _ in range(now.count().bit_length() + 1):
        if now.where(open_).isEmpty():
            break
        above = now.where("id is not null").select(F.col("id").alias("up"), F.when(~F.col("hit"), F.col("up")).alias("_up"), F.col("hit").alias("_hit"))
        further = now.where(open_).join(above, "up", "left").select("id", F.col("_up").alias("up"), F.coalesce("_hit", F.lit(False)).alias("hit"))
        now = settled(further.unionByName(now.where(~open_)))
    return marked.unionAll(now.where("hit").select("id")).distinct()


def chain_roots(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """``id``, ``root`` and ``depth`` of each record, by doubling the distance looked up: about log2 of the longest chain rounds.

    A chain ends at a record without a parent, or whose parent isn't there. One that runs into a
    cycle ends where it enters, so each record of a cycle is its own root.
    """
    links = settled(_linked(edges, child, parent))
    rounds = links.count().bit_length() + 1
    now = links.select("id", F.coalesce("up", "id").alias("root"), F.col("up").isNotNull().cast("long").alias("depth"))
    for _ in range(rounds):
        up = now.select(F.col("id").alias("root"), F.col("root").alias("_up"), F.col("depth").alias("_more"))
        both = settled(now.join(up, "root").select("id", F.col("_up").alias("root"), (F.col("depth") + F.col("_more")).alias("depth"), (F.col("_more") > 0).alias("_moved")))
        now = both.drop("_moved")
        if both.where("_moved").isEmpty():
            return now
    # What still moves after so many steps is in a cycle now: these records are the ends of their chains.
    cycle = both.where("_moved").select(F.col("root").alias("id"), F.lit(True).alias("_cycle")).distinct()
    cut = links.join(cycle, "id", "left").select("id", F.when(F.col("_cycle").isNull(), F.col("up")).alias("up"))
    return chain_roots(cut, "id", "up")


def current(records: DataFrame, record_id: str, parent: str, retracted: Column, non_operational: Column | None = None) -> DataFrame:
    """Records in force: no other corrects them, they aren't retractions, and no ancestor is ``non_operational``."""
    corrected = records.where(F.col(parent).isNotNull()).select(F.col(parent).alias(record_id)).distinct()
    out = records.join(corrected, record_id, "left_anti").where(~retracted)
    if non_operational is not None:
        banned = closure(records, records.where(non_operational).select(F.col(record_id).alias("id")), record_id, parent)
        out = out.join(banned.withColumnRenamed("id", record_id), record_id, "left_anti")
    return out


def allowed_transition(states: list[str], terminal: str, before: str, after: str) -> Column:
    """A state may stay, go one step on, or end; the end is final."""
    place = lambda c: F.array_position(F.array(*map(F.lit, states)), F.col(c))
    return F.when(F.col(before) == F.col(after), True).when(F.col(before) == terminal, False).when(F.col(after) == terminal, True).otherwise(place(after) == place(before) + 1)


def lifecycle_faults(events: DataFrame, keys: list[str], order: list[str], before: str, after: str, states: list[str], terminal: str) -> DataFrame:
    """Events that no rule allows, or that don't start where the event before ended."""
    last = F.lag(after).over(W.Window.partitionBy(*keys).orderBy(*order))
    broken = F.coalesce(last != F.col(before), F.lit(False)) | ~F.coalesce(allowed_transition(states, terminal, before, after), F.lit(False))
    return events.withColumn("_broken", broken).where("_broken").drop("_broken")


def parents_missing(records: DataFrame, record_id: str, parent: str) -> DataFrame:
    """Records whose parent isn't there."""
    known = records.select(F.col(record_id).alias(parent)).distinct()
    return records.where(F.col(parent).isNotNull()).join(known, parent, "left_anti").select(*records.columns)
