"""Where one action ends and the next begins: candidates from motion and contact, thinned, and the segments between them.

A track has a place (``x``, ``y``) by time for each key; times are integers, unique within a key. Speeds, still
runs and valleys are window functions. What must be decided in order, the thinning of near
candidates, is cut at silences longer than the distance that it looks over: each stretch is decided by itself, so a
long key is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from . import joins
from .streamed import streamed

Keys = Sequence[str]
#: Kinds of candidates and which goes first: edges of contact, of rest, valleys of speed.
PRIORITY = {"contact_start": 0, "contact_end": 0, "still_start": 1, "still_end": 1, "valley": 2}


@dataclass(frozen=True)
class Limits:
    """Times in the unit of the track's; speeds in scales a ``second`` (so many of these units)."""

    smooth: int
    still_speed: float
    least_still: int
    valley_speed: float
    valley_ratio: float
    valley_window: int
    valley_apart: int
    merge: int
    second: float = 1000.0


def speeds(track: DataFrame, keys: Keys, time: str, x: str, y: str, scale: Column, limits: Limits) -> DataFrame:
    """Adds ``speed``: second-order differences (one-sided at the ends) in scales a second, averaged over ``smooth`` by the key's median step; beyond the ends the end's speed counts on."""
    line = W.Window.partitionBy(*keys).orderBy(time)
    t = F.col(time).cast("double") / limits.second
    back, ahead = t - F.lag(t).over(line), F.lead(t).over(line) - t

    def slope(c: str) -> Column:
        v = F.col(c).cast("double")
        low, high = v - F.lag(v).over(line), F.lead(v).over(line) - v
        middle = (back * back * high + ahead * ahead * low) / (back * ahead * (back + ahead))
        return F.coalesce(middle, high / ahead, low / back, F.lit(0.0))

    whole = W.Window.partitionBy(*keys)
    rows = track.withColumn("_v", F.hypot(slope(x), slope(y)) / F.greatest(scale, F.lit(1e-6))).withColumn("_step", F.col(time) - F.lag(time).over(line))
    rows = rows.withColumn("_step", F.percentile("_step", F.lit(0.5)).over(whole))
    # Half up to even, as Python rounds.
    frames = F.when(F.col("_step") > 0, F.greatest(F.lit(1), F.bround(F.lit(float(limits.smooth)) / F.col("_step")).cast("int"))).otherwise(1)
    rows = rows.withColumn("_k", frames).withColumn("_i", F.row_number().over(line)).withColumn("_n", F.count(F.lit(1)).over(whole))
    # One number; frames of a window must be known when it is planned.
    most = rows.agg(F.max("_k")).first()[0] or 1
    before, after = F.floor(F.col("_k") / 2).cast("int"), (F.col("_k") - 1 - F.floor(F.col("_k") / 2)).cast("int")
    early, late = F.collect_list("_v").over(line.rowsBetween(-most, -1)), F.collect_list("_v").over(line.rowsBetween(0, most))
    full = line.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    rows = rows.withColumns({"_early": early, "_late": late, "_first": F.first("_v").over(full), "_last": F.last("_v").over(full), "_b": before, "_a": after})
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    short, over = F.greatest(F.lit(0), F.col("_b") - F.col("_i") + 1), F.greatest(F.lit(0), F.col("_a") - (F.col("_n") - F.col("_i")))
    there = F.least(F.col("_b"), F.size("_early"))
    inside = total(F.when(there > 0, F.slice("_early", -F.greatest(there, F.lit(1)), F.greatest(there, F.lit(1)))).otherwise(F.array().cast("array<double>"))) + total(F.slice("_late", F.lit(1), F.col("_a") + 1))
    rows = rows.withColumn("speed", (inside + short * F.col("_first") + over * F.col("_last")) / F.col("_k"))
    return rows.drop("_v", "_step", "_k", "_i", "_n", "_early", "_late", "_first", "_last", "_b", "_a")


def still_runs(rows: DataFrame, keys: Keys, time: str, limits: Limits) -> DataFrame:
    """Rows with ``still``: whether they lie in a run of slow samples that lasts ``least_still``, and ``edge``: still_start or still_end at the run's ends, but at the track's."""
    line = W.Window.partitionBy(*keys).orderBy(time)
    slow = F.col("speed") < limits.still_speed
    rows = rows.withColumn("_run", F.sum(F.when(slow, 0).otherwise(1)).over(line.rowsBetween(W.Window.unboundedPreceding, 0))).withColumn("_slow", slow)
    run = W.Window.partitionBy(*keys, "_run", "_slow")
    rows = rows.withColumns({"_low": F.min(time).over(run), "_high": F.max(time).over(run), "_first": F.lag(time).over(line).isNull(), "_last": F.lead(time).over(line).isNull()})
    still = F.col("_slow") & (F.col("_high") - F.col("_low") >= limits.least_still)
    starts, ends = still & (F.col(time) == F.col("_low")) & ~F.col("_first"), still & (F.col(time) == F.col("_high")) & ~F.col("_last")
    edges = F.filter(F.array(F.when(starts, "still_start"), F.when(ends, "still_end")), lambda e: e.isNotNull())
    return rows.withColumn("still", still).withColumn("edges", edges).drop("_run", "_slow", "_low", "_high", "_first", "_last")


def stretches(points: DataFrame, keys: Keys, time: str, apart: int) -> DataFrame:
    """Adds ``_stretch``: points of a key further than ``apart`` from the point before start another."""
    line = W.Window.partitionBy(*keys).orderBy(time)
    fresh = F.when(F.col(time) - F.lag(time).over(line) > apart, 1).otherwise(0)
    return points.withColumn("_fresh", fresh).withColumn("_stretch", F.sum("_fresh").over(line.rangeBetween(W.Window.unboundedPreceding, 0))).drop("_fresh")


def spaced(points: DataFrame, keys: Keys, time: str, apart: int) -> DataFrame:
    """Of points in order of time, those at least ``apart`` after the last one taken."""
    rows = stretches(points.select(*keys, time), keys, time, apart - 1)

    def step(last: int | None, row: dict) -> tuple[int, list[dict]]:
        taken = last is None or row[time] - last >= apart
        return (row[time] if taken else last), [{c: row[c] for c in (*keys, time)}] if taken else []

    return streamed(rows, [*keys, "_stretch"], [time], step, StructType([rows.schema[c] for c in (*keys, time)]))


def thinned(points: DataFrame, keys: Keys, time: str, apart: int) -> DataFrame:
    """Points (``time``, ``reason``, ``priority``) in order: one within ``apart`` of the last that stays goes, or takes its place if its priority is smaller."""
    rows = stretches(points.select(*keys, time, "reason", "priority"), keys, time, apart)

    def kept(state: dict | None) -> list[dict]:
        return [{c: state[c] for c in (*keys, time, "reason")}] if state else []

    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        if state is None:
            return row, []
        if row[time] - state[time] <= apart:
            return (row if row["priority"] < state["priority"] else state), []
        return row, kept(state)

    schema = StructType([*(rows.schema[c] for c in (*keys, time)), StructField("reason", StringType())])
    return streamed(rows, [*keys, "_stretch"], [time, "priority", "reason"], step, schema, end=kept)


def boundary_candidates(track: DataFrame, contacts: DataFrame, keys: Keys, time: str, x: str, y: str, scale: Column, limits: Limits, width: int) -> DataFrame:
    """Times at which an action may end, with ``reason``, further than ``merge`` apart: edges of ``contacts`` (``start``, ``end``), of rest, and valleys of speed outside contacts.

    A valley is a local minimum below ``valley_speed`` and below ``valley_ratio`` of the fastest sample within ``valley_window`` on either
    side. ``width`` is that of the bins in which samples and contacts meet.
    """
    rows = still_runs(speeds(track, keys, time, x, y, scale, limits), keys, time, limits)
    line = W.Window.partitionBy(*keys).orderBy(time)
    # A window over ranges of a long counts in its unit.
    near = lambda low, high: F.max("speed").over(line.rangeBetween(low, high))
    v, before, after = F.col("speed"), near(-limits.valley_window, -1), near(1, limits.valley_window)
    deep = (v <= limits.valley_ratio * before) & (v <= limits.valley_ratio * after) & (v <= F.lag(v).over(line)) & (v < F.lead(v).over(line))
    rows = rows.withColumn("_deep", F.coalesce(deep, F.lit(False)) & ~F.col("still") & (v < limits.valley_speed))
    valleys = rows.where("_deep").select(*keys, time)
    points = valleys.select(*keys, F.col(time).alias("_t"), (F.col(time) + 1).alias("_t1"))
    spans = contacts.select(*keys, (F.col("start") + 1).alias("_s"), F.col("end").alias("_e"))
    inside = joins.overlaps(points, spans, keys, ("_t", "_t1"), ("_s", "_e"), width).select(*keys, F.col("_t").alias(time)).distinct()
    valleys = spaced(valleys.join(inside, [*keys, time], "left_anti"), keys, time, limits.valley_apart).withColumn("reason", F.lit("valley"))
    edges = rows.select(*keys, time, F.explode("edges").alias("reason"))
    touching = contacts.select(*keys, F.explode(F.array(*(F.struct(F.col(c).alias(time), F.lit(f"contact_{c}").alias("reason")) for c in ("start", "end")))).alias("c")).select(*keys, "c.*")
    priority = F.coalesce(*(F.when(F.col("reason") == r, p) for r, p in PRIORITY.items())).cast(IntegerType())
    found = touching.unionByName(edges).unionByName(valleys).withColumn("priority", priority)
    return thinned(found, keys, time, limits.merge)


def action_segments(spans: DataFrame, candidates: DataFrame, keys: Keys, time: str, least: int) -> DataFrame:
    """Each span (``start``, ``end``, one for each key) cut at the candidates inside it; a piece shorter than ``least`` joins the one before it, as does what follows a piece still too short.

    A long piece after a long one always begins anew, whatever came before, so stretches between such places are put together apart.
    """
    cuts = candidates.join(spans.select(*keys, "start", "end"), list(keys)).where((F.col(time) > F.col("start")) & (F.col(time) < F.col("end"))).select(*keys, F.col(time).alias("_a"))
    line = W.Window.partitionBy(*keys).orderBy("_a")
    ends = spans.select(*keys, F.col("end").alias("_end"))
    pieces = spans.select(*keys, F.col("start").alias("_a")).unionByName(cuts.distinct()).join(ends, list(keys)).withColumn("_b", F.coalesce(F.lead("_a").over(line), "_end")).where("_b > _a")
    long = F.col("_b") - F.col("_a") >= least
    pieces = pieces.withColumn("_long", long).withColumn("_fresh", F.when(F.col("_long") & F.coalesce(F.lag("_long").over(line), F.lit(False)), 1).otherwise(0))
    pieces = pieces.withColumn("_stretch", F.sum("_fresh").over(line.rowsBetween(W.Window.unboundedPreceding, 0))).select(*keys, "_stretch", "_a", "_b")

    def whole(state: dict | None) -> list[dict]:
        return [{k: state[k] for k in keys} | {"start": state["_a"], "end": state["_b"]}] if state else []

    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        if state is None:
            return row, []
        if row["_b"] - row["_a"] < least or state["_b"] - state["_a"] < least:
            return state | {"_b": row["_b"]}, []
        return row, whole(state)

    schema = StructType([*(pieces.schema[k] for k in keys), StructField("start", LongType()), StructField("end", LongType())])
    return streamed(pieces, [*keys, "_stretch"], ["_a"], step, schema, end=whole)
