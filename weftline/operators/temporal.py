"""Sequences and intervals within a key: islands, transitions, holes, differences, runs.

Intervals are half-open, ``[start, end)``. Every window orders by time and then by the row's
id, so results don't depend on how rows are dealt. All is built from window functions:
one shuffle by key, and the sort is shared by all windows of the same order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import joins

Keys = Sequence[str]


def _before(keys: Keys, *order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)


def _until(keys: Keys, *order: str) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)


def with_island(df: DataFrame, keys: Keys, start: str, end: str, row_id: str, gap: Column | int | float = 0) -> DataFrame:
    """Adds ``island``: an interval joins the one before it if it starts at most ``gap`` after the latest end so far, touching included."""
    latest = F.max(end).over(_before(keys, start, row_id))
    fresh = F.when(latest.isNull() | (F.col(start) - latest > gap), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(_until(keys, start, row_id))).drop("_fresh")


def merged(df: DataFrame, keys: Keys, start: str, end: str, row_id: str, gap: Column | int | float = 0, **aggregates: Column) -> DataFrame:
    """One row per island: its span, the number of intervals, and ``aggregates``."""
    rows = with_island(df, keys, start, end, row_id, gap)
    return rows.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *(v.alias(k) for k, v in aggregates.items()))


def runs(df: DataFrame, keys: Keys, time: str, row_id: str, factor: float) -> DataFrame:
    """Sessions of times, cut where a gap exceeds ``factor`` times the key's median gap: ``run``, first and last time, count."""
    gap = F.col(time) - F.lag(time).over(W.Window.partitionBy(*keys).orderBy(time, row_id))
    rows = df.withColumn("_gap", gap)
    rows = rows.withColumn("_median", F.percentile("_gap", F.lit(0.5)).over(W.Window.partitionBy(*keys)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("_gap") > factor * F.col("_median"), 1).otherwise(0)).over(_until(keys, time, row_id)))
    return rows.groupBy(*keys, "run").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))


def transitions(df: DataFrame, keys: Keys, time: str, row_id: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before in their key, with that value as ``before``."""
    before = F.lag(value).over(W.Window.partitionBy(*keys).orderBy(time, row_id))
    return df.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def holes(df: DataFrame, keys: Keys, start: str, end: str, row_id: str, low: int | float, high: int | float) -> DataFrame:
    """Parts of ``[low, high)`` that no interval of the key covers: all of it for a key whose intervals lie outside."""
    spans = df.select(*keys, F.greatest(F.col(start), F.lit(low)).alias(start), F.least(F.col(end), F.lit(high)).alias(end), F.col(row_id))
    inside = F.col(end) > F.col(start)
    whole = merged(spans.where(inside), keys, start, end, row_id)
    order = W.Window.partitionBy(*keys).orderBy(start)
    before = whole.select(*keys, F.coalesce(F.lag(end).over(order), F.lit(low)).alias("hole_start"), F.col(start).alias("hole_end"))
    after = spans.groupBy(*keys).agg(F.coalesce(F.max(F.when(inside, F.col(end))), F.lit(low)).alias("hole_start"), F.lit(high).cast(df.schema[end].dataType).alias("hole_end"))
    return before.unionByName(after).where("hole_end > hole_start")


def subtracted(spans: DataFrame, cuts: DataFrame, keys: Keys, span_id: str, start: str, end: str, cut_id: str, width: int | None = None) -> DataFrame:
    """What is left of each span of ``spans`` without the same key's ``cuts``. Both have ``start`` and ``end``, and meet in bins of ``width``, by default the mean length of a span."""
    width = width or max(1, int(spans.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 1))
    cuts = cuts.select(*keys, F.col(start).alias("_cs"), F.col(end).alias("_ce"), F.col(cut_id).alias("_cid"))
    hit = joins.overlaps(spans, cuts, keys, (start, end), ("_cs", "_ce"), width).drop("overlap")
    merged_cuts = merged(hit, [*keys, span_id, start, end], "_cs", "_ce", "_cid")
    order = W.Window.partitionBy(*keys, span_id).orderBy("_cs")
    pieces = merged_cuts.select(*keys, span_id, F.coalesce(F.lag("_ce").over(order), F.col(start)).alias("part_start"), F.col("_cs").alias("part_end"))
    tail = merged_cuts.groupBy(*keys, span_id).agg(F.max("_ce").alias("part_start"), F.max(end).alias("part_end"))
    untouched = spans.join(merged_cuts.select(*keys, span_id).distinct(), [*keys, span_id], "left_anti").select(*keys, span_id, F.col(start).alias("part_start"), F.col(end).alias("part_end"))
    return pieces.unionByName(tail).unionByName(untouched).where("part_end > part_start")


def hysteresis(df: DataFrame, keys: Keys, time: str, row_id: str, value: str, on: float, off: float) -> DataFrame:
    """Intervals that start where the value exceeds ``on`` and hold while it is at least ``off``; a start reaches back over the samples above ``off`` next to it.

    Samples below ``off`` cut the sequence into stretches; a stretch counts if it exceeds
    ``on`` somewhere. A sample equal to ``off`` holds a running interval but can't begin one.
    """
    below = F.when(F.col(value) < off, 1).otherwise(0)
    rows = df.withColumn("_stretch", F.sum(below).over(_until(keys, time, row_id))).where(F.col(value) >= off)
    # Before the first sample above "on", a sample at exactly "off" cuts the way back.
    peak = F.min(F.when(F.col(value) > on, F.col(time))).over(W.Window.partitionBy(*keys, "_stretch"))
    rows = rows.withColumn("_peak", peak).where("_peak is not null")
    edge = F.max(F.when((F.col(value) <= off) & (F.col(time) < F.col("_peak")), F.col(time))).over(W.Window.partitionBy(*keys, "_stretch"))
    rows = rows.withColumn("_edge", edge).where(F.col("_edge").isNull() | (F.col(time) > F.col("_edge")))
    return rows.groupBy(*keys, "_stretch").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.max(value).alias("peak"), F.count("*").alias("n")).drop("_stretch")


def rates(df: DataFrame, keys: Keys, time: str, row_id: str, value: str, longest: float) -> DataFrame:
    """Adds ``speed`` (change per unit of time since the sample before) and ``acceleration``; a gap above ``longest`` starts anew."""
    order = W.Window.partitionBy(*keys).orderBy(time, row_id)
    step = F.col(time) - F.lag(time).over(order)
    rows = df.withColumn("_step", F.when((step > 0) & (step <= longest), step))
    rows = rows.withColumn("speed", (F.col(value) - F.lag(value).over(order)) / F.col("_step"))
    return rows.withColumn("acceleration", (F.col("speed") - F.lag("speed").over(order)) / F.col("_step")).drop("_step")


def moving_average(df: DataFrame, keys: Keys, time: str, row_id: str, value: str, around: int) -> DataFrame:
    """Adds ``smooth``: the mean of the sample and ``around`` samples on each side."""
    return df.withColumn("smooth", F.avg(value).over(W.Window.partitionBy(*keys).orderBy(time, row_id).rowsBetween(-around, around)))


def weekly_alerts(df: DataFrame, keys: Keys, week: str, value: str, jump: float, flat_weeks: int) -> DataFrame:
    """Weeks whose value rose by more than ``jump`` of the week before, or hasn't moved for ``flat_weeks``; missing values never alert."""
    order = W.Window.partitionBy(*keys).orderBy(week)
    usable = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    rows = df.withColumn("_v", usable).withColumn("_last", F.lag("_v").over(order)).withColumn("_old", F.lag("_v", flat_weeks - 1).over(order))
    rose = F.coalesce((F.col("_v") - F.col("_last")) > jump * F.abs("_last"), F.lit(False))
    flat = F.coalesce(F.col("_v") == F.col("_old"), F.lit(False))
    return rows.withColumn("rose", rose).withColumn("flat", flat).drop("_v", "_last", "_old").where("rose or flat")
