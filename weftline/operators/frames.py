"""Frames, registrations, vocabularies and simple tracks: what is next, in force, first, evenly spread or sure enough."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

Keys = Sequence[str]


def _line(keys: Keys, *order: str | Column) -> W.WindowSpec:
    return W.Window.partitionBy(*keys).orderBy(*order)


def next_values(rows: DataFrame, keys: Keys, order: Keys, value: str, name: str = "action") -> DataFrame:
    """Adds the value of the key's next row; the last row repeats its own."""
    return rows.withColumn(name, F.coalesce(F.lead(value).over(_line(keys, *order)), F.col(value)))


def in_force(rows: DataFrame, keys: Keys, row_id: str, starts: Column, made: str) -> DataFrame:
    """The one row of each key that holds: rows that have started before others, then the latest ``made``, then the greatest id."""
    best = F.max(F.struct(F.coalesce(starts, F.lit(False)).cast("int").alias("f"), F.col(made).alias("m"), F.col(row_id).alias("i")))
    return rows.groupBy(*keys).agg(best.getField("i").alias(row_id))


def spikes(rows: DataFrame, keys: Keys, time: str, row_id: str, value: str, fastest: float, unit: float = 1.0) -> DataFrame:
    """Rows that are too fast for both neighbours: further away than ``fastest`` for each ``unit`` of time, on either side."""
    line = _line(keys, time, row_id)
    step = lambda c, d: (F.lead(c).over(line) - F.col(c)) if d > 0 else (F.col(c) - F.lag(c).over(line))
    marked = rows
    for name, d in (("_past", -1), ("_next", 1)):
        marked = marked.withColumn(name, F.struct(step(value, d).alias("v"), step(time, d).alias("t")))
    fast = lambda c: (F.col(f"{c}.t") > 0) & (F.abs(f"{c}.v") * unit > fastest * F.col(f"{c}.t"))
    return marked.where(fast("_past") & fast("_next")).drop("_past", "_next")


def knee(points: DataFrame, keys: Keys, load: str, throughput: str, slow: str | None = None, slowest: float | None = None) -> DataFrame:
    """The point of most throughput for each key, of equals that of least load. Points whose ``slow`` figure, such as a 95th percentile, is beyond ``slowest`` don't count unless all of a key's are; these then have ``over``."""
    rows = points.withColumn("over", F.coalesce(F.col(slow) > slowest, F.lit(True)) if slow else F.lit(False))
    best = F.max(F.struct((~F.col("over")).alias("ok"), F.col(throughput).alias("n"), (-F.col(load)).alias("l"), F.col("over").alias("o")))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b.l")).alias(load), F.col("_b.n").alias(throughput), F.col("_b.o").alias("over"))


def vocabulary(rows: DataFrame, value: str, seen: str) -> DataFrame:
    """``code`` from 0 for each distinct value, in the order of its first ``seen``. A vocabulary is small: its values are numbered in one task."""
    first = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(seen).alias("_first"))
    return first.select(value, (F.row_number().over(W.Window.orderBy("_first", value)) - 1).alias("code"))


def evenly(rows: DataFrame, keys: Keys, order: Keys, n: int) -> DataFrame:
    """``n`` rows of each key, evenly spread in its order, the first among them; all of a key with fewer."""
    marked = rows.withColumn("_k", F.row_number().over(_line(keys, *order)) - 1).withColumn("_all", F.count(F.lit(1)).over(W.Window.partitionBy(*keys)))
    return marked.where(f"_k = 0 or (_k * {n}) div _all > ((_k - 1) * {n}) div _all").drop("_k", "_all")


def confident(rows: DataFrame, keys: Keys, time: str, sure: Column, least_frames: int, least_span: float) -> DataFrame:
    """Tracks from their first sure frame on, with ``frames`` and ``span``; those of fewer frames or a shorter span go."""
    marked = rows.withColumn("_start", F.min(F.when(sure, F.col(time))).over(W.Window.partitionBy(*keys))).where(F.col(time) >= F.col("_start"))
    out = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), (F.max(time) - F.min(time)).alias("span"))
    return out.where((F.col("frames") >= least_frames) & (F.col("span") >= least_span))


def absolute_error(pairs: DataFrame, keys: Keys, truth: str, guess: str, missing: float = 0.0) -> DataFrame:
    """``n`` and the mean distance of guesses from truths, of rows that have a truth; what was not guessed counts as ``missing``."""
    distance = F.abs(F.col(truth) - F.coalesce(F.col(guess).cast("double"), F.lit(missing)))
    return pairs.where(F.col(truth).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(distance).alias("error"))
