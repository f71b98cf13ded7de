"""Sampled signals: rates, grids, jitter, taps and offsets between clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import joins

Keys = Sequence[str]


def sampling(samples: DataFrame, keys: Keys, time: str, tick: float = 1.0) -> DataFrame:
    """Per key: samples, rate by the median gap (per 1,000 of time), duration with a last median gap, and whether gaps vary by more than a tick or a hundredth of the least (never under three samples)."""
    gap = F.col(time) - F.lag(time).over(W.Window.partitionBy(*keys).orderBy(time))
    rows = samples.withColumn("_gap", gap).groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_gap", F.lit(0.5)).alias("_m"), F.min("_gap").alias("_low"), F.max("_gap").alias("_high"), F.min(time).alias("_first"), F.max(time).alias("_last"))
    varies = (F.col("n") >= 3) & (F.col("_high") - F.col("_low") > F.greatest(F.lit(tick), F.floor(F.col("_low") / (100 * tick)) * tick))
    return rows.select(*keys, "n", (1000 / F.nullif(F.col("_m"), F.lit(0.0))).alias("rate"), (F.col("_last") + F.coalesce("_m", F.lit(0.0))).alias("duration"), F.coalesce(varies, F.lit(False)).alias("varies"))


def resampled(samples: DataFrame, keys: Keys, time: str, value: str, sample_id: str, step: int) -> DataFrame:
    """Linear interpolation on the grid of whole steps from the first sample to the last."""
    ends = samples.groupBy(*keys).agg(F.min(time).alias("_low"), F.max(time).alias("_high"))
    grid = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.floor((F.col("_high") - F.col("_low")) / step).cast("int"))).alias("place"), "_low")
    grid = grid.withColumn(time, F.col("_low") + F.col("place") * step).drop("_low")
    return joins.interpolated(grid, samples, keys, time, "place", sample_id, value, float("inf"))


def jitter(samples: DataFrame, keys: Keys, time: str, x: str, y: str, scale: str, longest: float) -> DataFrame:
    """Adds ``jitter``: the second difference of a place over the scale; null at ends and where a gap is longer than ``longest``."""
    w = W.Window.partitionBy(*keys).orderBy(time)
    second = lambda c: F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w)
    close = (F.col(time) - F.lag(time).over(w) <= longest) & (F.lead(time).over(w) - F.col(time) <= longest)
    return samples.withColumn("jitter", F.when(close & (F.col(scale) > 0), F.hypot(second(x), second(y)) / F.col(scale)))


def motion(samples: DataFrame, keys: Keys, axes: Sequence[str]) -> DataFrame:
    """Adds ``motion``: how far the length of a vector (an accelerometer's axes) lies from its median."""
    size = F.sqrt(sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0])))
    rows = samples.withColumn("_size", size)
    return rows.withColumn("motion", F.abs(F.col("_size") - F.percentile("_size", F.lit(0.5)).over(W.Window.partitionBy(*keys)))).drop("_size")


def pulses(samples: DataFrame, keys: Keys, time: str, value: str, factor: float, longest: float) -> DataFrame:
    """Short stretches above the median by ``factor`` median deviations: ``start``, ``end`` and ``at``, the time of the peak; longer ones than ``longest`` are no pulses."""
    own, order = W.Window.partitionBy(*keys), W.Window.partitionBy(*keys).orderBy(time)
    rows = samples.withColumn("_m", F.percentile(value, F.lit(0.5)).over(own))
    rows = rows.withColumn("_d", F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).over(own)).withColumn("_above", F.col(value) > F.col("_m") + factor * F.col("_d"))
    rows = rows.withColumn("_stretch", F.sum((~F.col("_above")).cast("int")).over(order.rowsBetween(W.Window.unboundedPreceding, 0))).where("_above")
    out = rows.groupBy(*keys, "_stretch").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.min_by(F.col(time), F.struct((-F.col(value)).alias("v"), F.col(time).alias("t"))).alias("at"))
    return out.where(F.col("end") - F.col("start") <= longest).drop("_stretch")


def double_taps(found: DataFrame, keys: Keys, least: float, most: float) -> DataFrame:
    """Pairs of neighbouring pulses ``least`` to ``most`` apart, as ``first`` and ``second``. A pulse is in one pair at most: of a run of close ones, the first with the second, the third with the fourth."""
    order = W.Window.partitionBy(*keys).orderBy("at")
    gap = F.lead("at").over(order) - F.col("at")
    close = F.coalesce(gap.between(least, most), F.lit(False))
    rows = found.withColumn("_second", F.lead("at").over(order)).withColumn("_close", close)
    rows = rows.withColumn("_run", F.sum((~F.lag("_close", 1, False).over(order)).cast("int")).over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_place", F.row_number().over(W.Window.partitionBy(*keys, "_run").orderBy("at")))
    return rows.where(F.col("_close") & (F.col("_place") % 2 == 1)).select(*keys, F.col("at").alias("first"), F.col("_second").alias("second"))


def offset_votes(reference: DataFrame, target: DataFrame, keys: Keys, time: str, most: float, width: float) -> DataFrame:
    """``offset`` that most events of the target agree on, reference minus target, within ``most``; with its ``votes`` and the runner-up's.

    Events meet in bins of ``most``; every pair votes for its difference and both its neighbours of ``width``, so that a
    cluster over an edge isn't torn.
    """
    a = reference.select(*keys, F.col(time).alias("_a"), F.explode(F.array(*(F.floor(F.col(time) / most) + k for k in (-1, 0, 1)))).alias("_bin"))
    b = target.select(*keys, F.col(time).alias("_b"), F.floor(F.col(time) / most).alias("_bin"))
    pairs = a.join(b, [*keys, "_bin"]).withColumn("d", F.col("_a") - F.col("_b")).where(F.abs("d") <= most)
    votes = pairs.groupBy(*keys, F.round(F.col("d") / width).cast("long").alias("cell")).agg(F.count("*").alias("_n"), F.sum("d").alias("_sum"))
    near = W.Window.partitionBy(*keys).orderBy("cell").rangeBetween(-1, 1)
    rows = votes.withColumn("votes", F.sum("_n").over(near)).withColumn("offset", F.sum("_sum").over(near) / F.sum("_n").over(near))
    best = W.Window.partitionBy(*keys).orderBy(F.desc("votes"), F.abs("offset"), "cell")
    rows = rows.withColumn("_place", F.row_number().over(best)).withColumn("_top", F.first("cell").over(best))
    apart = rows.where(F.abs(F.col("cell") - F.col("_top")) > 2).groupBy(*keys).agg(F.max("votes").alias("second"))
    return rows.where("_place = 1").select(*keys, "offset", "votes").join(apart, list(keys), "left").fillna({"second": 0})


def peak(correlations: DataFrame, keys: Keys, lag: str, value: str, exclude: int) -> DataFrame:
    """The largest correlation with its lag refined by a parabola through its neighbours, and how far it stands above the rest: peak minus mean over the deviation of lags further than ``exclude``."""
    order, own = W.Window.partitionBy(*keys).orderBy(lag), W.Window.partitionBy(*keys)
    top = F.first(lag).over(own.orderBy(F.desc(value), lag))
    rows = correlations.withColumn("_before", F.lag(value).over(order)).withColumn("_after", F.lead(value).over(order)).withColumn("_top", top)
    far = F.abs(F.col(lag) - F.col("_top")) > exclude
    sides = rows.groupBy(*keys).agg(F.avg(F.when(far, F.col(value))).alias("_mean"), F.stddev_pop(F.when(far, F.col(value))).alias("_dev"))
    bend = F.col("_before") - 2 * F.col(value) + F.col("_after")
    shift = F.coalesce(F.when(bend < 0, 0.5 * (F.col("_before") - F.col("_after")) / bend), F.lit(0.0))
    found = rows.where(F.col(lag) == F.col("_top")).join(sides, list(keys))
    return found.select(*keys, (F.col(lag) + shift).alias("lag"), F.col(value).alias("peak"), ((F.col(value) - F.col("_mean")) / F.nullif(F.col("_dev"), F.lit(0.0))).alias("prominence"))


def faster(samples: DataFrame, keys: Keys, time: str, places: Sequence[tuple[str, str]]) -> DataFrame:
    """Speed of the fastest of several points between neighbouring samples, at the middle of both: ``at`` and ``speed``."""
    w = W.Window.partitionBy(*keys).orderBy(time)
    step = F.nullif((F.col(time) - F.lag(time).over(w)).cast("double"), F.lit(0.0))
    speeds = [F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) / step for x, y in places]
    fastest = F.greatest(*speeds) if len(speeds) > 1 else speeds[0]
    return samples.select(*keys, ((F.col(time) + F.lag(time).over(w)) / 2).alias("at"), fastest.alias("speed")).where("speed is not null")


def best_correlated(reference: DataFrame, others: DataFrame, keys: Keys, who: str, time: str, least_overlap: int, least: float) -> DataFrame:
    """Of series on the reference's grid, the one that correlates best with it, if over enough samples and by enough: ``who`` and ``r``."""
    both = reference.select(*keys, time, F.col("speed").alias("_r")).join(others.select(*keys, who, time, F.col("speed").alias("_s")), [*keys, time])
    rows = both.groupBy(*keys, who).agg(F.corr("_r", "_s").alias("r"), F.count("*").alias("_n")).where((F.col("_n") >= least_overlap) & (F.col("r") >= least))
    return rows.groupBy(*keys).agg(F.max(F.struct("r", who)).alias("_m")).select(*keys, f"_m.{who}", "_m.r")


def held(samples: DataFrame, keys: Keys, time: str, value: Column, missing: Column, longest: float) -> DataFrame:
    """Adds ``filled``: where ``missing``, the last value before it if that is at most ``longest`` old."""
    w = W.Window.partitionBy(*keys).orderBy(time).rowsBetween(W.Window.unboundedPreceding, 0)
    last = F.last(F.when(~missing, F.struct(F.col(time).alias("t"), value.alias("v"))), ignorenulls=True).over(w)
    return samples.withColumn("filled", F.when(F.col(time) - last["t"] <= longest, last["v"]))
