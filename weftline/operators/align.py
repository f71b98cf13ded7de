"""Clocks and series: fitting, resampling, correlation by lag, outliers by median deviation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

Keys = Sequence[str]


def clock_fit(anchors: DataFrame, keys: Keys, own: str, master: str, least_span: float, most_drift_ppm: float) -> DataFrame:
    """Scale and offset by least squares where the anchors span enough time, else scale 1 and the median offset; ``ok`` is false beyond the drift limit."""
    out = anchors.groupBy(*keys).agg(
        F.count("*").alias("anchors"), (F.max(own) - F.min(own)).alias("span"), F.regr_slope(master, own).alias("slope"),
        F.regr_intercept(master, own).alias("intercept"), F.percentile(F.col(master) - F.col(own), F.lit(0.5)).alias("median_offset"),
    )
    fitted = (F.col("span") >= least_span) & F.col("slope").isNotNull()
    out = out.withColumn("scale", F.when(fitted, F.col("slope")).otherwise(1.0)).withColumn("offset", F.when(fitted, F.col("intercept")).otherwise(F.col("median_offset")))
    return out.withColumn("ok", F.abs(F.col("scale") - 1) * 1e6 <= most_drift_ppm).drop("slope", "intercept", "median_offset")


def outliers(df: DataFrame, keys: Keys, value: str, factor: float) -> DataFrame:
    """Rows further from their key's median than ``factor`` times the median deviation."""
    own = W.Window.partitionBy(*keys)
    rows = df.withColumn("median", F.percentile(value, F.lit(0.5)).over(own))
    rows = rows.withColumn("deviation", F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).over(own))
    return rows.where(F.abs(F.col(value) - F.col("median")) > factor * F.col("deviation"))


def binned(df: DataFrame, keys: Keys, time: str, value: str, step: float) -> DataFrame:
    """Mean of the samples in each step of time."""
    return df.groupBy(*keys, F.floor(F.col(time) / step).alias("slot")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def correlations(a: DataFrame, b: DataFrame, keys: Keys, slot: str, value: str, most_lag: int) -> DataFrame:
    """Pearson correlation of two binned series for each lag: b's slot minus a's. Each slot of ``a`` meets 2 x most_lag + 1 slots of ``b``."""
    lags = F.sequence(F.lit(-most_lag), F.lit(most_lag))
    shifted = a.select(*keys, F.col(slot).alias("_slot"), F.col(value).alias("_a"), F.explode(lags).alias("lag")).withColumn("_to", F.col("_slot") + F.col("lag"))
    other = b.select(*keys, F.col(slot).alias("_to"), F.col(value).alias("_b"))
    return shifted.join(other, [*keys, "_to"]).groupBy(*keys, "lag").agg(F.corr("_a", "_b").alias("correlation"), F.count("*").alias("n"))


def best_lag(rows: DataFrame, keys: Keys) -> DataFrame:
    """The lag of highest correlation, the smallest shift of equals."""
    return rows.where("correlation is not null").groupBy(*keys).agg(F.max(F.struct(F.col("correlation"), (-F.abs("lag")).alias("near"), F.col("lag"))).alias("m")).select(*keys, "m.lag", "m.correlation")
