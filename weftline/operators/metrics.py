"""Quality of labels and predictions, as aggregations. "No data" is null, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .settled import settled

Keys = Sequence[str]


def confusion(df: DataFrame, keys: Keys, truth: str, guess: str) -> DataFrame:
    return df.groupBy(*keys, truth, guess).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, keys: Keys, truth: str, guess: str) -> DataFrame:
    """Per class of truth or guess: hits, precision, recall and F1, zero where there is nothing to divide by."""
    cells = confusion(df, keys, truth, guess)
    sides = cells.select(*keys, F.col(truth).alias("class"), F.col("n").alias("t"), F.lit(0).alias("g"), F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0).alias("hits"))
    sides = sides.unionByName(cells.select(*keys, F.col(guess).alias("class"), F.lit(0).alias("t"), F.col("n").alias("g"), F.lit(0).alias("hits")))
    out = sides.groupBy(*keys, "class").agg(F.sum("hits").alias("hits"), F.sum("t").alias("truths"), F.sum("g").alias("guesses"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select(*keys, "class", "hits", share(F.col("hits"), F.col("guesses")).alias("precision"), share(F.col("hits"), F.col("truths")).alias("recall"), share(2 * F.col("hits"), F.col("truths") + F.col("guesses")).alias("f1"))


def macro_f1(df: DataFrame, keys: Keys, truth: str, guess: str) -> DataFrame:
    return class_scores(df, keys, truth, guess).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("classes"))


def kappa(df: DataFrame, keys: Keys, a: str, b: str, weight: Column | None = None) -> DataFrame:
    """Agreement beyond chance; null if chance alone is certain."""
    w = F.lit(1.0) if weight is None else weight
    cells = df.groupBy(*keys, a, b).agg(F.sum(w).alias("w"))
    both = cells.groupBy(*keys).agg(F.sum("w").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("w")).otherwise(0)).alias("same"))
    rows = cells.groupBy(*keys, F.col(a).alias("class")).agg(F.sum("w").alias("wa"))
    columns = cells.groupBy(*keys, F.col(b).alias("class")).agg(F.sum("w").alias("wb"))
    chance = rows.join(columns, [*keys, "class"]).groupBy(*keys).agg(F.sum(F.col("wa") * F.col("wb")).alias("chance"))
    joined = both.join(chance, list(keys), "left") if keys else both.crossJoin(F.broadcast(chance))  # one row each
    p, e = F.col("same") / F.col("n"), F.coalesce("chance", F.lit(0.0)) / (F.col("n") * F.col("n"))
    return joined.select(*keys, "n", F.when(e < 1, (p - e) / (1 - e)).alias("kappa"))


def calibration_bins(df: DataFrame, keys: Keys, confidence: str, correct: Column, bins: int = 15) -> DataFrame:
    """Bins (low, high], the first closed: size, mean confidence, accuracy."""
    place = F.least(F.greatest(F.ceil(F.col(confidence) * bins) - 1, F.lit(0)), F.lit(bins - 1))
    return df.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(correct.cast("double")).alias("accuracy"))


def calibration_error(df: DataFrame, keys: Keys, confidence: str, correct: Column, bins: int = 15) -> DataFrame:
    """Expected calibration error."""
    rows = calibration_bins(df, keys, confidence, correct, bins)
    return rows.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def confidence_floor(df: DataFrame, keys: Keys, confidence: str, correct: Column, precision: float) -> DataFrame:
    """Least threshold from which on the precision reaches the target; equal confidences go together. Sums run over distinct confidences, so equal ones cost one row."""
    steps = df.groupBy(*keys, confidence).agg(F.count("*").alias("n"), F.sum(correct.cast("int")).alias("hits"))
    down = W.Window.partitionBy(*keys).orderBy(F.desc(confidence)).rowsBetween(W.Window.unboundedPreceding, 0)
    rows = steps.withColumn("kept", F.sum("n").over(down)).withColumn("right", F.sum("hits").over(down))
    good = rows.where(F.col("right") >= precision * F.col("kept"))
    return good.groupBy(*keys).agg(F.min_by(F.struct(F.col(confidence).alias("floor"), "kept", "right"), confidence).alias("m")).select(*keys, "m.*")


def smoothed_rates(df: DataFrame, classes: str, changed: Column, weight: float) -> DataFrame:
    """Rate of each class drawn towards the overall rate, as if ``weight`` more rows had that."""
    by_class = df.groupBy(classes).agg(F.count("*").alias("n"), F.sum(changed.cast("int")).alias("changed"))
    overall = by_class.agg((F.sum("changed") / F.sum("n")).alias("overall"))  # one row
    return by_class.crossJoin(F.broadcast(overall)).select(classes, "n", "changed", ((F.col("changed") + weight * F.col("overall")) / (F.col("n") + weight)).alias("rate"))


def weighted_rate(df: DataFrame, keys: Keys, hit: Column, weight: Column) -> DataFrame:
    """Weighted rate and the effective number of rows; equal weights give the plain count."""
    return df.groupBy(*keys).agg((F.sum(hit.cast("double") * weight) / F.sum(weight)).alias("rate"), (F.pow(F.sum(weight), F.lit(2)) / F.sum(weight * weight)).alias("n_effective"))


def distribution(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """n, mean, quantiles with linear interpolation, and the largest."""
    at = [("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95)]
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *(F.percentile(value, F.lit(q)).alias(k) for k, q in at), F.max(value).alias("largest"))


def ranked(df: DataFrame, keys: Keys, score: str, ties: Keys, hit: str, width: float = 0.01) -> DataFrame:
    """Rows of ``df`` with ``seen``, their place in their key by descending score, ``right``, the hits so far, and ``best``, the largest precision from there on.

    A key is dealt to bins of ``width`` of the score: bins are counted first, rows are numbered inside
    them, and maxima are carried from bin to bin, so that no task holds a key and none looks at rows twice.
    """
    rows = settled(df.withColumn("_bin", F.coalesce(F.floor(F.col(score) / width), F.lit(-(1 << 62)))))
    cell = [*keys, "_bin"]

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*(F.col(c).alias(f"_to{c}") for c in cell), *(c for c in b.columns if c not in cell))
        return a.join(b, [F.col(c).eqNullSafe(F.col(f"_to{c}")) for c in cell]).drop(*(f"_to{c}" for c in cell))

    earlier = W.Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(W.Window.unboundedPreceding, -1)
    sums = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.sum(hit).alias("_h"))
    starts = sums.select(*cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_h").over(earlier), F.lit(0)).alias("_h0"))
    down = W.Window.partitionBy(*cell).orderBy(F.desc(score), *ties)
    rows = met(rows, starts).withColumn("seen", F.col("_n0") + F.row_number().over(down)).withColumn("right", F.col("_h0") + F.sum(hit).over(down.rowsBetween(W.Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_p", F.col("right") / F.col("seen"))
    later = W.Window.partitionBy(*keys).orderBy("_bin").rowsBetween(W.Window.unboundedPreceding, -1)
    tops = rows.groupBy(*cell).agg(F.max("_p").alias("_top")).withColumn("_beyond", F.max("_top").over(later)).drop("_top")
    back = W.Window.partitionBy(*cell).orderBy(F.desc("seen")).rowsBetween(W.Window.unboundedPreceding, 0)
    return met(rows, tops).withColumn("best", F.greatest(F.max("_p").over(back), "_beyond")).drop("_bin", "_n0", "_h0", "_p", "_beyond")


def average_precision(df: DataFrame, keys: Keys, score: str, row_id: str, hit: Column, points: int = 101) -> DataFrame:
    """Area under precision by recall, the best precision at or beyond each of ``points`` recalls; -1 without positives."""
    flagged = df.withColumn("_hit", hit.cast("int"))
    totals = flagged.groupBy(*keys).agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("_all"))
    rows = ranked(flagged.select(*keys, score, row_id, "_hit"), keys, score, [row_id], "_hit").where("_hit = 1").select(*(F.col(k).alias(f"_to{k}") for k in keys), "right", "best")
    rows = totals.join(rows, [F.col(k).eqNullSafe(F.col(f"_to{k}")) for k in keys], "left")
    # A positive carries the recalls it is the first to reach.
    steps = F.floor(F.col("right") * (points - 1) / F.col("_all")) - F.floor((F.col("right") - 1) * (points - 1) / F.col("_all")) + F.when(F.col("right") == 1, 1).otherwise(0)
    return rows.groupBy(*keys).agg(F.when(F.max("_all") > 0, F.sum(F.col("best") * steps) / points).otherwise(-1.0).alias("ap"))


def gate(candidate: DataFrame, baseline: DataFrame, keys: Keys, value: str, tolerance: float) -> DataFrame:
    """Whether each of the candidate's figures holds against the baseline's; figures the baseline lacks pass."""
    old = baseline.select(*keys, F.col(value).alias("baseline"))
    return candidate.join(old, list(keys), "left").withColumn("passed", F.coalesce(F.col(value) >= F.col("baseline") - tolerance, F.lit(True)))
