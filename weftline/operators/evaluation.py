"""Evaluation of all tasks by subgroups, and dataset versions, each in one call.

An evaluator gives figures of every session that add up; groups of sessions are sums of these, so a
session is compared once however many groups it is in. What doesn't add up, average precision, is
taken from rows with the group as a key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins, matching, metrics, segments, splits, temporal

OVERALL = "overall"
#: Makes figures (``group``, ``metric``, ``value``) from the groups of sessions (``session``, ``group``).
Evaluator = Callable[[DataFrame], DataFrame]


def grouped(sessions: DataFrame, axes: Sequence[str]) -> DataFrame:
    """``session`` and ``group``: overall, and for each axis ``axis=value``, with "unknown" for a null."""
    names = [F.lit(OVERALL), *(F.concat(F.lit(f"{a}="), F.coalesce(F.col(a).cast("string"), F.lit("unknown"))) for a in axes)]
    return sessions.select("session", F.explode(F.array(*names)).alias("group")).distinct()


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _figures(df: DataFrame, /, **values: Column) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()))).alias("_x")
    return df.select("group", pairs).select("group", "_x.metric", "_x.value").where("value is not null")


def classification(pairs: DataFrame, truth: str = "truth", guess: str = "guess", confidence: str | None = None, bins: int = 15) -> Evaluator:
    """Of paired rows (``session``): accuracy, macro F1, kappa, F1 of each class as ``f1/class``, and the expected calibration error where there is a confidence."""

    def run(groups: DataFrame) -> DataFrame:
        cells = metrics.confusion(pairs, ["session"], truth, guess).join(groups, "session").groupBy("group", truth, guess).agg(F.sum("n").alias("n"))
        side = lambda c, name: cells.groupBy("group", F.col(c).alias("class")).agg(F.sum("n").alias(name))
        right = cells.where(F.col(truth) == F.col(guess)).select("group", F.col(truth).alias("class"), F.col("n").alias("hits"))
        classes = side(truth, "t").join(side(guess, "g"), ["group", "class"], "full_outer").join(right, ["group", "class"], "left").fillna(0, ["t", "g", "hits"])
        classes = classes.withColumn("f1", _share(2 * F.col("hits"), F.col("t") + F.col("g")))
        sums = classes.groupBy("group").agg(F.sum("hits").alias("hits"), F.sum("t").alias("n"), F.avg("f1").alias("macro"), F.sum(F.col("t") * F.col("g")).alias("chance"))
        observed, chance = F.col("hits") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
        out = _figures(sums, accuracy=observed, macro_f1=F.col("macro"), kappa=F.when(chance < 1, (observed - chance) / (1 - chance)), rows=F.col("n"))
        out = out.unionByName(classes.select("group", F.concat(F.lit("f1/"), F.col("class").cast("string")).alias("metric"), F.col("f1").alias("value")))
        if confidence is None:
            return out
        place = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
        held = pairs.groupBy("session", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(confidence)).alias("c"), F.sum((F.col(truth) == F.col(guess)).cast("int")).alias("h"))
        held = held.join(groups, "session").groupBy("group", "bin").agg(*(F.sum(x).alias(x) for x in "nch"))
        ece = held.groupBy("group").agg((F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("e"))
        return out.unionByName(_figures(ece, calibration_error=F.col("e")))

    return run


def intervals(truth: DataFrame, found: DataFrame, keys: Sequence[str], threshold: float, tolerance: int, width: int) -> Evaluator:
    """Of intervals (``session``, ``start``, ``end``, ``id``, further ``keys``): segment F1 at an overlap, F1 of their edges within a tolerance, and the shared part of the time that either covers."""
    own = ["session", *keys]

    def run(groups: DataFrame) -> DataFrame:
        add = lambda df, *names: df.groupBy("session").agg(*(F.sum(n).alias(n) for n in names)).join(groups, "session").groupBy("group").agg(*(F.sum(n).alias(n) for n in names))
        whole = add(segments.segment_f1(truth, found, own, threshold, width), "tp", "fp", "fn")
        edges = add(matching.event_matches(segments.boundaries(truth, own), segments.boundaries(found, own), own, "at", tolerance), "hits", "misses", "false_alarms")
        flat = lambda df, x: temporal.merged(df, own, "start", "end", "id").where("end > start").select(*own, F.col("start").alias(f"{x}s"), F.col("end").alias(f"{x}e"))
        a, b = flat(truth, "t"), flat(found, "p")
        both = joins.overlaps(a, b, own, ("ts", "te"), ("ps", "pe"), width).select("session", F.col("overlap").alias("shared"), F.lit(0).cast("long").alias("covered"))
        lengths = [df.select("session", F.lit(0).cast("long").alias("shared"), (F.col(f"{x}e") - F.col(f"{x}s")).alias("covered")) for df, x in ((a, "t"), (b, "p"))]
        time = add(both.withColumn("shared", F.col("shared").cast("long")).unionByName(lengths[0]).unionByName(lengths[1]), "shared", "covered")
        out = _figures(whole, segment_f1=_share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), segments=F.col("tp") + F.col("fn"))
        out = out.unionByName(_figures(edges, boundary_f1=_share(2 * F.col("hits"), 2 * F.col("hits") + F.col("misses") + F.col("false_alarms"))))
        return out.unionByName(_figures(time, time_iou=_share(F.col("shared"), F.col("covered") - F.col("shared"))))

    return run


def ranking(rows: DataFrame, score: str, row_id: str, hit: Column, points: int = 101) -> Evaluator:
    """Average precision of scored rows (``session``)."""

    def run(groups: DataFrame) -> DataFrame:
        ap = metrics.average_precision(rows.join(groups, "session"), ["group"], score, row_id, hit, points)
        return _figures(ap.where("ap >= 0"), average_precision=F.col("ap"))

    return run


def evaluate(sessions: DataFrame, axes: Sequence[str], tasks: Mapping[str, Evaluator]) -> DataFrame:
    """``task``, ``group``, ``metric``, ``value`` of all tasks over all sessions and over each value of each axis; groups without data have no rows."""
    groups, out = grouped(sessions, axes), None
    for name, run in tasks.items():
        rows = run(groups).select(F.lit(name).alias("task"), "group", "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def gated(report: DataFrame, baseline: DataFrame, rules: DataFrame, tolerance: float) -> DataFrame:
    """Rules (``task``, ``metric``, ``least``) on each group of a report: the figure, the baseline's, and whether it is high enough and no more than ``tolerance`` below. A rule without a figure overall fails."""
    figures = report.join(rules, ["task", "metric"])
    held = metrics.gate(figures, baseline, ["task", "group", "metric"], "value", tolerance).withColumn("passed", F.col("passed") & (F.col("value") >= F.col("least")))
    missing = rules.join(report.where(F.col("group") == OVERALL).select("task", "metric"), ["task", "metric"], "left_anti")
    lost = missing.select("task", F.lit(OVERALL).alias("group"), "metric", F.lit(None).cast("double").alias("value"), "least", F.lit(None).cast("double").alias("baseline"), F.lit(False).alias("passed"))
    return held.select(lost.columns).unionByName(lost)


def dataset_version(labels: DataFrame, sessions: DataFrame, usable: Column, version: str, seed: int, shares: Mapping[str, float]) -> dict[str, DataFrame]:
    """A version of a dataset from current labels (``label_id``, ``session``, ``kind``, ``state``) and sessions (``session``, ``worker``, ``site``).

    ``items``: the usable labels with their split; sessions that share a worker or a site, directly or through others, are on one
    side. ``counts`` by split, kind and state. ``leaks``: workers or sites on several sides, none if all is well. ``manifest``: one row with the
    numbers and a digest of all (label, split) pairs, whatever their order.
    """
    chosen = labels.where(usable)
    with_labels = sessions.join(chosen.select("session").distinct(), "session", "left_semi")
    groups = splits.linked_groups(with_labels, "worker", "site")
    sides = splits.assigned(with_labels.join(groups, ["worker", "site"]), "group", seed, dict(shares)).select("session", "worker", "site", "split")
    items = chosen.join(sides.select("session", "split"), "session").select("label_id", "session", "kind", "state", "split")
    counts = items.groupBy("split", "kind", "state").agg(F.count(F.lit(1)).alias("n"))
    shared = [sides.select(F.lit(c).alias("by"), F.col(c).cast("string").alias("value"), "split") for c in ("worker", "site")]
    leaks = shared[0].unionByName(shared[1]).groupBy("by", "value").agg(F.count_distinct("split").alias("splits")).where("splits > 1")
    # Sums of two halves of digests don't depend on the order of rows.
    digest = F.sha2(F.concat_ws("|", F.col("label_id").cast("string"), "split"), 256)
    half = lambda i: F.sum(F.conv(F.substring(digest, i, 12), 16, 10).cast("decimal(20,0)"))
    manifest = items.agg(F.count(F.lit(1)).alias("labels"), F.count_distinct("session").alias("sessions"), F.sha2(F.concat_ws("|", half(1).cast("string"), half(13).cast("string")), 256).alias("digest"))
    return {"items": items, "counts": counts, "leaks": leaks, "manifest": manifest.select(F.lit(version).alias("version"), F.lit(seed).alias("seed"), "*")}
