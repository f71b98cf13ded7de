"""Scores of intervals and transitions: segment F1, temporal average precision, boundaries, agreement.

Intervals are ``start``, ``end`` and a class within a key (a recording, a hand). Pairs come from the
overlap join; only greedy matching with second choices runs in Python, over sorted pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import StructType

from . import joins, matching, metrics, temporal
from .streamed import streamed, with_rivals

Keys = Sequence[str]


def _iou(s1: str, e1: str, s2: str, e2: str) -> Column:
    return F.col("overlap") / (F.greatest(e1, e2) - F.least(s1, s2))


def f1(hits: Column, truths: Column, finds: Column) -> Column:
    """Twice the hits over all of both sides; 0 where both are empty."""
    return F.when(truths + finds > 0, 2 * hits / (truths + finds)).otherwise(0.0)


def overlapping(truth: DataFrame, found: DataFrame, keys: Keys, width: int) -> DataFrame:
    """Pairs that overlap, with ``iou``: columns ``t_`` of the truth (id, start, end) and ``p_`` of the find (id, start, end, and ``score`` if it has one)."""
    side = lambda df, x: df.select(*keys, *(F.col(c).alias(f"{x}_{c}") for c in df.columns if c not in keys))
    pairs = joins.overlaps(side(found, "p"), side(truth, "t"), keys, ("p_start", "p_end"), ("t_start", "t_end"), width)
    return pairs.withColumn("iou", _iou("p_start", "p_end", "t_start", "t_end"))


def segment_f1(truth: DataFrame, found: DataFrame, keys: Keys, threshold: float, width: int) -> DataFrame:
    """``tp``, ``fp``, ``fn`` and ``f1`` per key, the class among the keys.

    A find goes for the truth it overlaps best, the earliest of equals; it hits if that reaches the
    threshold and no earlier find took it. It has no second choice, so the hits are the truths that are
    any find's best.
    """
    best = overlapping(truth, found, keys, width).groupBy(*keys, "p_id").agg(F.max(F.struct("iou", (-F.col("t_start")).alias("s"), (-F.col("t_end")).alias("e"), (-F.col("t_id")).alias("id"))).alias("b"))
    hits = best.where(F.col("b.iou") >= threshold).groupBy(*keys).agg(F.count_distinct("b.id").alias("tp"))
    sizes = truth.select(*keys, F.lit(1).alias("t"), F.lit(0).alias("p")).unionAll(found.select(*keys, F.lit(0).alias("t"), F.lit(1).alias("p"))).groupBy(*keys).agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    tp = F.coalesce("tp", F.lit(0))
    return sizes.join(hits, list(keys), "left").select(*keys, tp.alias("tp"), (F.col("p") - tp).alias("fp"), (F.col("t") - tp).alias("fn"), f1(tp, F.col("t"), F.col("p")).alias("f1"))


def greedy(pairs: DataFrame, keys: Keys, order: Keys, left: str, right: str) -> DataFrame:
    """Of candidate pairs in ``order``, those whose sides are both still free."""

    def step(state: tuple | None, row: dict) -> tuple[tuple, list[dict]]:
        taken, used = state or (set(), set())
        if row[left] in taken or row[right] in used:
            return (taken, used), []
        taken.add(row[left]), used.add(row[right])
        return (taken, used), [{k: row[k] for k in (*keys, left, right)}]

    rows = pairs.select(*dict.fromkeys([*keys, *order, left, right]))
    return streamed(rows, keys, order, step, StructType([rows.schema[c] for c in (*keys, left, right)]))


def greedy_levels(pairs: DataFrame, keys: Keys, value: str, levels: Sequence[float], order: Keys, left: str, right: str, slack: float = 0.0, **columns: Column) -> DataFrame:
    """:func:`greedy` among the pairs whose ``value`` reaches a level, for each of ``levels`` as ``threshold``. ``columns`` are what ``order`` names.

    A pair whose sides have no other pair at the lowest level is free at all that it reaches; only the others are gone through in order.
    """
    floor = lambda t: F.least(t, F.lit(1 - slack)) if slack else t
    near = with_rivals(pairs.where(F.col(value) >= floor(F.lit(min(levels)))), keys, left, right, "_rivals")
    near = near.select(*keys, left, right, value, "_rivals", *(c.alias(k) for k, c in columns.items() if k not in pairs.columns))
    near = near.withColumn("threshold", F.explode(F.array(*map(F.lit, levels)))).where(F.col(value) >= floor(F.col("threshold")))
    free = near.where("not _rivals").select(*keys, "threshold", left, right)
    return free.unionByName(greedy(near.where("_rivals"), [*keys, "threshold"], order, left, right))


def temporal_precision(truth: DataFrame, found: DataFrame, group: str, kind: str, thresholds: Sequence[float], width: int) -> DataFrame:
    """Average precision per class and threshold. Finds, the best score first, take the free truth of their group that they overlap best."""
    cuts = F.explode(F.array(*map(F.lit, thresholds)))
    pairs = overlapping(truth, found, [group, kind], width)
    hits = greedy_levels(pairs, [group, kind], "iou", thresholds, ["worse", "p_id", "apart", "later"], "p_id", "t_id", worse=-F.col("p_score"), apart=-F.col("iou"), later=-F.col("t_id"))
    hits = hits.select(kind, "threshold", F.col("p_id").alias("id"), F.lit(1).alias("hit"))
    totals = truth.groupBy(kind).agg(F.count("*").alias("truths"))
    rows = found.select(kind, "id", "score").withColumn("threshold", cuts).join(hits, [kind, "threshold", "id"], "left").fillna({"hit": 0})
    sums = metrics.ranked(rows, [kind, "threshold"], "score", ["id"], "hit").groupBy(kind, "threshold").agg(F.sum(F.when(F.col("hit") == 1, F.col("best")).otherwise(0.0)).alias("area"))
    return totals.withColumn("threshold", cuts).join(sums, [kind, "threshold"], "left").select(kind, "threshold", (F.coalesce("area", F.lit(0.0)) / F.col("truths")).alias("ap"))


def temporal_map(precision: DataFrame, kind: str) -> DataFrame:
    """Mean over thresholds per class, and over classes with truths as ``overall``, from :func:`temporal_precision`."""
    by_class = precision.groupBy(kind).agg(F.avg("ap").alias("ap"))
    return by_class.select(kind, "ap", F.avg("ap").over(W.Window.partitionBy(F.lit(0))).alias("overall"))


def boundaries(intervals: DataFrame, keys: Keys, start: str = "start", end: str = "end") -> DataFrame:
    """Distinct times at which an interval starts or ends, as ``at``: touching intervals share one."""
    return intervals.select(*keys, F.explode(F.array(start, end)).alias("at")).distinct()


def boundary_agreement(truth: DataFrame, found: DataFrame, keys: Keys, tolerance: int, exclude_ends: bool = False) -> DataFrame:
    """Boundaries matched within a tolerance: hits, misses, false alarms and ``f1`` per key. ``exclude_ends`` leaves out the first and the last time of both sides together, which a timeline without gaps always hits."""
    a, b = boundaries(truth, keys), boundaries(found, keys)
    if exclude_ends:
        ends = a.unionAll(b).groupBy(*keys).agg(F.min("at").alias("_low"), F.max("at").alias("_high"))
        inner = lambda df: df.join(ends, list(keys)).where((F.col("at") > F.col("_low")) & (F.col("at") < F.col("_high"))).select(*keys, "at")
        a, b = inner(a), inner(b)
    return matching.event_matches(a, b, keys, "at", tolerance).withColumn("f1", f1(F.col("hits"), F.col("hits") + F.col("misses"), F.col("hits") + F.col("false_alarms")))


def transition_accuracy(truth: DataFrame, found: DataFrame, keys: Keys, time: str, row_id: str, value: str, tolerance: int) -> DataFrame:
    """Changes of state, matched within a tolerance where both values agree: ``accuracy`` is the share of true changes found, ``precision`` that of finds that are true; 1 where there is nothing to find."""
    moves = lambda df: temporal.transitions(df, keys, time, row_id, value).select(*keys, "before", F.col(value).alias("after"), time)
    rows = matching.event_matches(moves(truth), moves(found), [*keys, "before", "after"], time, tolerance)
    sums = rows.groupBy(keys[0]).agg(*(F.sum(c).alias(c) for c in ("hits", "misses", "false_alarms")))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    return sums.select(keys[0], "hits", share(F.col("hits"), F.col("hits") + F.col("misses")).alias("accuracy"), share(F.col("hits"), F.col("hits") + F.col("false_alarms")).alias("precision"))


def paired(a: DataFrame, b: DataFrame, keys: Keys, least_iou: float, width: int) -> DataFrame:
    """Intervals of two annotators paired within a key: each of ``a``, in order of its start, takes the free one of ``b`` it overlaps best; classes as ``a_class`` and ``b_class``."""
    pairs = overlapping(b, a, keys, width).where(F.col("iou") >= least_iou).withColumn("apart", -F.col("iou")).withColumn("later", -F.col("t_id"))
    chosen = greedy(pairs, keys, ["p_start", "p_end", "p_id", "apart", "later"], "p_id", "t_id")
    left, right = a.select(F.col("id").alias("p_id"), F.col("class").alias("a_class")), b.select(F.col("id").alias("t_id"), F.col("class").alias("b_class"))
    return chosen.join(left, "p_id").join(right, "t_id")


def agreement(a: DataFrame, b: DataFrame, keys: Keys, tolerance: int, least_iou: float, width: int) -> DataFrame:
    """Two annotators of the same keys: ``pairs``, ``kappa`` of the pairs' classes, ``segment_f1`` of key and class, ``boundary_f1`` of the key alone; one row for each key[0]."""
    group = keys[0]
    kappa = metrics.kappa(paired(a, b, keys, least_iou, width), [group], "a_class", "b_class").select(group, F.col("n").cast("long").alias("pairs"), "kappa")
    seg = segment_f1(a, b, [*keys, "class"], least_iou, width).groupBy(group).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    seg = seg.select(group, f1(F.col("tp"), F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")).alias("segment_f1"))
    edge = boundary_agreement(a.select(*keys, "start", "end"), b.select(*keys, "start", "end"), keys, tolerance).groupBy(group).agg(*(F.sum(c).alias(c) for c in ("hits", "misses", "false_alarms")))
    edge = edge.select(group, f1(F.col("hits"), F.col("hits") + F.col("misses"), F.col("hits") + F.col("false_alarms")).alias("boundary_f1"))
    return seg.join(edge, group, "full_outer").join(kappa, group, "left").fillna({"pairs": 0})


def prelabel_bias(model: DataFrame, standard: DataFrame, blind: DataFrame, keys: Keys, least_iou: float, width: int) -> DataFrame:
    """How much nearer ordinary review stays to the model's labels than blind review does: the difference of their segment F1 against the model, for each key[0]."""

    def near(side: DataFrame, name: str) -> DataFrame:
        sums = segment_f1(model, side, [*keys, "class"], least_iou, width).groupBy(keys[0]).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
        return sums.select(keys[0], f1(F.col("tp"), F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")).alias(name))

    return near(standard, "standard").join(near(blind, "blind"), keys[0]).withColumn("bias", F.col("standard") - F.col("blind"))
