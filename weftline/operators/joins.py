"""Joins in time: as-of in three directions, interpolating, overlapping intervals; and comparing two versions of a table.

As-of joins are one union, one shuffle by key and one running window: no side is
broadcast and no pairs are enumerated. Interval joins meet in bins of a chosen width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

Keys = Sequence[str]


def _lined_up(left: DataFrame, right: DataFrame, keys: Keys, time: str, left_id: str, right_id: str, values: Keys) -> DataFrame:
    """Both sides in one table: ``_side`` 0 for right rows, 1 for left ones; right rows carry ``_got``."""
    got = F.struct(F.col(time).alias("t"), F.col(right_id).alias("id"), *(F.col(v) for v in values))
    kind = right.select(got.alias("g")).schema["g"].dataType
    a = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(right_id).cast("string").alias("_id"), got.alias("_got"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_row"))
    b = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.col(left_id).cast("string").alias("_id"), F.lit(None).cast(kind).alias("_got"), F.struct("*").alias("_row"))
    return a.unionByName(b)


def asof(left: DataFrame, right: DataFrame, keys: Keys, time: str, left_id: str, right_id: str, values: Keys, direction: str = "backward", within: Column | float | None = None, ordered: Column | None = None) -> DataFrame:
    """Each left row with ``values`` of the right row that is latest at or before it (``backward``), earliest at or after it (``forward``) or ``nearest`` in its key; ties of nearest go to the earlier one.

    The right row's time comes as ``match_time`` and its id as ``match_id``; all are null
    without a match, or if it lies further than ``within``. Of right rows at one time the
    backward join takes the one of greatest id, the forward join that of least.
    """
    lined = _lined_up(left, right, keys, time, left_id, right_id, values)
    back = W.Window.partitionBy(*keys).orderBy("_t", "_side", F.col("_got.id"), "_id").rowsBetween(W.Window.unboundedPreceding, 0)
    ahead = W.Window.partitionBy(*keys).orderBy(F.desc("_t"), F.asc("_side"), F.desc(F.col("_got.id")), F.asc("_id")).rowsBetween(W.Window.unboundedPreceding, 0)
    past, future = F.last("_got", ignorenulls=True).over(back), F.last("_got", ignorenulls=True).over(ahead)
    far = lambda g: F.abs(g["t"].cast("double") - F.col("_t").cast("double"))
    rows = lined.withColumn("_p", past if direction != "forward" else F.lit(None).cast(lined.schema["_got"].dataType))
    rows = rows.withColumn("_f", future if direction != "backward" else F.lit(None).cast(lined.schema["_got"].dataType))
    pick = {"backward": F.col("_p"), "forward": F.col("_f"), "nearest": F.when(F.col("_f").isNull() | (far(F.col("_p")) <= far(F.col("_f"))), F.col("_p")).otherwise(F.col("_f"))}[direction]
    rows = rows.where("_side = 1").withColumn("_m", pick)
    if within is not None:
        rows = rows.withColumn("_m", F.when(far(F.col("_m")) <= within, F.col("_m")))
    return rows.select("_row.*", F.col("_m.t").alias("match_time"), F.col("_m.id").alias("match_id"), *(F.col(f"_m.{v}").alias(v) for v in values))


def interpolated(grid: DataFrame, samples: DataFrame, keys: Keys, time: str, grid_id: str, sample_id: str, value: str, most_gap: float, rule: str = "spacing") -> DataFrame:
    """Each grid row with ``value`` interpolated between the samples around it; an exact hit wins.

    ``rule``: the neighbours lie at most ``most_gap`` apart (``spacing``), or the nearer one
    lies within it (``nearer``), where outside the samples the end sample is held.
    """
    lined = _lined_up(grid, samples, keys, time, grid_id, sample_id, [value])
    back = W.Window.partitionBy(*keys).orderBy("_t", "_side", F.col("_got.id"), "_id").rowsBetween(W.Window.unboundedPreceding, 0)
    ahead = W.Window.partitionBy(*keys).orderBy(F.desc("_t"), F.asc("_side"), F.desc(F.col("_got.id")), F.asc("_id")).rowsBetween(W.Window.unboundedPreceding, 0)
    rows = lined.withColumn("_p", F.last("_got", ignorenulls=True).over(back)).withColumn("_f", F.last("_got", ignorenulls=True).over(ahead)).where("_side = 1")
    t, p, f = F.col("_t").cast("double"), F.col("_p"), F.col("_f")
    pt, ft, pv, fv = p["t"].cast("double"), f["t"].cast("double"), p[value].cast("double"), f[value].cast("double")
    line = pv + (fv - pv) * (t - pt) / (ft - pt)
    if rule == "spacing":
        between = F.when(ft - pt <= most_gap, line)
    else:
        near = F.least(F.coalesce(t - pt, ft - t), F.coalesce(ft - t, t - pt))
        between = F.when(near <= most_gap, F.when(pt.isNull(), fv).when(ft.isNull(), pv).otherwise(line))
    return rows.select("_row.*", F.when(pt == t, pv).when(ft == t, fv).otherwise(between).alias(value))


def overlaps(left: DataFrame, right: DataFrame, keys: Keys, left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of one key whose intervals share more than a point, with ``overlap``, its length. Column names of the two sides differ, but for the keys.

    Both sides are dealt to bins of ``width``; a pair comes from the bin where the later of
    its starts lies, so it comes once. Take a width near the median length.
    """
    (ls, le), (rs, re) = left_span, right_span
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    a = left.where(F.col(le) > F.col(ls)).withColumn("_bin", bins(ls, le))
    b = right.where(F.col(re) > F.col(rs)).withColumn("_bin", bins(rs, re))
    both = a.join(b, [*keys, "_bin"]).where((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.col("_bin") == F.floor(F.greatest(ls, rs) / width)))
    return both.withColumn("overlap", F.least(le, re) - F.greatest(ls, rs)).drop("_bin")


def longest_overlap(left: DataFrame, right: DataFrame, keys: Keys, left_id: str, left_span: tuple[str, str], right_id: str, right_span: tuple[str, str], width: int) -> DataFrame:
    """Each left interval with the right one it overlaps longest; of equals the greater id."""
    pairs = overlaps(left, right, keys, left_span, right_span, width)
    return pairs.groupBy(*keys, left_id).agg(F.max(F.struct("overlap", right_id)).alias("m")).select(*keys, left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.overlap").alias("overlap"))


def compared(before: DataFrame, after: DataFrame, keys: Keys, values: Keys) -> DataFrame:
    """``outcome`` of each key: added, deleted, corrected or accepted. Nulls equal nulls."""
    a = before.select(*keys, F.struct(*values).alias("_before"), F.lit(True).alias("_in_before"))
    b = after.select(*keys, F.struct(*values).alias("_after"), F.lit(True).alias("_in_after"))
    outcome = F.when(F.col("_in_before").isNull(), "added").when(F.col("_in_after").isNull(), "deleted").when(F.col("_before").eqNullSafe(F.col("_after")), "accepted").otherwise("corrected")
    return a.join(b, list(keys), "full_outer").withColumn("outcome", outcome).drop("_in_before", "_in_after")


def upserts(existing: DataFrame, desired: DataFrame, keys: Keys, values: Keys, protected: Column) -> DataFrame:
    """What makes ``existing`` as ``desired``: ``action`` insert, retract or keep per key. ``protected`` existing rows are never touched nor added again."""
    marked = existing.select(*keys, *values, protected.alias("_protected"))
    diff = compared(marked.drop("_protected"), desired, keys, values).join(marked.select(*keys, "_protected"), list(keys), "left")
    action = F.when(F.col("_protected"), "keep").when(F.col("outcome") == "added", "insert").when(F.col("outcome") == "deleted", "retract").when(F.col("outcome") == "corrected", "replace").otherwise("keep")
    return diff.select(*keys, action.alias("action"))
