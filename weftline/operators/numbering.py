"""Numbers in order over a whole table, without one task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .settled import settled


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, first: int = 1, falling: Sequence[int] = ()) -> DataFrame:
    """Adds ``name``: ``first`` for the first row in ``order`` and one more for each row after it. The columns of ``order`` at the places in ``falling`` go down, nulls last; others go up, nulls first.

    Rows that are equal in all of ``order`` come in any order.
    """
    keys = [f"_key{i}" for i in range(len(order))]
    rows = df.withColumns({k: F.col(c) if isinstance(c, str) else c for k, c in zip(keys, order, strict=True)})
    return numbered_by(rows, [F.desc(k) if i in falling else F.asc(k) for i, k in enumerate(keys)], name, first).drop(*keys)


def numbered_by(df: DataFrame, sides: Sequence[Column], name: str, first: int = 1) -> DataFrame:
    """The same with the order as sort columns (``F.asc``, ``F.desc``).

    Rows are dealt to ranges of the order, sorted there and written once with their place in the range; a number is that place and the number of
    rows in the ranges before, of which there is one figure each. So rows are shuffled once.
    """
    # An id has the range above its lowest 33 bits and the place in it below.
    rows = settled(df.repartitionByRange(*sides).sortWithinPartitions(*sides).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.Window.orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before")))  # one row a range
    return rows.join(starts, "_range").withColumn(name, F.col("_before") + F.col("_at") + first).drop("_range", "_before", "_id", "_at")
