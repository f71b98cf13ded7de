"""Scores of sessions from terms that anyone may register.

A term built from columns gives the contribution of one pending label; Spark sums it. A term of
rows is a class that sees a session's labels in order and says what they add, for what no column can say; all
such terms of a score run in one table function, partitioned by session. Both are switched on by name and weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import window as W


class RowTerm(Protocol):
    """One of these is made for each session."""

    def add(self, row: Row) -> float:
        """What the label, the next in order, contributes."""
        ...


#: Makers of a column from a policy, and of row terms.
COLUMN_TERMS: dict[str, Callable[[Mapping], Column]] = {}
ROW_TERMS: dict[str, Callable[[Mapping], RowTerm]] = {}


def _add(where: dict, name: str):
    def register(maker):
        if name in COLUMN_TERMS or name in ROW_TERMS:
            raise ValueError(f"there is a term {name} already")
        where[name] = maker
        return maker

    return register


def register_term(name: str):
    """Decorates a function from a policy to a column over label rows (with ``rate``, that of the label's class)."""
    return _add(COLUMN_TERMS, name)


def register_row_term(name: str):
    """Decorates a function, or class, from a policy to a :class:`RowTerm`."""
    return _add(ROW_TERMS, name)


@register_term("correction_rate")
def correction_rate(policy: Mapping) -> Column:
    """Corrections to be expected: labels of classes without a rate have the policy's ``default_rate``."""
    return F.coalesce(F.col("rate"), F.lit(float(policy.get("default_rate", 0.0))))


@register_term("uncertainty")
def uncertainty(policy: Mapping) -> Column:
    """What confidence leaves to 1; labels without one count as sure."""
    return 1.0 - F.coalesce(F.col("confidence").cast("double"), F.lit(1.0))


@register_row_term("novelty")
class Novelty:
    """1 for the first label of a class in its session, and half as much each time again."""

    def __init__(self, policy: Mapping) -> None:
        self.seen: dict[str, int] = {}

    def add(self, row: Row) -> float:
        n = self.seen[row["class"]] = self.seen.get(row["class"], 0) + 1
        return 0.5 ** (n - 1)


def build_terms(weights: Mapping[str, float], policy: Mapping) -> tuple[dict[str, Column], dict[str, Callable[[], RowTerm]]]:
    """Columns and makers of row terms by name, in the order of the weights."""
    if unknown := sorted(set(weights) - set(COLUMN_TERMS) - set(ROW_TERMS)):
        raise ValueError(f"no such terms: {unknown}; there are {sorted([*COLUMN_TERMS, *ROW_TERMS])}")
    return {n: COLUMN_TERMS[n](policy) for n in weights if n in COLUMN_TERMS}, {n: (lambda m=ROW_TERMS[n]: m(policy)) for n in weights if n in ROW_TERMS}


def row_contributions(labels: DataFrame, session: str, order: Sequence[str], makers: Mapping[str, Callable[[], RowTerm]]) -> DataFrame:
    """``session``, ``class``, ``term`` and ``value``: each session's labels pass in order through its row terms, and values are summed by class."""
    kind, named = labels.schema[session].dataType.simpleString(), dict(makers)

    class Terms:
        def __init__(self) -> None:
            self.terms, self.sums, self.session = {n: m() for n, m in named.items()}, {}, None

        def eval(self, row: Row) -> None:
            self.session = row[session]
            for n, t in self.terms.items():
                key = (row["class"], n)
                self.sums[key] = self.sums.get(key, 0.0) + float(t.add(row))

        def terminate(self) -> Iterator[tuple]:
            for (kind, n), v in self.sums.items():
                yield self.session, kind, n, v

    table = F.udtf(Terms, returnType=f"{session} {kind}, class string, term string, value double")
    return table(labels.asTable().partitionBy(session).orderBy(*order))


def contributions(labels: DataFrame, rates: DataFrame, session: str, order: Sequence[str], weights: Mapping[str, float], policy: Mapping) -> DataFrame:
    """What each class adds to each term of each session: ``session``, ``class``, ``term``, ``value``. ``labels`` have ``class`` and ``confidence``; ``rates`` have ``class`` and ``rate``, one row a class."""
    columns, makers = build_terms(weights, policy)
    rated = labels.join(rates.select("class", "rate"), "class", "left")
    out = None
    if columns:
        sums = rated.groupBy(session, "class").agg(*(F.sum(c).alias(n) for n, c in columns.items()))
        pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("term"), F.col(n).alias("value")) for n in columns))).alias("_x")
        out = sums.select(session, "class", pairs).select(session, "class", "_x.term", "_x.value")
    if makers:
        rows = row_contributions(rated, session, order, makers)
        out = rows if out is None else out.unionByName(rows)
    return out


def session_scores(parts: DataFrame, session: str, weights: Mapping[str, float], sizes: DataFrame | None = None, size: str = "minutes") -> DataFrame:
    """``score``: the weighted sum of :func:`contributions`, divided by the session's ``size`` (null at 0) if ``sizes`` are given, and each term's own sum as a column."""
    weight = F.coalesce(*(F.when(F.col("term") == n, float(w)) for n, w in weights.items()))
    sums = parts.groupBy(session).agg(*(F.coalesce(F.sum(F.when(F.col("term") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in weights), F.sum(weight * F.col("value")).alias("score"))
    if sizes is None:
        return sums
    return sums.join(sizes.select(session, size), session, "left").withColumn("score", F.col("score") / F.nullif(F.col(size).cast("double"), F.lit(0.0))).drop(size)


def explained(parts: DataFrame, session: str, weights: Mapping[str, float], most: int) -> DataFrame:
    """The ``most`` classes that add most to each session's score, with their ``place``; a report."""
    weight = F.coalesce(*(F.when(F.col("term") == n, float(w)) for n, w in weights.items()))
    sums = parts.groupBy(session, "class").agg(F.sum(weight * F.col("value")).alias("value"))
    line = W.Window.partitionBy(session).orderBy(F.desc("value"), "class")
    return sums.withColumn("place", F.row_number().over(line)).where(F.col("place") <= most)
