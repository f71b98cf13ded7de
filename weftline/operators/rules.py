"""Declarative rules over facts: each rule lists allowed values per field and what to derive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled


@dataclass(frozen=True)
class Rule:
    """When each field of ``when`` has one of its values (None stands for a missing one), derive ``predicate`` between two filled templates."""

    name: str
    when: Mapping[str, Sequence] = field(default_factory=dict)
    predicate: str = ""
    subject: str = ""
    object: str = ""


def matches(rule: Rule) -> Column:
    out = F.lit(True)
    for name, allowed in rule.when.items():
        known = [v for v in allowed if v is not None]
        ok = F.col(name).isin(known) if known else F.lit(False)
        out = out & (F.coalesce(ok, F.lit(False)) | (F.col(name).isNull() if None in allowed else F.lit(False)))
    return out


def derived(facts: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """A row per fact and rule that fires, in one scan; a template with a missing field derives nothing."""
    fields = {c: F.col(c) for c in facts.columns}
    fired = [F.when(matches(r), F.struct(F.lit(r.name).alias("rule"), filled(r.subject, fields).alias("subject"), F.lit(r.predicate).alias("predicate"), filled(r.object, fields).alias("object"))) for r in rules]
    rows = facts.select(*keep, F.explode(F.array_compact(F.array(*fired))).alias("d")).select(*keep, "d.*")
    return rows.where("subject is not null and object is not null")


def coverage(touches: DataFrame, keys: Sequence[str], x: str, y: str, width: float, height: float, cells: int) -> DataFrame:
    """Share of a surface's raster cells that points touch; points outside don't count."""
    inside = (F.col(x) >= 0) & (F.col(x) < width) & (F.col(y) >= 0) & (F.col(y) < height)
    cell = F.floor(F.col(y) / (height / cells)) * cells + F.floor(F.col(x) / (width / cells))
    touched = touches.where(inside).select(*keys, cell.alias("cell")).distinct()
    return touched.groupBy(*keys).agg((F.count("*") / float(cells * cells)).alias("coverage"))
