"""Relations from start to end: rules fire on facts, near ones merge, and what is on record is brought into line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import short_digest
from . import history, temporal
from .rules import Rule, derived

Keys = Sequence[str]
PAYLOAD = ["subject", "predicate", "object"]


def drafted(facts: DataFrame, rules: Sequence[Rule], session: str, start: str, end: str, fact_id: str, gap: int) -> DataFrame:
    """Relations that the facts give: those of one payload at most ``gap`` apart are one, as sure as its least sure part. ``base_id`` is made from session, payload and span."""
    rows = derived(facts, rules, [session, start, end, fact_id, "confidence"])
    whole = temporal.merged(rows, [session, *PAYLOAD], start, end, fact_id, gap, confidence=F.min("confidence"))
    base = F.concat(F.lit("rel-"), short_digest(F.concat_ws("|", F.col(session).cast("string"), *PAYLOAD, F.col(start).cast("string"), F.col(end).cast("string")), 16))
    return whole.select(session, *PAYLOAD, start, end, "confidence", base.alias("base_id"))


def aligned(drafts: DataFrame, records: DataFrame, derived_version: str) -> DataFrame:
    """``action`` and ``label_id`` that bring the records into line with the drafts; running it again then changes nothing.

    A draft on record and in force is kept. One that a human has corrected or taken away is skipped, for good. Any
    other is inserted, under its base id or, where that was used before, the base id and the number of times.
    A record in force that is derived, unreviewed and in no draft is retracted. ``derived_version`` starts
    the model version of derived records.
    """
    base = F.regexp_extract("label_id", r"^(rel-[0-9a-f]+)(-\d+)?$", 1)
    own = records.withColumn("base_id", base).where("base_id <> ''")
    live = history.current(records, "label_id", "parent_label_id", F.col("retracted")).select("label_id", F.lit(True).alias("_live"))
    touched = records.where("source = 'human' and parent_label_id is not null").select(F.col("parent_label_id").alias("label_id"), F.lit(True).alias("_touched")).distinct()
    known = own.join(live, "label_id", "left").join(touched, "label_id", "left")
    by_base = known.groupBy("base_id").agg(F.max("_live").alias("_live"), F.max("_touched").alias("_touched"), F.count(F.when(~F.col("retracted"), 1)).alias("_n"))
    rows = drafts.dropDuplicates(["base_id"]).join(by_base, "base_id", "left")
    action = F.when(F.col("_live"), "keep").when(F.col("_touched"), "skip").otherwise("insert")
    new_id = F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("base_id")).otherwise(F.concat_ws("-", "base_id", F.col("_n").cast("string")))
    wanted = rows.select(action.alias("action"), F.when(action == "insert", new_id).otherwise(F.col("base_id")).alias("label_id"))
    stale = known.where(F.col("_live") & (F.col("state") == "unreviewed") & F.coalesce(F.col("model_version").startswith(derived_version), F.lit(False)))
    stale = stale.join(drafts.select("base_id").distinct(), "base_id", "left_anti").select(F.lit("retract").alias("action"), "label_id")
    return wanted.unionByName(stale)
