"""Collecting reviews from streams: results meet the tasks that were sent, each task is decided once, and what a batch writes it writes once.

The decision of a task, collected or revoked, is state of a keyed processor; it needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``), which the caller's session chooses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DECISIONS = "task string, event_id string, kind string, reviewer string, at timestamp, outcome string"


def met_results(sent: DataFrame, results: DataFrame, late: str, longest: str) -> DataFrame:
    """Results with the task they answer: ``task``, ``event_id``, ``reviewer``, ``at`` and, from ``sent`` (``task``, ``assignee``, ``sent_at``), whether it is ``theirs``.

    Both sides may come up to ``late`` late; a result counts if its task was sent at most ``longest`` before. So either side's rows are
    held only that long. A task without an assignee is anyone's.
    """
    tasks = sent.select(F.col("task").alias("_task"), "assignee", "sent_at").withWatermark("sent_at", late)
    answers = results.withWatermark("at", late)
    on = (F.col("task") == F.col("_task")) & (F.col("at") >= F.col("sent_at")) & (F.col("at") <= F.col("sent_at") + F.expr(f"interval {longest}"))
    theirs = F.col("assignee").isNull() | F.col("assignee").eqNullSafe(F.col("reviewer"))
    return answers.join(tasks, on).select(*results.columns, theirs.alias("theirs"), "sent_at")


def unanswered(sent: DataFrame, results: DataFrame, late: str, longest: str) -> DataFrame:
    """Tasks that no result came for in time; they come out once the clocks of both streams say that none can."""
    tasks = sent.select("task", "assignee", "sent_at").withWatermark("sent_at", late)
    answers = results.select(F.col("task").alias("_task"), "at").withWatermark("at", late)
    on = (F.col("task") == F.col("_task")) & (F.col("at") >= F.col("sent_at")) & (F.col("at") <= F.col("sent_at") + F.expr(f"interval {longest}"))
    return tasks.join(answers, on, "left_outer").where("_task is null").select("task", "assignee", "sent_at")


class _Decide(StatefulProcessor):
    """The first valid event of a task decides it: a result collects it, a revocation revokes it. What comes later is said to be again, late or refused."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("decision", "outcome string, event_id string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        decision = self.held.get() if self.held.exists() else None
        before, out = decision, []
        for row in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples(index=False):
            if row.kind == "result" and not row.theirs:
                outcome = "refused"
            elif decision is None:
                outcome = "collected" if row.kind == "result" else "revoked"
                decision = (outcome, row.event_id)
            elif row.event_id == decision[1]:
                outcome = "again"  # delivered twice
            else:
                outcome = "late"
            out.append((key[0], row.event_id, row.kind, row.reviewer, row.at, outcome))
        if decision is not before:
            self.held.update(decision)
        yield pd.DataFrame(out, columns=["task", "event_id", "kind", "reviewer", "at", "outcome"])

    def close(self) -> None:
        pass


def decisions(events: DataFrame) -> DataFrame:
    """``outcome`` of each event (``task``, ``event_id``, ``kind`` result or revoke, ``reviewer``, ``theirs``, ``at``): collected, revoked, again, late or refused. A task is decided once, however many batches its events come in."""
    return events.groupBy("task").transformWithStateInPandas(statefulProcessor=_Decide(), outputStructType=DECISIONS, outputMode="append", timeMode="none")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def once(target: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that may be called again with a batch: its rows replace what this batch had written, and rows whose ``keys`` an earlier batch has written are left out.

    The target, a Parquet folder by ``batch``, is its own ledger. A batch sees only batches before it, so replaying one
    gives what it gave at first, whatever came after.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        rows = df.withColumn("_first", F.struct(*(c for c in df.columns if c not in keys)))
        fresh = rows.groupBy(*keys).agg(F.min("_first").alias("_first")).select(*keys, "_first.*").select(*df.columns)
        if _exists(spark, target):
            earlier = spark.read.option("basePath", target).schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema if f.name in keys)}, batch long").parquet(target)
            fresh = fresh.join(earlier.where(F.col("batch") < batch).select(*keys).distinct(), list(keys), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return write
