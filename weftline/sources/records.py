"""Operational tables of an annotation shop: appended, never changed in place.

``TABLES`` names each table with its key and the columns its scans sort by. A row is fetched by
its key, scans filter by equality and by a half-open span of time, and a change is another row of
a state log that a view folds to the latest. A table that isn't there yet reads as None.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables


@dataclass(frozen=True)
class Table:
    """Key, order of scans, and the column that scans by time go by."""

    key: tuple[str, ...]
    order: tuple[str, ...]
    time: str | None = None


def _table(key: str, order: str = "", time: str | None = None) -> Table:
    keys = tuple(key.split())
    return Table(keys, tuple(order.split()) + keys, time)


TABLES = {
    "sessions": _table("session_id"),
    "label_records": _table("label_id", "created_at", "created_at"),
    "ontologies": _table("version"),
    "ai_review_runs": _table("run_id", "started_at", "started_at"),
    "ai_review_run_events": _table("event_id", "", "at"),
    "ai_review_units": _table("unit_id", "created_at", "created_at"),
    "ai_review_exposures": _table("task_key", "exposed_at", "exposed_at"),
    "ai_review_outcomes": _table("task_key", "recorded_at", "recorded_at"),
    "camera_calibrations": _table("camera_id registered_at"),
    "camera_assignments": _table("session_id assigned_at"),
    "hand_sizes": _table("record_id", "registered_at", "registered_at"),
    "hand_size_invalidations": _table("invalidation_id", "at", "at"),
    "description_inheritance": _table("label_id recorded_at"),
    "trajectory_inheritance": _table("label_id recorded_at"),
    "prelabel_stage_runs": _table("session_id stream_id stage model_version", "at", "at"),
    "privacy_detections": _table("session_id stream_id at", "at", "at"),
    "privacy_holds": _table("session_id at", "at", "at"),
    "dataset_versions": _table("version_id", "created_at", "created_at"),
    "dataset_split_assignments": _table("version_id session_id"),
    "golden_sets": _table("version", "created_at", "created_at"),
    "training_runs": _table("run_id", "started_at", "started_at"),
    "model_versions": _table("model_version", "created_at", "created_at"),
    "exports": _table("export_id", "created_at", "created_at"),
    "withdrawals": _table("withdrawal_id", "requested_at", "requested_at"),
    "raw_access_log": _table("event_id", "at", "at"),
    "review_work": _table("work_id", "recorded_at", "recorded_at"),
    "privacy_audits": _table("audit_id", "audited_at", "audited_at"),
    "retention_decisions": _table("decision_id", "decided_at", "decided_at"),
    "review_tasks": _table("task_key", "created_at", "created_at"),
    "review_assignments": _table("assignment_id", "created_at", "created_at"),
    "session_lifecycle_events": _table("event_id", "", "at"),
    "scene3d_records": _table("record_id", "created_at", "created_at"),
}


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The whole table, or None where nothing was ever appended."""
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def where(df: DataFrame, equal: Mapping[str, object], time: str | None = None, since: object = None, until: object = None) -> DataFrame:
    """Rows whose columns equal the given values (a list: any of them; None: no condition), in ``[since, until)``. The conditions reach the scan."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
    if since is not None:
        df = df.where(F.col(time) >= F.lit(since))
    return df if until is None else df.where(F.col(time) < F.lit(until))


def listed(spark: SparkSession, folder: str, name: str, since: object = None, until: object = None, **equal: object) -> DataFrame | None:
    """A scan in the table's order."""
    df = scan(spark, folder, name)
    return df if df is None else where(df, equal, TABLES[name].time, since, until).orderBy(*TABLES[name].order)


def fetched(spark: SparkSession, folder: str, name: str, *key: object) -> DataFrame | None:
    """The row of a key: one row, or none."""
    df = scan(spark, folder, name)
    return df if df is None else where(df, dict(zip(TABLES[name].key, key, strict=True)))


def appended(rows: DataFrame, folder: str, name: str, checks: Mapping[str, Column] | None = None) -> int:
    """Append the rows whose key the table lacks, after ``checks``: how many. Rows that break a check are an error, and nothing is written."""
    if missing := [k for k in TABLES[name].key if k not in rows.columns]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    needed = {f"{k} is set": F.col(k).isNotNull() for k in TABLES[name].key}
    if broken := tables.faults(rows, needed | dict(checks or {})).limit(1).collect():
        raise ValueError(f"{name}: a row breaks '{broken[0]['fault']}'")
    return tables.append_missing(rows, f"{folder}/{name}.parquet", TABLES[name].key)


def latest(log: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key of a state log, whole; ties in ``order`` go to the greatest of the other columns."""
    rest = [c for c in log.columns if c not in keys and c not in order]
    last = log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*keys, *(F.col(f"_last.`{c}`").alias(c) for c in (*order, *rest))).select(*log.columns)


def revised(rows: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``columns`` as the last change of each key, in ``order``, left them; a null in a change leaves a column alone."""
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_value"))))["_value"]
    folded = changes.groupBy(*keys).agg(*(last(c).alias(f"_{c}") for c in columns))
    return rows.join(folded, list(keys), "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(f"`{c}`") for c in rows.columns))


def effective(registered: DataFrame, invalidated: DataFrame, keys: Sequence[str], record_id: str, at: str) -> DataFrame:
    """The last registration of each key that no invalidation names; one with a null ``record_id`` takes away all of its key made before it."""
    named = invalidated.where(F.col(record_id).isNotNull()).select(record_id).distinct()
    whole = invalidated.where(F.col(record_id).isNull()).groupBy(*keys).agg(F.max(at).alias("_until"))
    rows = registered.join(named, record_id, "left_anti").join(whole, list(keys), "left").where(F.col("_until").isNull() | (F.col(at) > F.col("_until"))).drop("_until")
    return latest(rows, keys, at)


def held(holds: DataFrame, keys: Sequence[str], at: str, action: str) -> DataFrame:
    """Keys whose last action is ``hold``: nothing of theirs may go out."""
    return latest(holds, keys, at).where(F.col(action) == "hold").select(*keys)


def unfinished(tasks: DataFrame, requested: str, done: str) -> DataFrame:
    """Tasks whose revocation was asked for and hasn't happened."""
    return tasks.where(F.col(requested).isNotNull() & F.col(done).isNull())


def open_counts(assignments: DataFrame, assignee: str, status: str, closed: Sequence[str], people: DataFrame) -> DataFrame:
    """Open assignments of each of ``people``, none included."""
    open_ones = assignments.where(~F.col(status).isin(*closed)).groupBy(assignee).agg(F.count("*").alias("n"))
    return people.select(assignee).distinct().join(open_ones, assignee, "left").fillna({"n": 0})


def due(sessions: DataFrame, decisions: DataFrame, finished: DataFrame, today: Column, days: int, alert_days: int) -> DataFrame:
    """Retention of each session: ``status`` deleted, kept (by its last decision, until its date), due, soon or waiting; ``due_on`` is ``days`` after it was finished."""
    last = latest(decisions.select("session_id", "decided_at", "decision", "until"), ["session_id"], "decided_at")
    rows = sessions.select("session_id").join(last, "session_id", "left").join(finished.select("session_id", "finished_on"), "session_id", "left")
    on = F.date_add("finished_on", days)
    status = F.when(F.col("decision") == "delete", "deleted").when((F.col("decision") == "keep") & (F.col("until").isNull() | (F.col("until") >= today)), "kept")
    status = status.when(F.col("finished_on").isNull(), "waiting").when(on <= today, "due").when(F.date_sub(on, alert_days) <= today, "soon").otherwise("waiting")
    return rows.select("session_id", on.alias("due_on"), status.alias("status"))
