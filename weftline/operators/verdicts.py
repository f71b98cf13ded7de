"""A judge's verdicts on labels, what review makes of them, and the gates that wait for them.

A verdict row has ``label_id``, ``version`` (of the judge), ``verdict`` (ok, suspect, wrong, unknown), ``confidence``,
``label_digest`` and ``render_hash`` of what was judged, and ``judged_at``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.hashing import draw, seeded
from . import joins

Keys = Sequence[str]
#: From bad to good.
SEVERITY = ("wrong", "suspect", "unknown", "ok")


def severity(verdict: Column) -> Column:
    """1 for the worst; a verdict that isn't known comes last."""
    place = F.array_position(F.array(*map(F.lit, SEVERITY)), verdict)
    return F.when(place > 0, place).otherwise(len(SEVERITY) + 1)


def valid(verdicts: DataFrame, current: DataFrame, versions: Sequence[str]) -> DataFrame:
    """Verdicts that still hold: of a judge in use, on a label in force, as it looks now. The last of each label and judge, the worse of two at one time."""
    now = current.select("label_id", "label_digest", "render_hash")
    rows = verdicts.where(F.col("version").isin(*versions)).join(now, ["label_id", "label_digest", "render_hash"], "left_semi")
    last = W.Window.partitionBy("label_id", "version").orderBy(F.desc("judged_at"), severity(F.col("verdict")), F.desc("confidence"))
    return rows.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")


def worst(rows: DataFrame, keys: Keys) -> DataFrame:
    """The worst verdict of each key; of equals the surest, then the least version."""
    order = W.Window.partitionBy(*keys).orderBy(severity(F.col("verdict")), F.desc("confidence"), "version")
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def split(rows: DataFrame) -> DataFrame:
    """Labels on which two judges or more disagree: one says ok and another doesn't."""
    ok = F.col("verdict") == "ok"
    out = rows.groupBy("label_id").agg(F.count_distinct("version").alias("judges"), F.max(ok).alias("_ok"), F.max(~ok).alias("_bad"))
    return out.where("judges > 1 and _ok and _bad").select("label_id", "judges")


def escalated(rows: DataFrame, floors: dict[str, float], disagreed: DataFrame) -> DataFrame:
    """Labels that must be looked at: with a verdict as sure as its floor, or on which judges disagree."""
    sure = F.lit(False)
    for verdict, floor in floors.items():
        sure = sure | ((F.col("verdict") == verdict) & (F.col("confidence") >= floor))
    return rows.where(sure).select("label_id").unionAll(disagreed.select("label_id")).distinct()


def flagged_spans(ids: DataFrame, labels: DataFrame, margin_ms: int) -> DataFrame:
    """Spans of the labels to look at, with a margin, not before the start."""
    rows = labels.join(ids, "label_id", "left_semi")
    return rows.select("session_id", "label_id", F.greatest(F.col("t_start_ms") - margin_ms, F.lit(0)).alias("start"), (F.col("t_end_ms") + margin_ms).alias("end"))


def arms(tasks: DataFrame, key: str, seed: int, control: float) -> DataFrame:
    """``arm`` of each task by a short draw: ``control`` sees no verdicts."""
    return tasks.withColumn("arm", F.when(draw(seeded(seed, F.col(key), separator="|"), 8) < control, "control").otherwise("shown"))


def exposures(tasks: DataFrame, sent: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What each task with an ``arm`` shows of the verdicts on the labels ``sent`` (``task_key``, ``label_id``): ``units``, ``shown`` and ``hidden``."""
    judged = sent.join(verdicts.select("label_id").distinct(), "label_id", "left_semi").groupBy("task_key").agg(F.count("*").alias("_n"))
    units = sent.groupBy("task_key").agg(F.count("*").alias("units"))
    n = F.coalesce("_n", F.lit(0))
    rows = tasks.join(units, "task_key", "left").join(judged, "task_key", "left")
    return rows.select("task_key", "arm", F.coalesce("units", F.lit(0)).alias("units"), F.when(F.col("arm") == "shown", n).otherwise(0).alias("shown"), F.when(F.col("arm") == "control", n).otherwise(0).alias("hidden"))


def human_actions(verdicts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What a reviewer did with each judged label: ``agreed`` with a good or a bad verdict, ``overruled`` one, ``ignored`` a bad one that stands, or ``open`` where the label didn't come back."""
    rows = verdicts.join(outcomes.select("label_id", "outcome"), "label_id", "left")
    bad, changed = F.col("verdict").isin("wrong", "suspect"), F.col("outcome").isin("corrected", "retracted")
    action = F.when(F.col("outcome").isNull(), "open").when(bad & changed, "agreed").when(bad, "ignored").when(changed, "overruled").otherwise("agreed")
    return rows.select("label_id", "verdict", action.alias("action"))


def gate(sessions: DataFrame, runs: DataFrame, now: Column, patience_ms: int) -> DataFrame:
    """Whether review of a session may start: ``open`` after a full run of the judge, ``failed`` or ``late`` where it failed or took too long since the labels were made, else ``wait``. ``runs`` has ``at``, ``state`` and ``complete``."""
    last = runs.groupBy("session_id").agg(F.max_by(F.struct("state", "complete"), "at").alias("_r"))
    rows = sessions.join(last, "session_id", "left")
    late = F.coalesce(now - F.col("prelabeled_at") > patience_ms, F.lit(False))
    state = F.when((F.col("_r.state") == "finished") & F.col("_r.complete"), "open").when(F.col("_r.state") == "failed", "failed").when(late, "late").otherwise("wait")
    return rows.select("session_id", state.alias("gate"))


def unfinished(runs: DataFrame, closing: Sequence[str]) -> DataFrame:
    """The last run of each session, if no event closed it."""
    last = runs.groupBy("session_id").agg(F.max_by(F.struct("run_id", "state"), "at").alias("_r"))
    return last.where(~F.col("_r.state").isin(*closing)).select("session_id", F.col("_r.run_id").alias("run_id"))


def doubts(verdicts: DataFrame, floor: float) -> DataFrame:
    """Doubt on each label from many looks at it: the share of sure ``no`` among all looks, times how sure these are on average; labels without one have none."""
    sure_no = (F.col("verdict") == "no") & (F.col("confidence") >= floor)
    out = verdicts.groupBy("label_id").agg(F.count("*").alias("_n"), F.count(F.when(sure_no, 1)).alias("_no"), F.avg(F.when(sure_no, F.col("confidence"))).alias("_c"))
    return out.where("_no > 0").select("label_id", (F.col("_no") / F.col("_n") * F.col("_c")).alias("doubt"))


def found(planted: DataFrame, labels: DataFrame, tolerance_ms: int) -> DataFrame:
    """Planted errors, and whether their reviewer found each: a record of theirs that corrects the planted label and moves its start by more than the tolerance from the planted one, or retracts it."""
    changes = labels.where("source = 'human'").select(F.col("parent_label_id").alias("label_id"), F.col("reviewer_id").alias("reviewer"), F.col("t_start_ms").alias("_start"), "retracted")
    rows = planted.join(changes, ["label_id", "reviewer"], "left")
    hit = F.coalesce(F.col("retracted") | (F.abs(F.col("_start") - F.col("t_start_ms")) > tolerance_ms), F.lit(False))
    return rows.groupBy("label_id", "reviewer").agg(F.max(hit).alias("found"))


def verification_gaps(current: DataFrame, automatic: Column, needed: Sequence[str]) -> DataFrame:
    """Per session what keeps it from being done: labels in force that nobody looked at, but those that pass by themselves, and ``needed`` kinds it has none of."""
    waits = (F.col("source") != "human") & (F.col("state") == "unreviewed") & ~F.coalesce(automatic, F.lit(False))
    out = current.groupBy("session_id").agg(F.count(F.when(waits, 1)).alias("unreviewed"), F.collect_set("kind").alias("_kinds"))
    return out.select("session_id", "unreviewed", F.array_join(F.array_except(F.array(*map(F.lit, needed)), "_kinds"), ",").alias("missing"))


def missing_reviews(streams: DataFrame, detections: DataFrame, reviews: DataFrame) -> DataFrame:
    """Streams whose newest detection no collected review has seen."""
    newest = detections.groupBy("session_id", "stream_id").agg(F.max("at").alias("generation"))
    rows = streams.join(newest, ["session_id", "stream_id"], "left")
    return rows.join(reviews.select("session_id", "stream_id", "generation"), ["session_id", "stream_id", "generation"], "left_anti").select("session_id", "stream_id", "generation")


def review_mode(weeks: DataFrame, target: float, length: int) -> DataFrame:
    """``sampled`` once the last ``length`` weeks all lie under the target, else ``full``; a week without audits doesn't count as under."""
    order = W.Window.orderBy(F.desc("week"))
    last = weeks.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= length)
    good = F.coalesce(F.col("rate") < target, F.lit(False))
    return last.agg(F.when((F.count("*") == length) & F.min(good), "sampled").otherwise("full").alias("mode"))


def held_to(report: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Metrics of a report within their limits (least, most); one without data, or not in the report, fails."""
    spark = report.sparkSession
    wanted = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in limits.items()], "metric string, least double, most double")
    return wanted.join(report.select("metric", "value"), "metric", "left").select("metric", "value", F.coalesce(F.col("value").between(F.col("least"), F.col("most")), F.lit(False)).alias("passed"))


def deployed(models: DataFrame) -> DataFrame:
    """The model in service for each task: the newest that is deployed."""
    order = W.Window.partitionBy("task").orderBy(F.desc("created_at"), F.desc("model_version"))
    return models.where("status = 'deployed'").withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def deploying(models: DataFrame, version: str) -> DataFrame:
    """Statuses once ``version`` is put into service: others of its task that were retire; a retired or rejected model can't come back without a new version."""
    task = models.where(F.col("model_version") == version).select(F.col("task").alias("_task"), F.col("status").alias("_was"))
    rows = models.join(F.broadcast(task.limit(1)), models["task"] == F.col("_task"), "left")
    barred = (F.col("model_version") == version) & F.col("status").isin("retired", "rejected")
    status = F.when(barred, F.raise_error(F.lit("a model that was taken out of service can't return"))).when(F.col("model_version") == version, "deployed").when(F.col("_task").isNotNull() & (F.col("status") == "deployed"), "retired").otherwise(F.col("status"))
    return rows.select(*(status.alias(c) if c == "status" else F.col(c) for c in models.columns))


def examples(labels: DataFrame, splits: DataFrame, wanted: Column, digest: Column) -> DataFrame:
    """Training examples of sessions in train or val: what review accepted, corrected and took away, one of each content."""
    rows = labels.where(wanted).join(splits.where(F.col("split").isin("train", "val")).select("session_id", "split"), "session_id").withColumn("fingerprint", digest)
    order = W.Window.partitionBy("split", "fingerprint").orderBy("label_id")
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").select("label_id", "session_id", "split", "fingerprint")


def slots(rows: DataFrame, keys: Keys, name: str, row_id: str) -> DataFrame:
    """Names made distinct within a key: the second of one name gets ``#2``, and so on."""
    place = F.row_number().over(W.Window.partitionBy(*keys, name).orderBy(row_id))
    return rows.withColumn("slot", F.when(place == 1, F.col(name)).otherwise(F.concat(name, F.lit("#"), place.cast("string"))))


def increasing(rows: DataFrame, keys: Keys, order: str, time: str) -> DataFrame:
    """Rows, in their order, whose time is later than that of all before them."""
    before = W.Window.partitionBy(*keys).orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    return rows.withColumn("_latest", F.max(time).over(before)).where(F.col("_latest").isNull() | (F.col(time) > F.col("_latest"))).drop("_latest")


def clipped(rows: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Intervals cut to a range; what is left empty goes."""
    out = rows.withColumn(start, F.greatest(F.col(start), low)).withColumn(end, F.least(F.col(end), high))
    return out.where(F.col(end) > F.col(start))


def mostly_inside(tracks: DataFrame, frames: DataFrame, keys: Keys, inside: Column, share: float) -> DataFrame:
    """Tracks without those of whose frames at least ``share`` meet ``inside``: the camera wearer's own body, for one."""
    out = frames.groupBy(*keys).agg(F.avg(inside.cast("double")).alias("_share")).where(F.col("_share") >= share)
    return tracks.join(out, list(keys), "left_anti")


def supported(rows: DataFrame, others: DataFrame, keys: Keys, time: str, row_id: str, near: Column, tolerance: int) -> DataFrame:
    """Rows with ``support``: whether another table of the same key has a row within the tolerance of time that is ``near``. Columns of the others come as ``o_<name>``."""
    width = max(1, tolerance)
    a = rows.withColumn("_bin", F.explode(F.array(*(F.floor(F.col(time) / width) + k for k in (-1, 0, 1)))))
    b = others.select(*keys, *(F.col(c).alias(f"o_{c}") for c in others.columns if c not in keys)).withColumn("_bin", F.floor(F.col(f"o_{time}") / width))
    hit = a.join(b, [*keys, "_bin"]).where((F.abs(F.col(time) - F.col(f"o_{time}")) <= tolerance) & near).select(row_id).distinct().withColumn("support", F.lit(True))
    return rows.join(hit, row_id, "left").fillna({"support": False})


def units(sessions: DataFrame, streams: DataFrame, spatial: Sequence[str], temporal: Sequence[str]) -> DataFrame:
    """Units of review: each stream with each spatial group, each session with each temporal group."""
    groups = lambda names: F.explode(F.array(*map(F.lit, names))).alias("group")
    a = streams.select("session_id", "stream_id", groups(spatial))
    b = sessions.select("session_id", F.lit(None).cast(streams.schema["stream_id"].dataType).alias("stream_id"), groups(temporal))
    return a.unionByName(b)


def agreement_within(a: DataFrame, b: DataFrame, keys: Keys, time: str, a_id: str, b_id: str, values: Sequence[str], near: Column, tolerance: float) -> DataFrame:
    """Share of rows whose nearest counterpart in time, within a tolerance, is ``near``; columns of the counterpart come as ``m_<name>``. Rows without one don't count."""
    renamed = b.select(*keys, time, b_id, *(F.col(v).alias(f"m_{v}") for v in values))
    rows = joins.asof(a, renamed, keys, time, a_id, b_id, [f"m_{v}" for v in values], "nearest", within=tolerance).where("match_time is not null")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(near.cast("double")).alias("share"))
