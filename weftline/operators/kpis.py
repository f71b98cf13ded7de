"""Weekly figures of an annotation shop over its tables. A ratio without anything to divide by is null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import iso_week


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def review_effort(work: DataFrame) -> DataFrame:
    """``week``, minutes of review per hour of video, in general and for privacy, and hours spent. ``work`` has ``recorded_at``, ``stage``, ``seconds`` and ``video_ms``."""
    private = F.col("stage") == "privacy"
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    minutes = lambda when: ratio(total("seconds", when) / 60, total("video_ms", when) / 3_600_000)
    return work.groupBy(iso_week(F.col("recorded_at")).alias("week")).agg(minutes(~private).alias("review_minutes_per_video_hour"), minutes(private).alias("privacy_minutes_per_video_hour"), (F.sum("seconds") / 3600).alias("review_hours"))


def change_rates(changes: DataFrame) -> DataFrame:
    """Per ``week`` of ``at``: outcomes by name, the share that review changed, and the share of model labels it let stand."""
    n = {o: F.count(F.when(F.col("outcome") == o, 1)) for o in ("accepted", "corrected", "deleted", "added")}
    changed = n["corrected"] + n["deleted"] + n["added"]
    return changes.groupBy(iso_week(F.col("at")).alias("week")).agg(*(v.alias(k) for k, v in n.items()), ratio(changed, changed + n["accepted"]).alias("correction_rate"), ratio(n["accepted"], n["accepted"] + n["corrected"] + n["deleted"]).alias("auto_approval_rate"))


def detection_rate(seeded: DataFrame) -> DataFrame:
    """Per ``week`` of ``completed_at``: planted errors, and the share that reviewers ``found``."""
    found = F.sum(F.col("found").cast("int"))
    return seeded.groupBy(iso_week(F.col("completed_at")).alias("week")).agg(F.count("*").alias("seeded_errors"), found.alias("seeded_found"), ratio(found, F.count("*")).alias("detection_rate"))


def miss_rate(audits: DataFrame) -> DataFrame:
    """Per ``week`` of ``audited_at``: audits, and faces missed per hour audited. An audit by its own reviewer is an error."""
    own = F.col("auditor") == F.col("blur_reviewer")
    checked = F.when(F.coalesce(own, F.lit(False)), F.raise_error(F.lit("an auditor checks their own work"))).otherwise(F.col("duration_ms"))
    return audits.groupBy(iso_week(F.col("audited_at")).alias("week")).agg(F.count("*").alias("privacy_audits"), ratio(F.sum("misses"), F.sum(checked) / 3_600_000).alias("misses_per_hour"))


def weekly(weeks: DataFrame, parts: Mapping[str, DataFrame], hourly_cost: float | None = None, finished: DataFrame | None = None) -> DataFrame:
    """All figures of each of ``weeks`` in one row; a part without a row for a week leaves nulls.

    ``finished`` (``at``) adds ``finished_sessions``, and with ``hourly_cost`` the cost of one: review hours by it over sessions finished.
    """
    out = weeks.select("week").distinct()
    for part in parts.values():
        out = out.join(part, "week", "left")
    if finished is not None:
        done = finished.groupBy(iso_week(F.col("at")).alias("week")).agg(F.count("*").alias("finished_sessions"))
        out = out.join(done, "week", "left").fillna({"finished_sessions": 0})
        if hourly_cost is not None:
            out = out.withColumn("cost_per_session", ratio(F.col("review_hours") * hourly_cost, F.col("finished_sessions")))
    return out


def judge_figures(rows: DataFrame) -> DataFrame:
    """Per ``week`` of ``at``: units a judge looked at, the share it flagged, and of those that review settled (``wrong`` is set) precision and recall of its flags."""
    settled = F.col("wrong").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    hit = settled & F.col("flagged") & F.col("wrong")
    return rows.groupBy(iso_week(F.col("at")).alias("week")).agg(F.count("*").alias("units"), ratio(count(F.col("flagged")), F.count("*")).alias("flagged_share"), ratio(count(hit), count(settled & F.col("flagged"))).alias("precision"), ratio(count(hit), count(settled & F.col("wrong"))).alias("recall"))


def load(units: DataFrame, group: str, seconds: Column, throughput: float, hours_per_day: float, margin: float) -> DataFrame:
    """Units and seconds of work by group, and the machines that do all of a day's in time: load over throughput, with a margin for reruns, rounded up."""
    rows = units.groupBy(group).agg(F.count("*").alias("units"), F.sum(seconds).alias("seconds"))
    return rows.withColumn("machines", F.ceil(F.col("units") * (1 + margin) / (throughput * hours_per_day * 3600)))


def latencies(calls: DataFrame, keys: list[str], wall: Column) -> DataFrame:
    """Of calls with ``latency``, ``ok`` and ``cached``: median and 95th percentile of the good ones, calls per second of ``wall`` time, and shares of errors and cache hits."""
    good = F.when(F.col("ok"), F.col("latency"))
    return calls.groupBy(*keys).agg(F.percentile(good, F.lit(0.5)).alias("p50"), F.percentile(good, F.lit(0.95)).alias("p95"), (F.count(good) / F.max(wall)).alias("per_second"), F.avg((~F.col("ok")).cast("double")).alias("error_share"), F.avg(F.col("cached").cast("double")).alias("cache_share"))


def track_figures(tracks: DataFrame, keys: list[str], minutes: Column, short_ms: int) -> DataFrame:
    """Tracks per minute, the median and 90th percentile of their length and key frames, and the share of short ones."""
    length = F.col("t_end_ms") - F.col("t_start_ms")
    return tracks.groupBy(*keys).agg(
        F.count("*").alias("tracks"), (F.count("*") / F.max(minutes)).alias("per_minute"), F.percentile(length, F.lit(0.5)).alias("median_ms"), F.percentile(length, F.lit(0.9)).alias("p90_ms"),
        F.percentile("keyframes", F.lit(0.5)).alias("median_keyframes"), F.avg((length < short_ms).cast("double")).alias("short_share"),
    )


def presence_figures(frames: DataFrame, keys: list[str], time: str, gap: int, minutes: Column) -> DataFrame:
    """Of detections by frame: frames, mean detections in one, runs without a gap longer than ``gap``, and runs per minute (flicker)."""
    from pyspark.sql import window as W

    by_frame = frames.groupBy(*keys, time).agg(F.count("*").alias("_n"))
    order = W.Window.partitionBy(*keys).orderBy(time)
    fresh = F.coalesce(F.col(time) - F.lag(time).over(order) > gap, F.lit(True))
    rows = by_frame.withColumn("_fresh", fresh.cast("int"))
    return rows.groupBy(*keys).agg(F.count("*").alias("frames"), F.avg("_n").alias("per_frame"), F.sum("_fresh").alias("runs"), (F.sum("_fresh") / F.max(minutes)).alias("flicker"))


def exposure(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks shown with a judge's verdicts, by arm: how many, and the mean share of their units that was shown."""
    return rows.groupBy(*keys).agg(F.count("*").alias("tasks"), F.avg(ratio(F.col("shown"), F.col("units"))).alias("coverage"))


def calibration_effect(rows: DataFrame, keys: list[str], before: str, after: str, wrong: str) -> DataFrame:
    """Precision and recall of flags before and after calibration, on rows that review settled."""
    count = lambda c: F.count(F.when(c, 1))
    out = []
    for name, flag in (("before", before), ("after", after)):
        hit = F.col(flag) & F.col(wrong)
        out += [ratio(count(hit), count(F.col(flag))).alias(f"precision_{name}"), ratio(count(hit), count(F.col(wrong))).alias(f"recall_{name}")]
    return rows.where(F.col(wrong).isNotNull()).groupBy(*keys).agg(*out)


def under_sampled(rows: DataFrame, kind: str, least: int) -> DataFrame:
    """Classes with fewer rows than ``least``."""
    return rows.groupBy(kind).agg(F.count("*").alias("n")).where(F.col("n") < least)


def flag_counts(rows: DataFrame, keys: list[str], flags: str) -> DataFrame:
    """Rows that carry each flag of an array."""
    return rows.select(*keys, F.explode(F.array_distinct(flags)).alias("flag")).groupBy(*keys, "flag").agg(F.count("*").alias("n"))


def subgroups(rows: DataFrame, keys: list[str], groups: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over all rows and by each of ``groups``, in one pass: ``subgroup`` is ``all`` or ``column=value``."""
    tags = F.array(F.lit("all"), *(F.concat(F.lit(f"{g}="), F.coalesce(F.col(g).cast("string"), F.lit("null"))) for g in groups))
    return rows.withColumn("subgroup", F.explode(tags)).groupBy(*keys, "subgroup").agg(*aggregates)
