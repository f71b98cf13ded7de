"""The same operators on streams: windows with late data, sessions, first sightings, upserts by batch, and a keyed state machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(stream: DataFrame, at: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts and sums of ``value`` per window and key; rows later than ``late`` are dropped, as the watermark says."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, at: str, late: str, gap: str, *keys: str) -> DataFrame:
    """Sessions of each key, ended by a gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_seen(stream: DataFrame, at: str, late: str, *ids: str) -> DataFrame:
    """Each id once, within the watermark: redelivered events are dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(ids))


def lifecycle(stream: DataFrame, key: str, at: str, state: str, order: list[str], forget: str | None = None) -> DataFrame:
    """Moves of each key to a later state of ``order``; a repeated or earlier state says nothing.

    Only the latest state is kept per key, and with ``forget`` only until the stream's clock, the latest time seen, is
    that much later: so the state doesn't grow with all keys ever seen. A key that comes back then starts anew.
    """
    if forget:
        stream = stream.withWatermark(at, forget)

    def step(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        place = held.get[0] if held.exists else -1
        out = []
        rows = pd.concat(list(batches)).sort_values(at)
        for row in rows.itertuples(index=False):
            to = order.index(getattr(row, state)) if getattr(row, state) in order else -1
            if to > place:
                out.append((keys[0], order[place] if place >= 0 else None, order[to], getattr(row, at)))
                place = to
        held.update((place,))
        if forget:
            held.setTimeoutTimestamp(max(int(rows[at].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "before", "after", "at"])

    return stream.groupBy(key).applyInPandasWithState(step, f"key {stream.schema[key].dataType.simpleString()}, before string, after string, at timestamp", "place int", "append", GroupStateTimeout.EventTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def tracked(stream: DataFrame, least: float = 0.5, longest: int = 1000, forget: str = "10 minutes") -> DataFrame:
    """Detections linked to tracks as they come, a batch's frames in order; ``frame`` is a time in milliseconds. The state of a sequence is its open tracks, and goes when the stream's clock is ``forget`` past its last frame. Columns as for :func:`weftline.operators.tracker.tracks`."""
    import json

    from ..operators.tracker import advance

    stream = stream.withColumn("_at", F.timestamp_millis("frame")).withWatermark("_at", forget)

    def step(keys: tuple[Any, ...], batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state, out = json.loads(held.get[0]) if held.exists else None, []
        rows = pd.concat(list(batches)).sort_values(["frame", "id"]).rename(columns={"class": "kind"})
        for at, boxes in rows.groupby("frame"):
            state, given = advance(state, int(at), [(int(b.id), b.kind, (b.x, b.y, b.w, b.h), float(getattr(b, "score", 0.0))) for b in boxes.itertuples(index=False)], least, longest)
            out += [(keys[0], int(at), i, t) for i, t in given]
        held.update((json.dumps(state),))
        held.setTimeoutTimestamp(max(int(rows["frame"].max()), held.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["sequence", "frame", "id", "track"])

    return stream.groupBy("sequence").applyInPandasWithState(step, f"sequence {stream.schema['sequence'].dataType.simpleString()}, frame long, id long, track long", "tracks string", "append", GroupStateTimeout.EventTimeTimeout)


def signed(stream: DataFrame, body: str, signature: str, secret: bytes) -> DataFrame:
    """Events whose ``signature`` is the HMAC-SHA256 of their body; others never came from the tool and are dropped."""
    from ..functions.hashing import hmac

    return stream.where(F.coalesce(hmac(secret, F.col(body)) == F.lower(F.regexp_replace(signature, "^sha256=", "")), F.lit(False)))


def with_assignment(stream: DataFrame, assignments: DataFrame, task: str) -> DataFrame:
    """Events with the reviewer that the batch table of assignments gives their task; events of unknown tasks stay, without one."""
    return stream.join(assignments.select(task, "reviewer_id"), task, "left")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, through the streaming engine, as a table in memory: for tests and small reports."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Apply an idempotent batch operator to what has arrived."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
