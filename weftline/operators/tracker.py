"""Linking detections to tracks, and merging detections of one frame: a frame at a time, in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .streamed import streamed

Box = tuple[float, float, float, float]


def shared(a: Box, b: Box) -> float:
    """Shared area over joint area of two boxes."""
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return 0.0 if w <= 0 or h <= 0 else w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def advance(state: dict | None, at: int, found: Sequence[tuple[int, str, Box, float]], least: float, longest: int) -> tuple[dict, list[tuple[int, int]]]:
    """One frame: ``found`` (id, class, box, score) choose in order of their score, equal ones in order of ``found``, the free open track of their class that shares most with them, of equals the one opened last; who finds none opens a track. Tracks not seen for ``longest`` are closed, so the state holds open ones only."""
    state = state or {"next": 0, "open": []}
    tracks = sorted(t for t in state["open"] if at - t[3] <= longest)
    free, given, fresh = set(range(len(tracks))), {}, state["next"]
    for n in sorted(range(len(found)), key=lambda n: -found[n][3]):
        _, kind, box, _ = found[n]
        near = [(s, k) for k in free if tracks[k][1] == kind and (s := shared(tracks[k][2], box)) >= least]
        if near:
            k = max(near)[1]
            free.remove(k)
            given[n] = tracks[k][0]
        else:
            given[n], fresh = fresh, fresh + 1
    now = [(given[n], kind, box, at) for n, (_, kind, box, _) in enumerate(found)]
    return {"next": fresh, "open": [tracks[k] for k in sorted(free)] + now}, [(found[n][0], given[n]) for n in sorted(given)]


def tracks(boxes: DataFrame, least: float = 0.5, longest: int = 1000) -> DataFrame:
    """``track`` of each box (``sequence``, ``frame`` as a time, ``id``, ``class``, ``x``, ``y``, ``w``, ``h``, and ``score`` where there is one): numbers from 0 in each sequence."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in boxes.columns else F.lit(0.0)
    frames = boxes.groupBy("sequence", "frame").agg(F.array_sort(F.collect_list(F.struct("id", "class", "x", "y", "w", "h", score.alias("score")))).alias("boxes"))

    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        state, given = advance(state, row["frame"], [(b["id"], b["class"], (b["x"], b["y"], b["w"], b["h"]), b["score"]) for b in row["boxes"]], least, longest)
        return state, [{"sequence": row["sequence"], "frame": row["frame"], "id": i, "track": t} for i, t in given]

    schema = StructType([boxes.schema["sequence"], boxes.schema["frame"], boxes.schema["id"], StructField("track", LongType())])
    return streamed(frames, ["sequence"], ["frame"], step, schema)


def fused(boxes: DataFrame, least: float) -> DataFrame:
    """Detections of one frame and class that share ``least`` of their area with a better one, as one: the box around all, the best ``score``, and how many (``n``). Detectors may differ."""

    def step(state: list | None, row: dict) -> tuple[list, list[dict]]:
        state, box = state or [{"key": {k: row[k] for k in ("sequence", "frame", "class")}}], (row["x"], row["y"], row["w"], row["h"])
        for group in state[1:]:
            if shared(group["seed"], box) >= least:
                x, y, w, h = group["hull"]
                left, top = min(x, box[0]), min(y, box[1])
                group["hull"] = (left, top, max(x + w, box[0] + box[2]) - left, max(y + h, box[1] + box[3]) - top)
                group["n"] += 1
                return state, []
        state.append({"seed": box, "hull": box, "score": row["score"], "n": 1})
        return state, []

    def end(state: list) -> list[dict]:
        return [state[0]["key"] | dict(zip("xywh", g["hull"], strict=True)) | {"score": g["score"], "n": g["n"]} for g in state[1:]]

    schema = StructType([boxes.schema["sequence"], boxes.schema["frame"], StructField("class", StringType()), *(StructField(c, DoubleType()) for c in ("x", "y", "w", "h", "score")), StructField("n", LongType())])
    rows = boxes.select("sequence", "frame", "class", "x", "y", "w", "h", "score", (-F.col("score")).alias("worse"), "id")
    return streamed(rows, ["sequence", "frame", "class"], ["worse", "id"], step, schema, end=end)


def rendered(tracked: DataFrame, frames: DataFrame, hold: int, margin: float) -> DataFrame:
    """Boxes to blur at every frame of a track: between two sightings the box around both, up to ``hold`` before the first and after the last that of the nearest; grown by a margin."""
    from pyspark.sql import window as W

    order = W.Window.partitionBy("sequence", "track").orderBy("frame")
    nxt = lambda c: F.lead(c).over(order)
    first = F.lag("frame").over(order).isNull()
    last = nxt("frame").isNull()
    spans = tracked.select(
        "sequence", "track", F.when(first, F.col("frame") - hold).otherwise(F.col("frame")).alias("_from"), F.when(last, F.col("frame") + hold).otherwise(nxt("frame") - 1).alias("_to"), F.col("frame").alias("_at"),
        *(F.col(c).alias(f"_{c}") for c in "xywh"), *(nxt(c).alias(f"_n{c}") for c in "xywh"),
    )
    width = max(1, 4 * hold)
    a = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width))))
    b = frames.select("sequence", "frame", F.floor(F.col("frame") / width).alias("_bin"))
    rows = a.join(b, ["sequence", "_bin"]).where((F.col("frame") >= F.col("_from")) & (F.col("frame") <= F.col("_to")))
    between = (F.col("frame") > F.col("_at")) & F.col("_nx").isNotNull()
    left, top = F.when(between, F.least("_x", "_nx")).otherwise(F.col("_x")), F.when(between, F.least("_y", "_ny")).otherwise(F.col("_y"))
    right = F.when(between, F.greatest(F.col("_x") + F.col("_w"), F.col("_nx") + F.col("_nw"))).otherwise(F.col("_x") + F.col("_w"))
    low = F.when(between, F.greatest(F.col("_y") + F.col("_h"), F.col("_ny") + F.col("_nh"))).otherwise(F.col("_y") + F.col("_h"))
    w, h = right - left, low - top
    return rows.select("sequence", "track", "frame", (left - w * margin).alias("x"), (top - h * margin).alias("y"), (w * (1 + 2 * margin)).alias("w"), (h * (1 + 2 * margin)).alias("h"))
