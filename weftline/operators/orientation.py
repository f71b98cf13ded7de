"""Orientation from turn rates: a prefix product of rotations, in two levels.

Samples of a key are cut into chunks of time. Each chunk's turns are multiplied where they lie, the products
of the chunks are scanned in order of time, a row a chunk, and every chunk is gone through once more from where it starts: a
key may be spread over any number of tasks. Quaternions are [w, x, y, z].
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .settled import settled
from .streamed import streamed

Keys = Sequence[str]
SAMPLE = "struct<t:double,id:long,gx:double,gy:double,gz:double>"


@dataclass(frozen=True)
class Rest:
    """When the first ``window`` of a key counts as rest: spreads of the sizes of acceleration and turn, the mean turn, and how far the mean acceleration is from ``gravity``."""

    window: float
    acc_spread: float
    turn_spread: float
    turn_mean: float
    gravity: float
    tolerance: float


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w, x, y, z = np.moveaxis(a, -1, 0)
    p, q, r, s = np.moveaxis(b, -1, 0)
    return np.stack([w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p], axis=-1)


def turned(rotation: np.ndarray) -> np.ndarray:
    """Quaternions of rotation vectors."""
    angle = np.linalg.norm(rotation, axis=-1, keepdims=True)
    return np.concatenate([np.cos(angle / 2), rotation * np.sinc(angle / (2 * np.pi)) / 2], axis=-1)


def products(q: np.ndarray) -> np.ndarray:
    """All prefix products of rows, by doubling: the logarithm of their number in numpy steps."""
    out, step = q.copy(), 1
    while step < len(out):
        out[step:] = multiplied(out[:-step], out[step:])
        step *= 2
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def first_orientation(up: np.ndarray, forward: np.ndarray) -> np.ndarray | None:
    """Turns what is up in the sensor into the world's z, and ``forward``'s level part into its x; None where forward is upright."""
    z = up / np.linalg.norm(up)
    level = forward - (forward @ z) * z
    if np.linalg.norm(level) < 1e-3:
        return None
    x = level / np.linalg.norm(level)
    m = np.stack([x, np.cross(z, x), z])
    # The eigenvector of the largest eigenvalue of the symmetric form is the quaternion.
    k = np.array([
        [m[0, 0] + m[1, 1] + m[2, 2], m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]],
        [m[2, 1] - m[1, 2], m[0, 0] - m[1, 1] - m[2, 2], m[0, 1] + m[1, 0], m[0, 2] + m[2, 0]],
        [m[0, 2] - m[2, 0], m[0, 1] + m[1, 0], m[1, 1] - m[0, 0] - m[2, 2], m[1, 2] + m[2, 1]],
        [m[1, 0] - m[0, 1], m[0, 2] + m[2, 0], m[1, 2] + m[2, 1], m[2, 2] - m[0, 0] - m[1, 1]],
    ])
    q = np.linalg.eigh(k)[1][:, -1]
    return q if q[np.argmax(np.abs(q))] >= 0 else -q


def starts(samples: DataFrame, keys: Keys, time: str, acc: Keys, turn: Keys, rest: Rest) -> DataFrame:
    """For each key the mean acceleration (``up``) over the first ``rest.window``, the number of samples there, whether it rests, and ``bias``, its mean turn if so."""
    began = samples.groupBy(*keys).agg(F.min(time).alias("_t0"))
    size = lambda v: F.sqrt(sum((F.col(c) * F.col(c) for c in v[1:]), F.col(v[0]) * F.col(v[0])))
    early = samples.join(began, list(keys)).where(F.col(time) <= F.col("_t0") + rest.window)
    sums = early.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_start"), F.array(*(F.avg(c) for c in acc)).alias("up"), F.array(*(F.avg(c) for c in turn)).alias("_turn"),
        F.stddev_pop(size(acc)).alias("_sa"), F.stddev_pop(size(turn)).alias("_st"), F.avg(size(acc)).alias("_ma"),
    )
    slow = F.sqrt(F.aggregate("_turn", F.lit(0.0), lambda s, v: s + v * v)) <= rest.turn_mean
    still = (F.col("_sa") <= rest.acc_spread) & (F.col("_st") <= rest.turn_spread) & slow & (F.abs(F.col("_ma") - rest.gravity) <= rest.tolerance)
    return sums.select(*keys, "n_start", "up", still.alias("rested"), F.when(still, F.col("_turn")).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("bias"))


def integrated(samples: DataFrame, keys: Keys, time: str, sample_id: str, acc: Keys, turn: Keys, rest: Rest, most_gap: float, chunk: float, forward: Sequence[float] = (1.0, 0.0, 0.0), second: float = 1000.0) -> DataFrame:
    """``q``, the turn from the sensor to the world at each sample, and ``rested``: turn rates (radians a second, ``second`` units of time) are integrated by trapezoids from the orientation at rest.

    A key ends before its first step longer than ``most_gap``. Keys with fewer than two samples in the start window, with such a
    gap inside it, or whose forward direction is upright have no rows. ``chunk`` is the length in time of a chunk.
    """
    begun = starts(samples, keys, time, acc, turn, rest)
    item = F.struct(F.col(time).cast("double").alias("t"), F.col(sample_id).cast("long").alias("id"), *(F.col(c).cast("double").alias(f"g{x}") for c, x in zip(turn, "xyz", strict=True)))
    chunks = samples.groupBy(*keys, F.floor(F.col(time) / chunk).alias("_chunk")).agg(F.sort_array(F.collect_list(item)).alias("_s"))
    # The sample before a chunk is the last one of the chunk before: one row a chunk is scanned, not one a sample.
    line = W.Window.partitionBy(*keys).orderBy("_chunk")
    chunks = chunks.withColumn("_before", F.lag(F.element_at("_s", -1)).over(line)).join(begun, list(keys)).where("n_start > 1")
    ahead = np.array(forward, dtype=float)

    def steps(row: dict) -> tuple[np.ndarray, np.ndarray, int]:
        """Times, turns between samples (the first from the sample before, or none), and the place of the first gap."""
        before = [row["_before"]] if row["_before"] else []
        v = np.array([[x["t"], x["gx"], x["gy"], x["gz"]] for x in before + row["_s"]])
        dt = np.diff(v[:, 0])
        q = turned(((v[1:, 1:] + v[:-1, 1:]) / 2 - np.array(row["bias"])) * dt[:, None] / second)
        gap = np.flatnonzero(dt > most_gap)
        if not before:
            q, gap = np.concatenate([[[1.0, 0.0, 0.0, 0.0]], q]), gap + 1
        return v[len(before) :, 0], q, int(gap[0]) if len(gap) else len(q)

    total = StructType([*(chunks.schema[k] for k in keys), StructField("_chunk", LongType()), StructField("_q", ArrayType(DoubleType())), StructField("_gap", DoubleType()), StructField("_t0", DoubleType()), StructField("up", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(total)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                t, q, gap = steps(row)
                edge = float(t[gap - 1] if gap else row["_before"]["t"]) if gap < len(q) else None
                rows.append({k: row[k] for k in (*keys, "_chunk", "up")} | {"_q": products(q)[-1].tolist(), "_gap": edge, "_t0": float(t[0])})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        if state is None:
            q = first_orientation(np.array(row["up"]), ahead)
            state = {"q": q, "over": q is None, "t0": row["_t0"]}
        if not state["over"] and row["_gap"] is not None and row["_gap"] < state["t0"] + rest.window:
            # Too short a start: earlier chunks of the key are taken back by this row.
            return state | {"over": True}, [{k: row[k] for k in (*keys, "_chunk")} | {"_from": None}]
        out = [] if state["over"] else [{k: row[k] for k in (*keys, "_chunk")} | {"_from": state["q"].tolist()}]
        if not state["over"]:
            q = multiplied(state["q"], np.array(row["_q"]))
            state = state | {"q": q / np.linalg.norm(q), "over": row["_gap"] is not None}
        return state, out

    scanned = settled(streamed(chunks.mapInArrow(reduced, total), keys, ["_chunk"], step, StructType([*total.fields[: len(keys) + 1], StructField("_from", ArrayType(DoubleType()))])))
    scanned = scanned.join(scanned.where("_from is null").select(*keys), list(keys), "left_anti")
    done = StructType([*(chunks.schema[k] for k in keys), StructField(sample_id, LongType()), StructField(time, DoubleType()), StructField("q", ArrayType(DoubleType())), chunks.schema["rested"]])
    final = to_arrow_schema(done)

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t, q, gap = steps(row)
                if gap:
                    path = multiplied(np.array(row["_from"]), products(q[:gap]))
                    ids = [x["id"] for x in row["_s"][:gap]]
                    yield pa.RecordBatch.from_arrays([*(pa.array([row[k]] * gap, type=final.field(k).type) for k in keys), pa.array(ids), pa.array(t[:gap]), pa.array(path.tolist(), type=final.field("q").type), pa.array([row["rested"]] * gap)], schema=final)

    return chunks.join(scanned, [*keys, "_chunk"]).mapInArrow(replayed, done)
