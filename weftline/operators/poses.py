"""Poses and trajectories: at any time, in the world, against the truth, and fits from sums.

A pose is ``q`` (unit quaternion [w, x, y, z]) and ``p`` ([x, y, z]). Fits need only sums over their
points, which Spark aggregates; the small system that is left is solved for all groups of a batch at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import rotations
from . import joins

Keys = Sequence[str]


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def pose_at(moments: DataFrame, poses: DataFrame, keys: Keys, time: str, moment_id: str, pose_id: str, most_gap: float) -> DataFrame:
    """Each moment with ``q`` and ``p`` between the poses around it, at most ``most_gap`` apart: rotations the short way round, places in a straight line. A pose at the very moment wins; else both are null."""
    before = joins.asof(moments, poses, keys, time, moment_id, pose_id, ["q", "p"]).select(*keys, moment_id, time, F.col("match_time").alias("_t0"), F.col("q").alias("_q0"), F.col("p").alias("_p0"))
    after = joins.asof(moments, poses, keys, time, moment_id, pose_id, ["q", "p"], "forward").select(*keys, moment_id, F.col("match_time").alias("_t1"), F.col("q").alias("_q1"), F.col("p").alias("_p1"))
    rows = before.join(after, [*keys, moment_id])
    share = (F.col(time) - F.col("_t0")) / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0).cast("double"))
    close = F.col("_t1") - F.col("_t0") <= most_gap
    exact = F.col("_t0") == F.col(time)
    q = F.when(exact, F.col("_q0")).when(close, rotations.slerp(F.col("_q0"), F.col("_q1"), share))
    p = F.when(exact, F.col("_p0")).when(close, F.zip_with("_p0", "_p1", lambda a, b: a + (b - a) * share))
    return rows.select(*keys, moment_id, time, q.alias("q"), p.alias("p"))


def in_world(samples: DataFrame, keys: Keys, time: str, sample_id: str, poses: DataFrame, pose_id: str, most_gap: float) -> DataFrame:
    """Points seen by a moving camera (``v``) in the world, ``q v + p`` by the camera's pose at the time; those without a pose go."""
    posed = pose_at(samples.select(*keys, time, sample_id), poses, keys, time, sample_id, pose_id, most_gap).where("q is not null")
    return samples.join(posed.drop(time), [*keys, sample_id]).withColumn("world", _plus(rotations.rotated(F.col("q"), F.col("v")), F.col("p"))).drop("q", "p")


def trajectory_error(pairs: DataFrame, keys: Keys, estimated: str, truth: str) -> DataFrame:
    """Root mean square distance of places from the truth."""
    return pairs.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(length(_minus(F.col(estimated), F.col(truth))), F.lit(2)))).alias("rmse"), F.count("*").alias("n"))


def relative_error(pairs: DataFrame, keys: Keys, order: Keys, step: int = 1) -> DataFrame:
    """Root mean square error of moves over ``step`` poses: of their places, and of their rotations in radians. Columns ``q``, ``p`` are estimated, ``tq``, ``tp`` true."""
    w = W.Window.partitionBy(*keys).orderBy(*order)
    move = lambda q, p: (rotations.times(rotations.inverse(F.col(q)), F.lead(q, step).over(w)), rotations.rotated(rotations.inverse(F.col(q)), _minus(F.lead(p, step).over(w), F.col(p))))
    (q, p), (tq, tp) = move("q", "p"), move("tq", "tp")
    rows = pairs.select(*keys, length(_minus(p, tp)).alias("_d"), rotations.angle(q, tq).alias("_a")).where("_d is not null")
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("place_error"), F.sqrt(F.avg(F.col("_a") * F.col("_a"))).alias("angle_error"), F.count("*").alias("n"))


def _quaternions(m: np.ndarray) -> np.ndarray:
    """:func:`rotations.from_matrix` for many matrices at once."""
    a, b, c, d, e, f, g, h, i = m.reshape(-1, 9).T
    size = np.stack([a + e + i, a - e - i, e - a - i, i - a - e], 1)
    most = size.argmax(1)
    # Row k has the quaternion times four times its component k; what is next to it on the diagonal is four times that component's square.
    rows = [[None, h - f, c - g, d - b], [h - f, None, b + d, c + g], [c - g, b + d, None, f + h], [d - b, c + g, f + h, None]]
    s = 2 * np.sqrt(np.maximum(size[np.arange(len(size)), most] + 1, 0))
    out = np.empty((len(s), 4))
    for k in range(4):
        at = most == k
        for j in range(4):
            out[at, j] = s[at] / 4 if j == k else rows[k][j][at] / s[at]
    return out


def similarity(pairs: DataFrame, keys: Keys, source: str, target: str) -> DataFrame:
    """Scale, rotation and shift that bring source points nearest to their targets by least squares, per key: ``scale``, ``q``, ``p`` and ``n``."""
    at = lambda c, i: F.col(c).getItem(i)
    sums = [F.sum(at(c, i)).alias(f"{s}{i}") for s, c in (("a", source), ("b", target)) for i in range(3)]
    sums += [F.sum(at(target, r) * at(source, c)).alias(f"m{r}{c}") for r in range(3) for c in range(3)]
    sums += [F.sum(at(source, 0) * at(source, 0) + at(source, 1) * at(source, 1) + at(source, 2) * at(source, 2)).alias("aa"), F.count("*").alias("n")]
    names = [f"{s}{i}" for s in "ab" for i in range(3)] + [f"m{r}{c}" for r in range(3) for c in range(3)] + ["aa", "n"]

    @F.pandas_udf("struct<scale: double, q: array<double>, p: array<double>>")
    def solve(*columns: pd.Series) -> pd.DataFrame:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        n = x[:, 16]
        a, b = x[:, :3] / n[:, None], x[:, 3:6] / n[:, None]
        covariance = x[:, 6:15].reshape(-1, 3, 3) / n[:, None, None] - b[:, :, None] * a[:, None, :]
        spread = np.maximum(x[:, 15] / n - (a * a).sum(1), 1e-300)
        u, s, vt = np.linalg.svd(covariance)
        sign = np.ones_like(s)
        sign[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
        turn = (u * sign[:, None, :]) @ vt
        scale = (s * sign).sum(1) / spread
        shift = b - scale[:, None] * (turn @ a[:, :, None])[:, :, 0]
        return pd.DataFrame({"scale": scale, "q": list(_quaternions(turn)), "p": list(shift)})

    rows = pairs.groupBy(*keys).agg(*sums).withColumn("_s", solve(*(F.col(c).cast("double") for c in names)))
    return rows.select(*keys, F.col("_s.scale").alias("scale"), F.col("_s.q").alias("q"), F.col("_s.p").alias("p"), "n")


def triangulated(views: DataFrame, keys: Keys, matrix: str, x: str, y: str) -> DataFrame:
    """The point that views of it, each with a 3 x 4 projection (an array of twelve by rows) and a pixel, agree on best; null ``point`` with fewer than two views."""
    at = lambda r, c: F.element_at(matrix, 4 * r + c + 1)
    first = [F.col(x) * at(2, c) - at(0, c) for c in range(4)]
    second = [F.col(y) * at(2, c) - at(1, c) for c in range(4)]
    sums = [F.sum(first[i] * first[j] + second[i] * second[j]).alias(f"s{i}{j}") for i in range(4) for j in range(4)]

    @F.pandas_udf("array<double>")
    def solve(*columns: pd.Series) -> pd.Series:
        system = np.column_stack([c.to_numpy(dtype=float) for c in columns]).reshape(-1, 4, 4)
        v = np.linalg.eigh(system)[1][:, :, 0]
        return pd.Series(list(v[:, :3] / v[:, 3:]))

    rows = views.groupBy(*keys).agg(*sums, F.count("*").alias("n"))
    point = solve(*(F.col(f"s{i}{j}") for i in range(4) for j in range(4)))
    return rows.select(*keys, "n", point.alias("_p")).select(*keys, "n", F.when(F.col("n") >= 2, F.col("_p")).alias("point"))
