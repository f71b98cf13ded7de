"""Fits of many small problems at once: hands in front of a camera, and a camera's focal length from them.

A hand's normal equations are sums over its joints; a task adds them up and solves them for all hands of an Arrow
batch together, so that Python never goes through rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Keys = Sequence[str]
#: Joints between which a palm is measured.
PALM = (0, 9)


@dataclass(frozen=True)
class HandLimits:
    least_points: int
    most_error: float
    rotation_prior: float
    most_rotation: float
    reference_palm: float | None
    depth_weight: float
    most_scale_ratio: float
    anchors: tuple[int, ...]
    rounds: int = 12


def rotations(v: np.ndarray) -> np.ndarray:
    """Matrices of rotation vectors."""
    angle = np.linalg.norm(v, axis=-1)[..., None, None]
    k = np.zeros((*v.shape[:-1], 3, 3))
    k[..., 0, 1], k[..., 0, 2], k[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    k -= np.swapaxes(k, -1, -2)
    return np.eye(3) + np.sinc(angle / np.pi) * k + 0.5 * np.sinc(angle / (2 * np.pi)) ** 2 * (k @ k)


def shifts(world: np.ndarray, rays: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The shift that brings each hand's points nearest to their rays (x / z, y / z), by least squares over the seen ones."""
    a = np.zeros((*rays.shape, 3))
    a[..., 0, 0] = a[..., 1, 1] = 1
    a[..., 2] = -rays
    b = rays * world[..., 2:] - world[..., :2]
    a, b = a * seen[..., None, None], b * seen[..., None]
    normal, right = np.einsum("njri,njrk->nik", a, a), np.einsum("njri,njr->ni", a, b)
    return np.einsum("nij,nj->ni", np.linalg.pinv(normal), right)


def moved(x: np.ndarray, world: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Points turned about the centre by the first three numbers of ``x`` and shifted by the others."""
    return np.einsum("nij,nkj->nki", rotations(x[:, :3]), world - centre[:, None]) + (centre + x[:, 3:])[:, None]


def refined(world: np.ndarray, rays: np.ndarray, seen: np.ndarray, shift: np.ndarray, prior: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Turn and shift of each hand that bring its seen points to their rays, with turns held back by ``prior``: Gauss-Newton, and the centre that it turns about."""
    n = np.maximum(seen.sum(1), 1)[:, None]
    centre = (world * seen[..., None]).sum(1) / n
    spread = rays - ((rays * seen[..., None]).sum(1) / n)[:, None]
    size = np.maximum(np.sqrt(((spread**2).sum(2) * seen).sum(1) / n[:, 0]), 1e-9)

    def errors(x: np.ndarray) -> np.ndarray:
        y = moved(x, world, centre)
        flat = (y[..., :2] / np.where(np.abs(y[..., 2:]) < 1e-12, 1e-12, y[..., 2:]) - rays) * seen[..., None] / size[:, None, None]
        return np.concatenate([flat.reshape(len(x), -1), prior * x[:, :3]], axis=1)

    x = np.concatenate([np.zeros((len(world), 3)), shift], axis=1)
    open_ = np.ones(len(world), dtype=bool)
    for _ in range(rounds):
        at = errors(x)
        jacobian = np.stack([(errors(x + 1e-6 * np.eye(6)[j]) - at) / 1e-6 for j in range(6)], axis=2)
        step = -np.einsum("nij,nj->ni", np.linalg.pinv(np.einsum("nri,nrk->nik", jacobian, jacobian)), np.einsum("nri,nr->ni", jacobian, at))
        x = np.where(open_[:, None], x + step, x)
        open_ &= np.linalg.norm(step, axis=1) >= 1e-9
        if not open_.any():
            break
    return x, centre


def _pixel_rms(points: np.ndarray, rays: np.ndarray, seen: np.ndarray, focal: np.ndarray) -> np.ndarray:
    off = (points[..., :2] / np.where(points[..., 2:] == 0, np.nan, points[..., 2:]) - rays) * focal[:, None]
    return np.sqrt(np.where(seen, (off**2).sum(2), 0).sum(1) / np.maximum(seen.sum(1), 1))


def hands(world: np.ndarray, pixels: np.ndarray, seen: np.ndarray, depth: np.ndarray, camera: np.ndarray, limits: HandLimits) -> dict[str, np.ndarray]:
    """Fits of a batch: ``ok``, ``points``, ``rms``, ``error`` (by the hand's size in the picture), ``scale_ratio``, ``palm``, ``palm_from_depth``; NaN where there is none."""
    focal, middle = camera[:, :2], camera[:, 2:]
    rays = (pixels - middle[:, None]) / focal[:, None]
    shift = shifts(world, rays, seen)
    plain = world + shift[:, None]
    points, rms = plain, _pixel_rms(plain, rays, seen, focal)
    if limits.rotation_prior > 0:
        x, centre = refined(world, rays, seen, shift, limits.rotation_prior, limits.rounds)
        turned = moved(x, world, centre)
        better = _pixel_rms(turned, rays, seen, focal)
        use = (seen.sum(1) >= 4) & (np.degrees(np.linalg.norm(x[:, :3], axis=1)) <= limits.most_rotation) & ~(seen & (turned[..., 2] <= 0)).any(1) & (better < rms)
        points, rms = np.where(use[:, None, None], turned, plain), np.where(use, better, rms)
    n = np.maximum(seen.sum(1), 1)[:, None]
    flat = pixels - ((pixels * seen[..., None]).sum(1) / n)[:, None]
    error = rms / np.maximum(np.sqrt(((flat**2).sum(2) * seen).sum(1) / n[:, 0]), 1e-9)
    ok = (seen.sum(1) >= limits.least_points) & (points[..., 2] > 0).all(1) & (error <= limits.most_error)
    anchors = list(limits.anchors)
    ratios = np.where(seen[:, anchors], depth[:, anchors] / points[:, anchors, 2], np.nan)
    with np.errstate(all="ignore"):
        by_depth = np.array([np.median(r[~np.isnan(r)]) if (~np.isnan(r)).any() else np.nan for r in ratios]) if len(ratios) else np.zeros(0)
        palm = np.linalg.norm(world[:, PALM[1]] - world[:, PALM[0]], axis=1)
        by_size = np.where(palm > 0, (limits.reference_palm or 0) / np.where(palm > 0, palm, 1), 1.0) if limits.reference_palm else np.ones(len(palm))
        apart = np.maximum(by_depth / by_size, by_size / by_depth)
        agree = (by_depth > 0) & (apart <= limits.most_scale_ratio)
        scale = np.where(agree, np.exp(limits.depth_weight * np.log(np.where(agree, by_depth, 1)) + (1 - limits.depth_weight) * np.log(by_size)), by_size)
    return {"ok": ok, "points": points * scale[:, None, None], "rms": rms, "error": error, "scale_ratio": np.where(agree, apart, np.nan), "palm": scale * palm, "palm_from_depth": np.where(by_depth > 0, by_depth * palm, np.nan)}


def fitted_hands(rows: DataFrame, keys: Keys, limits: HandLimits) -> DataFrame:
    """Hands (``keys``; ``world`` and ``pixels``, arrays of points; ``visible``; ``depth``, the measured depth at each joint or null; ``fx``, ``fy``, ``cx``, ``cy``) in front of their camera. Hands that can't be fitted go."""
    schema = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL("points array<array<double>>, rms double, error double, n_visible long, scale_ratio double, palm double, palm_from_depth double").fields])
    arrow = to_arrow_schema(schema)

    def dense(column: pa.Array, *shape: int) -> np.ndarray:
        while pa.types.is_list(column.type):
            column = column.flatten()
        return column.to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            seen = dense(b.column("visible"), len(b.column("visible")[0])).astype(bool)
            joints = seen.shape[1]
            camera = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("fx", "fy", "cx", "cy")])
            out = hands(dense(b.column("world"), joints, 3), dense(b.column("pixels"), joints, 2), seen, dense(b.column("depth"), joints), camera, limits)
            ok = pa.array(out["ok"])
            columns = [*(b.column(k) for k in keys), pa.array(out["points"].tolist(), type=arrow.field("points").type), out["rms"], out["error"], seen.sum(1), *(out[c] for c in ("scale_ratio", "palm", "palm_from_depth"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type, from_pandas=True) for c, f in zip(columns, arrow, strict=True)], schema=arrow).filter(ok)

    whole = rows.where("world is not null and pixels is not null and visible is not null and depth is not null")
    return whole.select(*keys, "world", "pixels", "visible", "depth", *(F.col(c).cast("double").alias(c) for c in ("fx", "fy", "cx", "cy"))).mapInArrow(run, schema)


def quartiles(rows: DataFrame, keys: Keys, value: str) -> DataFrame:
    """``n``, the median, and the quartiles ``q1``, ``q3`` by the exclusive rule (places (n + 1) / 4 and 3 (n + 1) / 4, between neighbours in proportion, the outermost pair beyond the ends); with one row all are its value."""
    line = W.Window.partitionBy(*keys).orderBy(value)
    placed = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.row_number().over(line).alias("_i"), F.count(F.lit(1)).over(W.Window.partitionBy(*keys)).alias("n"))

    def at(quarter: int) -> Column:
        place = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(quarter * (F.col("n") + 1) / 4)))
        share = quarter * (F.col("n") + 1) / 4 - place
        weight = F.when(F.col("n") == 1, 1.0).when(F.col("_i") == place, 1 - share).when(F.col("_i") == place + 1, share)
        return F.sum(F.col("_v") * weight)

    return placed.groupBy(*keys, "n").agg(F.percentile("_v", F.lit(0.5)).alias("median"), at(1).alias("q1"), at(3).alias("q3"))


def focal_lengths(samples: DataFrame, keys: Keys, palm: str, prior: Column, width: Column, default_fov: float, least: int, most_spread: float, fov_range: tuple[float, float]) -> DataFrame:
    """``fx``, ``fov`` (degrees across), ``n`` and ``spread`` for each key: measured palms against the known one scale the focal length of the default field of view. Keys with too few samples, too much spread, or a field of view out of range go."""
    rows = samples.withColumn("_r", F.col(palm) / F.when(prior > 0, prior)).withColumn("_w", width)
    sizes = rows.groupBy(*keys).agg(F.max("_w").alias("_w"))
    out = quartiles(rows, keys, "_r").join(sizes, list(keys))
    spread = (F.col("q3") - F.col("q1")) / F.when(F.col("median") > 0, F.col("median"))
    fx = F.col("_w") / (2 * F.tan(F.lit(np.radians(default_fov) / 2))) * F.col("median")
    out = out.select(*keys, fx.alias("fx"), F.degrees(2 * F.atan(F.col("_w") / (2 * fx))).alias("fov"), "n", spread.alias("spread"))
    return out.where((F.col("n") >= least) & (F.col("spread") <= most_spread) & F.col("fov").between(*fov_range))
