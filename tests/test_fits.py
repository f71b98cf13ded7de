"""Hands fitted in batches against a solver for one hand; quartiles against the standard library."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import fits

LIMITS = fits.HandLimits(least_points=6, most_error=0.3, rotation_prior=0.05, most_rotation=40, reference_palm=0.09, depth_weight=0.5, most_scale_ratio=1.6, anchors=(0, 5, 9, 13, 17))


def exp(v):
    a = np.linalg.norm(v)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k if a < 1e-12 else np.eye(3) + np.sin(a) / a * k + (1 - np.cos(a)) / a**2 * k @ k


def one_hand(world, pixels, seen, depth, camera):
    fx, fy, cx, cy = camera
    w, p = world[seen], pixels[seen]
    ray = np.stack([(p[:, 0] - cx) / fx, (p[:, 1] - cy) / fy], axis=1)
    a, b = [], []
    for (x, y, z), (u, v) in zip(w, ray, strict=True):
        a += [[1, 0, -u], [0, 1, -v]]
        b += [u * z - x, v * z - y]
    t = np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0]
    size, centre = max(np.sqrt(np.mean(np.sum((ray - ray.mean(0)) ** 2, axis=1))), 1e-9), w.mean(0)

    def errors(x):
        y = (w - centre) @ exp(x[:3]).T + centre + x[3:]
        return np.concatenate([((y[:, :2] / y[:, 2:] - ray) / size).ravel(), 0.05 * x[:3]])

    x = np.concatenate([np.zeros(3), t])
    for _ in range(12):
        at = errors(x)
        jac = np.stack([(errors(x + 1e-6 * np.eye(6)[j]) - at) / 1e-6 for j in range(6)], axis=1)
        step = np.linalg.lstsq(jac, -at, rcond=None)[0]
        x = x + step
        if np.linalg.norm(step) < 1e-9:
            break
    rms = lambda y: np.sqrt(np.mean(((y[:, 0] / y[:, 2] - ray[:, 0]) * fx) ** 2 + ((y[:, 1] / y[:, 2] - ray[:, 1]) * fy) ** 2))
    plain, turned = w + t, (w - centre) @ exp(x[:3]).T + centre + x[3:]
    use = math.degrees(np.linalg.norm(x[:3])) <= 40 and (turned[:, 2] > 0).all() and rms(turned) < rms(plain)
    cam = (world - centre) @ exp(x[:3]).T + centre + x[3:] if use else world + t
    error = rms(cam[seen]) / np.sqrt(np.mean(np.sum((p - p.mean(0)) ** 2, axis=1)))
    if seen.sum() < 6 or (cam[:, 2] <= 0).any() or error > 0.3:
        return None
    palm = np.linalg.norm(world[9] - world[0])
    ratios = [depth[j] / cam[j, 2] for j in LIMITS.anchors if seen[j] and not np.isnan(depth[j])]
    kd, ks = (np.median(ratios) if ratios else None), 0.09 / palm
    k = ks if kd is None or max(kd / ks, ks / kd) > 1.6 else math.exp(0.5 * math.log(kd) + 0.5 * math.log(ks))
    return cam * k, error, k * palm, None if kd is None else kd * palm


def test_hands_of_a_batch(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for i in range(60):
        world = rng.normal(0, 0.04, (21, 3))
        camera = (800.0 + 10 * i, 790.0, 640.0, 360.0)
        place = (world @ exp(rng.normal(0, 0.15, 3)).T + np.array([*rng.normal(0, 0.1, 2), rng.uniform(0.3, 0.8)])) * rng.uniform(0.8, 1.2)
        pixels = place[:, :2] / place[:, 2:] * camera[:2] + camera[2:] + rng.normal(0, 40 if i % 9 == 0 else 1, (21, 2))
        seen = rng.random(21) < (0.2 if i % 7 == 0 else 0.9)
        depth = np.where(rng.random(21) < 0.7, place[:, 2] * (3 if i % 5 == 0 else 1), np.nan)
        rows.append((i, world.tolist(), pixels.tolist(), seen.tolist(), [None if np.isnan(d) else float(d) for d in depth], *camera))
        if (fit := one_hand(world, pixels, seen, depth, camera)) is not None:
            want[i] = fit
    schema = "id int, world array<array<double>>, pixels array<array<double>>, visible array<boolean>, depth array<double>, fx double, fy double, cx double, cy double"
    got = {r.id: r for r in fits.fitted_hands(spark.createDataFrame(rows, schema).repartition(3), ["id"], LIMITS).collect()}
    assert got.keys() == want.keys() and 20 < len(want) < 60
    for i, (points, error, palm, by_depth) in want.items():
        assert np.allclose(got[i].points, points, atol=1e-6) and got[i].error == pytest.approx(error, abs=1e-6) and got[i].palm == pytest.approx(palm, abs=1e-6)
        assert got[i].palm_from_depth == (by_depth if by_depth is None else pytest.approx(by_depth, abs=1e-6))
    assert any(r.scale_ratio is None for r in got.values()) and any(r.scale_ratio for r in got.values())


def test_quartiles_and_focal_lengths(spark):
    rng = np.random.default_rng(1)
    values = {n: [float(x) for x in rng.uniform(0.05, 0.15, n)] for n in (1, 2, 3, 4, 5, 30)}
    df = spark.createDataFrame([(n, v) for n, vs in values.items() for v in vs], "k int, v double")
    got = {r.k: r for r in fits.quartiles(df, ["k"], "v").collect()}
    for n, vs in values.items():
        q = statistics.quantiles(vs, n=4) if n > 1 else vs * 3
        assert (got[n].q1, got[n].q3, got[n].median) == pytest.approx((q[0], q[2], statistics.median(vs)))
    rows = fits.focal_lengths(df, ["k"], "v", F.lit(0.1), F.lit(1920), 70.0, 3, 0.9, (30.0, 120.0)).collect()
    for r in rows:
        m = statistics.median(v / 0.1 for v in values[r.k])
        fx = 1920 / 2 / math.tan(math.radians(35)) * m
        assert (r.fx, r.fov) == pytest.approx((fx, math.degrees(2 * math.atan(960 / fx)))) and r.n >= 3
    assert 30 in {r.k for r in rows} and not {1, 2} & {r.k for r in rows}
