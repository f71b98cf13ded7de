"""Contacts and swept areas against plain loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import contacts


def box_at(frames, t, gap):
    for k in frames:
        if k[0] == t:
            return None if k[5] else k[1:5]
    before, after = [k for k in frames if k[0] < t], [k for k in frames if k[0] > t]
    if not before or not after:
        return None
    a, b = before[-1], after[0]
    if a[5] or b[5] or b[0] - a[0] > gap:
        return None
    r = (t - a[0]) / (b[0] - a[0])
    return [p + (q - p) * r for p, q in zip(a[1:5], b[1:5], strict=True)]


def test_nearest_targets_and_runs(spark):
    rng = np.random.default_rng(8)
    points, boxes, want = [], [], []
    for key in (1, 2):
        tracks = {}
        for e in ("e1", "e2", "e3"):
            ts = np.sort(rng.choice(np.arange(0, 2000, 10), 25, replace=False))
            walk = np.cumsum(rng.normal(0, 8, (25, 2)), axis=0) + 50
            tracks[e] = [(int(t), float(x), float(y), 20.0, 15.0, bool(rng.random() < 0.1)) for t, (x, y) in zip(ts, walk, strict=True)]
            boxes += [(key, e, *f) for f in tracks[e]]
        frames = {int(t): rng.normal(60, 15, (3, 2)) for t in range(0, 2000, 15)}
        points += [(key, t, float(x), float(y)) for t, p in frames.items() for x, y in p]
        runs = []
        for t, tips in frames.items():
            best = None
            for e, f in tracks.items():
                if (b := box_at(f, t, 120)) is not None:
                    d = min(math.hypot(max(b[0] - x, 0, x - b[0] - b[2]), max(b[1] - y, 0, y - b[1] - b[3])) for x, y in tips)
                    if d <= 12 and (best is None or d < best[0]):
                        best = (d, e)
            if best:
                if runs and runs[-1][2] == best[1] and t - runs[-1][1] <= 40:
                    runs[-1][1] = t
                else:
                    runs.append([t, t, best[1]])
        want += [(key, e, s, t) for s, t, e in runs if t - s >= 15]
    got = contacts.video_contacts(spark.createDataFrame(points, "k int, t long, px double, py double").repartition(3), spark.createDataFrame(boxes, "k int, entity string, t long, x double, y double, w double, h double, outside boolean"), ["k"], "t", 12, 120, 40, 15, 200)
    assert sorted(map(tuple, got.select("k", "entity", "start", "end").collect())) == sorted(want)
    assert len(want) > 10


def plain_contacts(samples, on, off, gap, merge, least):
    runs, current, last, prev = [], None, None, None
    for t, d, inside in samples:
        if current is not None and t - prev > gap:
            runs.append((current, last))
            current = None
        prev = t
        ok = inside and d is not None
        if current is None:
            if ok and d <= on:
                current = last = t
        elif not ok or d > off:
            runs.append((current, last))
            current = None
        if current is not None and d <= on:
            last = t
    if current is not None:
        runs.append((current, last))
    out = []
    for s, e in runs:
        if out and s - out[-1][1] <= merge:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return [r for r in out if r[1] - r[0] >= least]


def test_gates_and_hysteresis(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for key in range(5):
        t = np.cumsum(rng.choice([10, 10, 10, 70], 300))
        d = np.abs(np.cumsum(rng.normal(0, 1, 300))) % 9
        samples = [(int(a), None if rng.random() < 0.02 else float(b), bool(rng.random() < 0.95)) for a, b in zip(t, d, strict=True)]
        rows += [(key, i, *s) for i, s in enumerate(samples)]
        want += [(key, *r) for r in plain_contacts(samples, 2.0, 5.0, 50, 30, 20)]
    df = spark.createDataFrame(rows, "k int, id long, t long, d double, ok boolean").repartition(4)
    got = contacts.surface_contacts(df, ["k"], "t", "id", "d", F.col("ok"), 2.0, 5.0, 50, 30, 20)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > 20


def plain_coverage(runs, width, height, radius, grid):
    nx, ny = max(1, math.ceil(width / grid)), max(1, math.ceil(height / grid))
    covered = set()
    for points in runs:
        points = [(a * width, b * height) for a, b in points]
        for (ax, ay), (bx, by) in itertools.pairwise(points) if len(points) > 1 else [(points[0], points[0])]:
            for i in range(nx):
                for j in range(ny):
                    x, y, dx, dy = (i + 0.5) * width / nx, (j + 0.5) * height / ny, bx - ax, by - ay
                    u = min(1, max(0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
                    if math.hypot(x - ax - u * dx, y - ay - u * dy) <= radius:
                        covered.add((i, j))
    return len(covered) / (nx * ny)


def test_swept_area(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for key, (n, wide) in {1: (3, 0.31), 2: (1, 0.05), 3: (2, 1.0)}.items():
        runs = [rng.uniform(-0.1, 1.1, (int(rng.integers(1, 6)), 2)) for _ in range(n)]
        if key == 2:
            runs = [np.array([[9.0, 9.0]])]
        rows += [(key, c, i, i, float(a), float(b), wide, 0.4) for c, run in enumerate(runs) for i, (a, b) in enumerate(run)]
        want[key] = plain_coverage(runs, wide, 0.4, 0.04, 0.02)
    df = spark.createDataFrame(rows, "k int, c int, id int, t int, a double, b double, width double, height double").repartition(3)
    got = {r.k: r.ratio for r in contacts.coverage(df, ["k"], "c", "t", "id", 0.04, 0.02).collect()}
    assert got == pytest.approx(want) and want[2] == 0 and 0 < want[1] < 1


def test_tool_points_in_a_moving_surface(spark):
    corners = [(1, 0, t, [float(t) / 100, 0.0, 0.0]) for t in (0, 100, 900)] + [(1, 1, t, [2 + float(t) / 100, 0.0, 0.0]) for t in (0, 100, 900)] + [(1, 2, t, [float(t) / 100, 1.0, 0.0]) for t in (0, 100, 900)]
    tool = [(1, 0, 50, [1.5, 0.25, 0.1]), (1, 1, 100, [2.0, 0.5, -0.2]), (1, 2, 500, [0.0, 0.0, 0.0])]
    rows = contacts.surface_samples(spark.createDataFrame(tool, "k int, id long, t long, p array<double>"), spark.createDataFrame(corners, "k int, corner int, t long, v array<double>"), ["k"], "t", "id", 200)
    got = {r.id: (r.a, r.b, r.distance, r.width, r.height) for r in rows.collect()}
    assert got[0] == pytest.approx((0.5, 0.25, 0.1, 2.0, 1.0)) and got[1] == pytest.approx((0.5, 0.5, 0.2, 2.0, 1.0))
    assert got[2] == (None,) * 5
