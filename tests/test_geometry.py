"""Rotations, poses, fits, masks and signals against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.functions import geometry, rotations, runlength
from weftline.operators import picks, poses, signals


def matrix(v):
    """Rotation matrix of a rotation vector, by the series of its cross-product matrix."""
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    out, term = np.eye(3), np.eye(3)
    for i in range(1, 40):
        term = term @ k / i
        out = out + term
    return out


def test_rotations_are_matrices(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=3).tolist(), rng.normal(size=3).tolist(), rng.normal(size=3).tolist(), float(rng.random())) for i in range(20)] + [(20, [0.0] * 3, [0.0] * 3, [1.0, 2.0, 3.0], 0.5), (21, [math.pi - 1e-6, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 1.0, 0.0], 0.3)]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>, v array<double>, s double")
    a, b = rotations.exponential(F.col("a")), rotations.exponential(F.col("b"))
    got = df.select("i", rotations.to_matrix(rotations.times(a, b)).alias("ab"), rotations.rotated(a, F.col("v")).alias("av"), rotations.logarithm(a).alias("log"), rotations.to_matrix(rotations.from_matrix(rotations.to_matrix(a))).alias("back"), rotations.to_matrix(rotations.slerp(a, b, F.col("s"))).alias("mid"), rotations.angle(a, b).alias("angle")).collect()
    for r in got:
        _, va, vb, v, s = rows[r.i]
        ma, mb = matrix(va), matrix(vb)
        assert np.allclose(np.reshape(r.ab, (3, 3)), ma @ mb) and np.allclose(r.av, ma @ v) and np.allclose(np.reshape(r.back, (3, 3)), ma)
        turn = math.acos(max(-1.0, min(1.0, (np.trace(ma.T @ mb) - 1) / 2)))
        assert r.angle == pytest.approx(turn, abs=1e-6) and np.allclose(matrix(np.array(r.log)), ma)
        mid = np.reshape(r.mid, (3, 3))
        assert math.acos(max(-1.0, min(1.0, (np.trace(ma.T @ mid) - 1) / 2))) == pytest.approx(s * turn, abs=1e-6)


def test_similarity_and_triangulation_find_what_was_done(spark):
    rng = np.random.default_rng(1)
    r, p = matrix(np.array([0.3, -1.2, 0.4])), np.array([1.0, -2.0, 0.5])
    points = rng.normal(size=(30, 3))
    df = spark.createDataFrame([(1, x.tolist(), (1.7 * r @ x + p).tolist()) for x in points], "k int, a array<double>, b array<double>")
    got = poses.similarity(df, ["k"], "a", "b").select("scale", rotations.to_matrix(F.col("q")).alias("m"), "p", "n").first()
    assert got.scale == pytest.approx(1.7) and np.allclose(np.reshape(got.m, (3, 3)), r) and np.allclose(got.p, p) and got.n == 30
    views = []
    for i, x in enumerate(points[:3]):
        for j in range(1 + 2 * (i < 2)):
            camera = np.column_stack([matrix(rng.normal(size=3)), [0, 0, 8 + j]])
            h = camera @ [*x, 1]
            views.append((i, camera.ravel().tolist(), float(h[0] / h[2]), float(h[1] / h[2])))
    found = {r.k: r.point for r in poses.triangulated(spark.createDataFrame(views, "k int, m array<double>, x double, y double"), ["k"], "m", "x", "y").collect()}
    assert np.allclose(found[0], points[0]) and np.allclose(found[1], points[1]) and found[2] is None


def test_poses_and_relative_errors(spark):
    rows = [(1, i, float(i), [math.cos(0.1 * i), 0.0, 0.0, math.sin(0.1 * i)], [float(i), 0.0, 0.0]) for i in range(0, 10, 2)]
    given = spark.createDataFrame(rows, "k int, id int, t double, q array<double>, p array<double>")
    asked = spark.createDataFrame([(1, 100, 3.0, [1.0, 0.0, 0.0]), (1, 101, 4.0, [1.0, 0.0, 0.0]), (1, 102, 99.0, [1.0, 0.0, 0.0])], "k int, id int, t double, v array<double>")
    got = {r.id: r.world for r in poses.in_world(asked, ["k"], "t", "id", given, "id", 2.0).collect()}
    assert set(got) == {100, 101} and np.allclose(got[100], [3 + math.cos(0.6), math.sin(0.6), 0]) and np.allclose(got[101], [4 + math.cos(0.8), math.sin(0.8), 0])
    exact = given.withColumn("tq", F.col("q")).withColumn("tp", F.transform("p", lambda x: x + 5))
    row = poses.relative_error(exact, ["k"], ["t"]).first()
    # A shift of all places in the world turns with the frame, so moves differ by nothing.
    assert row.n == 4 and row.angle_error == pytest.approx(0, abs=1e-9) and row.place_error == pytest.approx(0, abs=1e-9)


def test_masks_come_back_and_their_runs_say_their_boxes(spark):
    rng = np.random.default_rng(2)
    masks = [rng.random((h, w)) < share for h, w, share in [(5, 7, 0.5), (1, 1, 1.0), (9, 3, 0.1), (40, 60, 0.5), (4, 4, 0.0), (300, 2, 1.0)]]
    df = spark.createDataFrame([(i, m.tolist(), *m.shape) for i, m in enumerate(masks)], "i int, m array<array<boolean>>, h int, w int")
    coded = df.select("i", "h", "w", runlength.encode(F.col("m")).alias("t")).persist()
    for r in coded.select("i", runlength.decode(F.col("t"), F.col("h"), F.col("w")).alias("m"), runlength.area_and_box(F.col("t"), F.col("h")).alias("b")).collect():
        m = masks[r.i]
        ys, xs = np.nonzero(m)
        box = (xs.min(), ys.min(), xs.max() - xs.min() + 1, ys.max() - ys.min() + 1) if len(xs) else (0, 0, 0, 0)
        assert np.array_equal(np.array(r.m), m) and tuple(r.b)[0] == m.sum()
        assert tuple(r.b)[1::2] == box[0::2] or not len(xs)
    assert runlength.written([2, 3, 1]) == "231" and runlength.read(runlength.written([0, 100000, 3, 99999, 7])) == [0, 100000, 3, 99999, 7]


def test_projective_transforms_undo_each_other(spark):
    m = [1.1, 0.2, 3.0, -0.1, 0.9, 2.0, 0.001, 0.002, 1.0]
    df = spark.range(1).select(F.array(*map(F.lit, m)).alias("m"), F.lit(4.0).alias("x"), F.lit(5.0).alias("y"))
    df = df.withColumn("back", geometry.composed(geometry.inverted(F.col("m")), F.col("m")))
    x, y = geometry.projected(F.col("back"), F.col("x"), F.col("y"))
    assert tuple(df.select(x, y).first()) == pytest.approx((4, 5))
    u, v, off = geometry.surface_place(*(tuple(map(F.lit, p)) for p in [(0.0, 0.0, 0.0), (2.0, 0.0, 0.0), (0.0, 4.0, 0.0), (1.0, 1.0, -3.0)]))
    assert tuple(spark.range(1).select(u, v, off).first()) == (0.5, 0.25, 3.0)


def test_offsets_peaks_and_wearers(spark):
    taps = [1.0, 4.5, 9.0, 9.5, 20.0]
    ref = spark.createDataFrame([(1, t + 2.37) for t in taps], "k int, at double")
    tgt = spark.createDataFrame([(1, t) for t in [*taps, 13.0]], "k int, at double")
    got = signals.offset_votes(ref, tgt, ["k"], "at", 6.0, 0.1).first()
    assert got.offset == pytest.approx(2.37) and got.votes == 5 and got.second < 5
    curve = spark.createDataFrame([(1, i, math.exp(-((i - 3.3) ** 2) / 8)) for i in range(-20, 21)], "k int, lag int, c double")
    top = signals.peak(curve, ["k"], "lag", "c", 8).first()
    assert top.lag == pytest.approx(3.3, abs=0.05) and top.prominence > 10
    rng = np.random.default_rng(3)
    base = rng.random(50)
    one = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(base)], "k int, t int, speed double")
    people = [(1, "a", i, float(x + 0.1 * rng.random())) for i, x in enumerate(base)] + [(1, "b", i, float(rng.random())) for i in range(50)] + [(1, "c", i, float(base[i])) for i in range(5)]
    assert signals.best_correlated(one, spark.createDataFrame(people, "k int, who string, t int, speed double"), ["k"], "who", "t", 20, 0.5).first().who == "a"
    steps = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 10, 10.0, 0.0, 1.0)], "k int, t int, x double, y double, z double")
    assert tuple(signals.faster(steps, ["k"], "t", [("x", "y"), ("z", "y")]).select("at", "speed").first()) == (5.0, 1.0)


def test_least_loaded_is_one_by_one(spark):
    loads = {"ada": 3, "ben": 0, "cy": 9}
    units = spark.range(40)
    got = {r.id: r.who for r in picks.least_loaded(units, "id", [F.asc("id")], spark.createDataFrame(list(loads.items()), "who string, n long"), "who", "n").collect()}
    now = dict(loads)
    for i in range(40):
        who = min(now, key=lambda w: (now[w], w))
        now[who] += 1
        assert got[i] == who
