"""Orientation, descriptor matches and robust similarities against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import orientation, scenes

REST = orientation.Rest(window=200, acc_spread=0.2, turn_spread=0.05, turn_mean=0.1, gravity=9.81, tolerance=0.5)


def times(a, b):
    w, x, y, z = a
    p, q, r, s = b
    return np.array([w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p])


def plain_path(t, gyro, bias, start):
    out, q = [start], start
    for k in range(1, len(t)):
        v = ((gyro[k] + gyro[k - 1]) / 2 - bias) * (t[k] - t[k - 1]) / 1000
        angle = np.linalg.norm(v)
        q = times(q, np.concatenate([[np.cos(angle / 2)], v / angle * np.sin(angle / 2) if angle else v]))
        out.append(q)
    return np.array(out)


def test_orientation_is_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for key, (rests, gap) in {1: (True, None), 2: (False, None), 3: (True, 300), 4: (True, 5)}.items():
        n = 600
        t = np.cumsum(rng.uniform(8, 12, n))
        gyro = np.cumsum(rng.normal(0, 0.05, (n, 3)), axis=0)
        gyro[:30] = (0.02, -0.01, 0.03) if rests else (0.5, 0.2, 0.1)
        acc = np.tile([0.3, 0.1, 9.8], (n, 1))
        if gap:
            t[gap:] += 500
        rows += [(key, i, float(t[i]), *map(float, acc[i]), *map(float, gyro[i])) for i in range(n)]
        early = t <= t[0] + REST.window
        if gap == 5:
            continue
        start = orientation.first_orientation(acc[early].mean(0), np.array([1.0, 0.0, 0.0]))
        stop = gap or n
        want[key] = plain_path(t[:stop], gyro[:stop], gyro[early].mean(0) if rests else np.zeros(3), start)
    df = spark.createDataFrame(rows, "k int, id long, t double, ax double, ay double, az double, gx double, gy double, gz double").repartition(7)
    got = orientation.integrated(df, ["k"], "t", "id", ["ax", "ay", "az"], ["gx", "gy", "gz"], REST, 100, 700).collect()
    assert {r.k for r in got} == set(want)
    for k, path in want.items():
        mine = sorted((r.id, r.q) for r in got if r.k == k)
        assert [i for i, _ in mine] == list(range(len(path)))
        assert np.abs(np.array([q for _, q in mine]) - path).max() < 1e-9
    assert {(r.k, r.rested) for r in got} == {(1, True), (2, False), (3, True)}
    # The first orientation turns what is up to z, and keeps forward level.
    q = want[1][0]
    up = times(times(q, [0, *np.array([0.3, 0.1, 9.8]) / np.linalg.norm([0.3, 0.1, 9.8])]), q * [1, -1, -1, -1])
    assert np.allclose(up, [0, 0, 0, 1])


def test_prefix_products_by_doubling():
    rng = np.random.default_rng(0)
    q = orientation.turned(rng.normal(size=(37, 3)))
    want = [q[0]]
    for x in q[1:]:
        want.append(times(want[-1], x))
    assert np.allclose(orientation.products(q), want)


def turn(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


@pytest.mark.parametrize("block", [2048, 7])
def test_matches_are_brute_force(spark, block):
    rng = np.random.default_rng(7)
    a, b, want = [], [], set()
    for key, (n, m) in {1: (40, 50), 2: (1, 9), 3: (25, 25)}.items():
        left, right = rng.normal(size=(n, 6)), rng.normal(size=(m, 6))
        right[: min(n, m) // 2] = left[: min(n, m) // 2] + rng.normal(0, 0.05, (min(n, m) // 2, 6))
        right[-1] = right[0]
        a += [(key, i, v.tolist()) for i, v in enumerate(left)]
        b += [(key, 100 + i, v.tolist()) for i, v in enumerate(right)]
        d = np.linalg.norm(left[:, None] - right[None], axis=2)
        if n > 1:
            for i in range(n):
                j = int(np.argmin(d[i]))
                if np.argmin(d[:, j]) == i and d[i, j] < 0.8 * np.sort(d[i])[1]:
                    want.add((key, i, 100 + j))
    schema = "k int, id long, v array<double>"
    got = scenes.match_descriptors(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], "id", "v", 0.8, block).collect()
    assert {(r.k, r.a_id, r.b_id) for r in got} == want
    assert len(want) > 15


def pairs_of(rng, n, share, s, r, t):
    source = rng.uniform(-2, 2, (n, 3))
    target = s * source @ r.T + t + rng.normal(0, 0.003, (n, 3))
    wrong = rng.permutation(n)[: int(share * n)]
    target[wrong] = rng.uniform(-5, 5, (len(wrong), 3))
    return source, target, set(range(n)) - set(wrong.tolist())


def test_outliers_are_voted_down(spark):
    rng = np.random.default_rng(11)
    r, t = turn(rng), np.array([0.5, -1.0, 2.0])
    source, target, good = pairs_of(rng, 150, 0.4, 1.3, r, t)
    rows = [(1, i, source[i].tolist(), target[i].tolist()) for i in range(150)] + [(2, i, source[i].tolist(), target[i].tolist()) for i in range(2)]
    df = spark.createDataFrame(rows, "k int, id long, s array<double>, t array<double>")
    fits = [scenes.ransac_similarity(df.repartition(n, F.rand(n)), ["k"], "id", "s", "t", 0.05, 100).collect() for n in (1, 6)]
    (fit,) = fits[0]
    assert (fit.k, fit.matches, fit.inliers) == (1, 150, len(good))
    assert abs(fit.scale - 1.3) < 0.01 and np.allclose(fit.p, t, atol=0.01) and fit.rms < 0.01
    assert np.allclose([fit.scale, *fit.q, *fit.p], [fits[1][0].scale, *fits[1][0].q, *fits[1][0].p])


def test_scenes_align_or_say_why(spark):
    rng = np.random.default_rng(3)
    before, after = [], []
    for key, share in {1: 0.2, 2: 1.0}.items():
        r, t = turn(rng), rng.normal(size=3)
        source, target, _ = pairs_of(rng, 80, share, 0.7, r, t)
        vectors = rng.normal(size=(80, 8))
        after += [(key, i, source[i].tolist(), vectors[i].tolist()) for i in range(80)]
        before += [(key, 500 + i, target[i].tolist(), (vectors[i] + rng.normal(0, 0.02, 8)).tolist()) for i in range(80)]
    schema = "k int, id long, p array<double>, v array<double>"
    out = scenes.align_scenes(spark.createDataFrame(before, schema).withColumnRenamed("p", "place"), spark.createDataFrame(after, schema).withColumnRenamed("p", "place"), ["k"], "id", "place", "v", 0.8, 0.05, 20, 0.3, 0.02, 80)
    got = {r.k: r for r in out.collect()}
    assert got[1].accepted and got[1].matches == 80 and abs(got[1].scale - 0.7) < 0.01 and got[1].reason is None
    assert not got[2].accepted and got[2].reason == "inliers"
