"""Matching, smoothing and bounds against brute force."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.functions import bounds
from weftline.operators import matching, smoothing


def test_least_cost_is_brute_force():
    rng = np.random.default_rng(0)
    for rows, columns in [(1, 1), (2, 3), (4, 4), (5, 3), (3, 6)] * 20:
        cost = rng.integers(0, 9, (rows, columns)).astype(float)
        pairs = matching.least_cost(cost)
        wide = cost if rows <= columns else cost.T
        best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert len(pairs) == min(rows, columns) == len({r for r, _ in pairs}) == len({c for _, c in pairs})
        assert sum(cost[r, c] for r, c in pairs) == best


def test_events_match_as_many_as_can_be(spark):
    rng = np.random.default_rng(4)
    sides = [[(int(k), int(t)) for k, t in zip(rng.integers(0, 6, 40), rng.integers(0, 300, 40), strict=True)] for _ in range(2)]
    truth, found = (spark.createDataFrame(s, "k long, at long") for s in sides)
    got = {r.k: (r.hits, r.misses, r.false_alarms) for r in matching.event_matches(truth, found, ["k"], "at", 7).collect()}
    by = [defaultdict(list), defaultdict(list)]
    for side, rows in zip(by, sides, strict=True):
        for k, t in rows:
            side[k].append(t)

    def most(a, b):
        free, hits = sorted(b), 0
        for t in sorted(a):
            near = [x for x in free if abs(x - t) <= 7]
            if near:
                free.remove(near[0])
                hits += 1
        return hits

    for k in by[0].keys() | by[1].keys():
        a, b = by[0][k], by[1][k]
        assert got[k] == (most(a, b), len(a) - most(a, b), len(b) - most(a, b))


def test_filter_holds_a_constant_and_follows_a_step(spark):
    rows = spark.createDataFrame([("a", 10 * i, 5.0) for i in range(20)] + [("b", 10 * i, 0.0 if i < 10 else 1.0) for i in range(60)], "k string, ms long, v double")
    got = smoothing.one_euro(rows, ["k"], "ms", "v").orderBy("k", "ms").collect()
    assert all(r.smooth == 5.0 for r in got if r.k == "a")
    step = [r.smooth for r in got if r.k == "b"]
    assert step == sorted(step) and step[9] == 0 and 0 < step[10] < 0.5 and step[-1] > 0.9


def test_exact_bounds(spark):
    rows = spark.createDataFrame([(0, 10), (10, 10), (3, 20), (0, 0), (None, 5)], "k long, n long")
    got = [r.u for r in rows.select(bounds.exact_upper(F.col("k"), F.col("n")).alias("u")).collect()]
    assert got[0] == pytest.approx(1 - 0.05**0.1) and got[1] == 1 and got[3] is None and got[4] is None
    assert sum(math.comb(20, i) * got[2] ** i * (1 - got[2]) ** (20 - i) for i in range(4)) == pytest.approx(0.05)
