"""Tracking, detection and segment scores against brute force over all matchings."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from weftline.operators import segments, tracking


def iou(a, b):
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def best(ts, ps, gain):
    """The set of pairs of most gain."""
    small, large, flip = (ts, ps, False) if len(ts) <= len(ps) else (ps, ts, True)
    options = ([(s, x) for s, x in zip(small, p, strict=True)] for p in itertools.permutations(large, len(small)))
    pairs = max(options, key=lambda o: sum(gain(x, s) if flip else gain(s, x) for s, x in o), default=[])
    return [(x, s) if flip else (s, x) for s, x in pairs]


@pytest.fixture(scope="module")
def scene(spark):
    draw = random.Random(11)
    truth, found = [], []
    for frame in range(14):
        for i in range(3):
            x, y = 5 * i + draw.random(), draw.random()
            if draw.random() < 0.85:
                truth.append((1, frame, i, x, y, 4.0, 4.0))
            if draw.random() < 0.85:
                found.append((1, frame, 10 + ((i + 1) % 3 if frame in (5, 6, 9) else i), x + draw.uniform(-2.5, 2.5), y, 4.0, 4.0))
    columns = "sequence long, frame long, id long, x double, y double, w double, h double"
    more = lambda rows, seq: [(seq, *r[1:]) for r in rows]
    return truth, found, spark.createDataFrame(truth + more(truth[:5], 2), columns), spark.createDataFrame(found + more(found[:4], 3), columns)


def by_frame(rows):
    out = defaultdict(dict)
    for _, f, i, *box in rows:
        out[f][i] = box
    return out


def test_hota_is_brute_force(scene):
    truth, found, t, p = scene
    gs, ps = by_frame(truth), by_frame(found)
    frames = sorted(gs.keys() | ps.keys())
    sim = {f: {(a, b): iou(x, y) for a, x in gs[f].items() for b, y in ps[f].items()} for f in frames}
    met, ng, np_ = defaultdict(float), defaultdict(int), defaultdict(int)
    for f in frames:
        for a in gs[f]:
            ng[a] += 1
        for b in ps[f]:
            np_[b] += 1
        for (a, b), s in sim[f].items():
            whole = sum(v for (x, y), v in sim[f].items() if x == a or y == b)
            if s:
                met[a, b] += s / whole
    glob = {k: v / (ng[k[0]] + np_[k[1]] - v) for k, v in met.items()}
    pairs = {f: best(list(gs[f]), list(ps[f]), lambda a, b, f=f: glob.get((a, b), 0) * sim[f][a, b]) for f in frames}
    values = []
    for alpha in tracking.ALPHAS:
        m, tp = defaultdict(int), 0
        for f in frames:
            for a, b in pairs[f]:
                if sim[f][a, b] >= alpha - 1e-12:
                    m[a, b] += 1
                    tp += 1
        ass = sum(n * n / (ng[a] + np_[b] - n) for (a, b), n in m.items()) / max(1, tp)
        values.append(math.sqrt(tp / (len(truth) + len(found) - tp) * ass))
    got = {r.sequence: r for r in tracking.hota(t, p).collect()}
    assert got[1].hota == pytest.approx(sum(values) / 19)
    assert (got[2].hota, got[2].loc_a, got[3].hota, got[3].loc_a) == (0, 1, 0, 1)


def test_identity_and_clear_are_brute_force(scene):
    truth, found, t, p = scene
    gs, ps = by_frame(truth), by_frame(found)
    agree = defaultdict(int)
    for f in gs:
        for a, x in gs[f].items():
            for b, y in ps[f].items():
                agree[a, b] += iou(x, y) >= 0.5
    idtp = sum(agree[k] for k in best([0, 1, 2], [10, 11, 12], lambda a, b: agree[a, b]))
    got = {r.sequence: r for r in tracking.identity(t, p).collect()}
    assert got[1].idtp == idtp and got[1].idf1 == pytest.approx(2 * idtp / (len(truth) + len(found))) and got[2].idf1 == got[3].idf1 == 0
    hits, switches, total, last, before = 0, 0, 0.0, {}, {}
    for f in sorted(gs.keys() & ps.keys()):
        score = {(a, b): (s + 1000 * (before.get(a) == b)) if (s := iou(x, y)) >= 0.5 else 0 for a, x in gs[f].items() for b, y in ps[f].items()}
        pairs = [(a, b) for a, b in best(list(gs[f]), list(ps[f]), lambda a, b: score[a, b]) if score[a, b] > 0]
        before = dict(pairs)
        for a, b in pairs:
            switches += last.get(a, b) != b
            last[a] = b
            hits += 1
            total += iou(gs[f][a], ps[f][b])
    row = {r.sequence: r for r in tracking.clear(t, p).collect()}
    assert (row[1].tp, row[1].fp, row[1].fn, row[1].idsw) == (hits, len(found) - hits, len(truth) - hits, switches) and switches
    assert row[1].mota == pytest.approx((hits - (len(found) - hits) - switches) / len(truth)) and row[1].motp == pytest.approx(total / hits)
    assert row[2].mota == 0 and row[3].mota == -4


def area(hits, n, points=None):
    """Area under the best precision at or beyond each recall."""
    steps, right = [], 0
    for i, h in enumerate(hits, 1):
        right += h
        steps.append((right / n, right / i))
    if points:
        return sum(max((q for r, q in steps if r >= k / (points - 1) - 1e-12), default=0.0) for k in range(points)) / points
    return sum(max(q for _, q in steps[i:]) for i, h in enumerate(hits) if h) / n


def test_detection_precision_is_brute_force(spark):
    draw = random.Random(2)
    box = lambda: (draw.uniform(0, 12), draw.uniform(0, 3), 4.0, 4.0)
    truth = [(1, f, i, *box(), "c") for f in range(6) for i in range(2)]
    found = [(1, f, 5 + i, *box(), "c", round(draw.random(), 3)) for f in range(6) for i in range(4)] + [(1, 0, 99, 0.0, 0.0, 1.0, 1.0, "d", 0.5)]
    columns = "sequence long, frame long, id long, x double, y double, w double, h double, class string"
    got = {(r["class"], r.threshold): r.ap for r in tracking.detection_precision(spark.createDataFrame(truth, columns), spark.createDataFrame(found, columns + ", score double"), most=3).collect()}
    for threshold in (0.5, 0.55, 0.75):
        kept = [d for f in range(6) for d in sorted((x for x in found if x[1] == f and x[7] == "c"), key=lambda x: -x[8])[:3]]
        used, hits = set(), []
        for d in sorted(kept, key=lambda x: (-x[8], x[1], x[2])):
            options = [(iou(g[3:7], d[3:7]), g[2], g) for g in truth if g[1] == d[1] and g not in used and iou(g[3:7], d[3:7]) >= threshold]
            hits.append(bool(options))
            if options:
                used.add(max(options)[2])
        assert got["c", threshold] == pytest.approx(area(hits, len(truth), 101)), threshold
    assert got["d", 0.5] == -1


def test_temporal_precision_is_brute_force(spark):
    draw = random.Random(5)
    truth = [(g, i, s := draw.randrange(90), s + draw.randrange(5, 30), c) for g in "xy" for i, c in enumerate("aabbab")]
    found = [(g, 100 + i, s := draw.randrange(90), s + draw.randrange(5, 30), c, round(draw.random(), 2)) for g in "xy" for i, c in enumerate("abababab")]
    columns = "g string, id long, start long, end long, class string"
    rows = segments.temporal_precision(spark.createDataFrame(truth, columns), spark.createDataFrame([(g, i + 1000 * (g == "y"), *r) for g, i, *r in found], columns + ", score double"), "g", "class", [0.1, 0.3], 20)
    got = {(r["class"], r.threshold): r.ap for r in rows.collect()}
    for c in "ab":
        for threshold in (0.1, 0.3):
            used, hits = set(), []
            for g, _, s, e, k, _ in sorted(found, key=lambda x: (-x[5], x[1] + 1000 * (x[0] == "y"))):
                if k == c:
                    options = [(v, t[1], t) for t in truth if t[0] == g and t[4] == c and t not in used and (v := max(0, min(e, t[3]) - max(s, t[2])) / (max(e, t[3]) - min(s, t[2]))) >= threshold]
                    hits.append(bool(options))
                    if options:
                        used.add(max(options)[2])
            assert got[c, threshold] == pytest.approx(area(hits, sum(t[4] == c for t in truth)))


def test_agreement_of_equals_is_whole_and_bias_has_a_sign(spark):
    rows = spark.createDataFrame([(1, i, 10 * i, 10 * i + 8, "ab"[i % 2]) for i in range(6)], "k long, id long, start long, end long, class string")
    got = segments.agreement(rows, rows, ["k"], 1, 0.5, 10).first()
    assert (got.pairs, got.kappa, got.segment_f1, got.boundary_f1) == (6, 1.0, 1.0, 1.0)
    from pyspark.sql import functions as F

    apart = rows.withColumn("start", F.col("start") + 6)
    assert segments.prelabel_bias(rows, rows, apart, ["k"], 0.5, 10).first().bias == 1.0
    states = spark.createDataFrame([(1, t, t, s) for t, s in [(0, "a"), (10, "b"), (20, "a")]], "k long, id long, at long, s string")
    late = states.withColumn("at", F.when(F.col("id") == 20, 40).otherwise(F.col("at")).cast("long"))
    row = segments.transition_accuracy(states, late, ["k"], "at", "id", "s", 5).first()
    assert (row.hits, row.accuracy, row.precision) == (1, 0.5, 0.5)
