"""Reports by subgroups against plain loops, and versions without leaks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import evaluation

GROUPS = {1: ["overall", "site=a"], 2: ["overall", "site=a"], 3: ["overall", "site=b"], 4: ["overall", "site=unknown"]}


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "session int, site string")


def edge_hits(a, b, tolerance):
    a, b, hits = sorted(a), sorted(b), 0
    while a and b:
        if abs(a[0] - b[0]) <= tolerance:
            a, b, hits = a[1:], b[1:], hits + 1
        elif a[0] < b[0]:
            a = a[1:]
        else:
            b = b[1:]
    return hits


def test_intervals_by_group(spark, sessions):
    rng = np.random.default_rng(4)
    rows = {side: {s: [(int(x), int(x + rng.integers(20, 60)), i) for i, x in enumerate(np.sort(rng.choice(1000, 12, replace=False)))] for s in (1, 2, 3)} for side in "tp"}
    df = {side: spark.createDataFrame([(s, *r) for s, rs in v.items() for r in rs], "session int, start long, end long, id long") for side, v in rows.items()}
    got = {(r.group, r.metric): r.value for r in evaluation.evaluate(sessions, ["site"], {"x": evaluation.intervals(df["t"], df["p"], [], 0.4, 5, 50)}).collect()}
    want = {}
    for group in ("overall", "site=a", "site=b"):
        tp = fp = fn = hits = edges = shared = covered = 0
        for s in (1, 2, 3):
            if group not in GROUPS[s]:
                continue
            t, p = rows["t"][s], rows["p"][s]
            iou = lambda a, b: max(0, min(a[1], b[1]) - max(a[0], b[0])) / (max(a[1], b[1]) - min(a[0], b[0]))
            best = [max(t, key=lambda x: (iou(x, y), -x[0], -x[1], -x[2])) for y in p]
            found = {x for x, y in zip(best, p, strict=True) if iou(x, y) >= 0.4}
            tp, fp, fn = tp + len(found), fp + len(p) - len(found), fn + len(t) - len(found)
            a, b = ({e for x in side for e in x[:2]} for side in (t, p))
            hits, edges = hits + edge_hits(a, b, 5), edges + len(a) + len(b)
            a, b = ({m for x in side for m in range(*x[:2])} for side in (t, p))
            shared, covered = shared + len(a & b), covered + len(a | b)
        want |= {(group, "segment_f1"): 2 * tp / (2 * tp + fp + fn), (group, "segments"): tp + fn, (group, "boundary_f1"): 2 * hits / edges, (group, "time_iou"): shared / covered}
    assert got == pytest.approx(want)


def test_classes_ranks_and_gates(spark, sessions):
    rng = np.random.default_rng(5)
    pairs = [(int(rng.integers(1, 5)), str(rng.choice(list("abc"))), str(rng.choice(list("aab"))), float(rng.random())) for _ in range(200)]
    df = spark.createDataFrame(pairs, "session int, truth string, guess string, sure double").withColumn("id", F.monotonically_increasing_id())
    tasks = {"c": evaluation.classification(df, confidence="sure", bins=5), "r": evaluation.ranking(df, "sure", "id", F.col("truth") == "a")}
    report = evaluation.evaluate(sessions, ["site"], tasks)
    got = {(r.task, r.group, r.metric): r.value for r in report.collect()}
    for group in ("overall", "site=a", "site=b", "site=unknown"):
        rows = [p for p in pairs if group in GROUPS[p[0]]]
        n, right = len(rows), sum(t == g for _, t, g, _ in rows)
        count = lambda i, k: sum(r[i] == k for r in rows)  # noqa: E731, B023
        f1 = {k: 2 * sum(t == g == k for _, t, g, _ in rows) / (count(1, k) + count(2, k)) for k in "abc"}
        chance = sum(count(1, k) * count(2, k) for k in "abc") / n**2
        want = {"accuracy": right / n, "macro_f1": sum(f1.values()) / 3, "kappa": (right / n - chance) / (1 - chance), "rows": n} | {f"f1/{k}": v for k, v in f1.items()}
        bins = [[r for r in rows if min(int(r[3] * 5), 4) == b] for b in range(5)]
        want["calibration_error"] = sum(abs(sum(r[3] for r in b) - sum(r[1] == r[2] for r in b)) for b in bins) / n
        assert {m: got["c", group, m] for m in want} == pytest.approx(want)
        assert 0 < got["r", group, "average_precision"] <= 1
    rules = spark.createDataFrame([("c", "accuracy", 0.0), ("c", "kappa", 2.0), ("c", "nothing", 0.1)], "task string, metric string, least double")
    held = {(r.group, r.metric): r.passed for r in evaluation.gated(report, report.where("metric <> 'kappa'").withColumn("value", F.col("value") + F.when(F.col("group") == "site=b", 0.5).otherwise(0.0)), rules, 0.1).collect()}
    assert held["overall", "accuracy"] and not held["site=b", "accuracy"] and not held["overall", "kappa"] and not held["overall", "nothing"]


def test_versions_have_no_leaks(spark):
    sessions = spark.createDataFrame([(s, s % 40, s % 40 // 3) for s in range(300)], "session int, worker int, site int")
    labels = spark.createDataFrame([(s * 10 + i, s, "box" if i else "gap", "ok" if (s + i) % 4 else "bad") for s in range(300) for i in range(3)], "label_id int, session int, kind string, state string")
    make = lambda df: evaluation.dataset_version(df, sessions, F.col("state") == "ok", "v2", 3, {"train": 0.6, "val": 0.2, "test": 0.2})
    out = make(labels)
    items = out["items"].collect()
    assert len(items) == labels.where("state = 'ok'").count() and {r.split for r in items} == {"train", "val", "test"}
    assert out["leaks"].collect() == []
    sides = {}
    for r in items:
        assert sides.setdefault(r.session % 40 // 3, r.split) == r.split
    assert sum(r.n for r in out["counts"].collect()) == len(items)
    one, two = out["manifest"].first(), make(labels.repartition(5))["manifest"].first()
    assert one == two and (one.labels, one.version, one.seed) == (len(items), "v2", 3) and len(one.digest) == len(hashlib.sha256().hexdigest())
    assert make(labels.where("label_id <> 21"))["manifest"].first().digest != one.digest
