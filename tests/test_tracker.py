"""Tracks in batches and streams, merged detections, and signed events."""

import hashlib
import hmac

from pyspark.sql import functions as F
from weftline.operators import tracker
from weftline.streaming import events as streams

START = 100_000
COLUMNS = "sequence long, frame long, id long, class string, x double, y double, w double, h double"


def scene(spark):
    rows = []
    for f in range(0, 1000, 100):
        rows.append((1, START + f, f, "face", f / 100, 0.0, 10.0, 10.0))
        if f not in (300, 400):
            rows.append((1, START + f, f + 1, "face", 100 - f / 100, 0.0, 10.0, 10.0))
        rows.append((1, START + f, f + 2, "plate", f / 100, 0.0, 10.0, 10.0))
    rows += [(1, START + 5000, 5000, "face", 9.0, 0.0, 10.0, 10.0), (2, START, 0, "face", 0.0, 0.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, COLUMNS)


def test_tracks_hold_over_gaps_and_end(spark, tmp_path):
    boxes = scene(spark)
    got = {(r.sequence, r.id): r.track for r in tracker.tracks(boxes, 0.4, 500).collect()}
    for kind in range(3):
        assert len({got[1, f + kind] for f in range(0, 1000, 100) if (1, f + kind) in got}) == 1
    assert len({got[1, 0], got[1, 1], got[1, 2], got[1, 5000]}) == 4 and got[2, 0] == 0
    boxes.repartition(1).sortWithinPartitions("frame").write.parquet(f"{tmp_path}/in")
    stream = streams.read(spark, f"{tmp_path}/in", boxes)
    live = streams.run_once(streams.tracked(stream, 0.4, 500), "live_tracks", "append", f"{tmp_path}/c")
    assert {(r.sequence, r.id): r.track for r in live.collect()} == got


def test_merged_detections_and_boxes_to_blur(spark):
    rows = spark.createDataFrame([(1, 0, 0, "face", 0.0, 0.0, 10.0, 10.0, 0.9), (1, 0, 1, "face", 2.0, 0.0, 10.0, 10.0, 0.8), (1, 0, 2, "face", 50.0, 0.0, 10.0, 10.0, 0.5), (1, 0, 3, "plate", 0.0, 0.0, 10.0, 10.0, 0.4)], COLUMNS + ", score double")
    got = sorted((r["class"], r.x, r.w, r.score, r.n) for r in tracker.fused(rows, 0.5).collect())
    assert got == [("face", 0.0, 12.0, 0.9, 2), ("face", 50.0, 10.0, 0.5, 1), ("plate", 0.0, 10.0, 0.4, 1)]
    seen = spark.createDataFrame([(1, 7, 100, 0.0, 0.0, 10.0, 10.0), (1, 7, 300, 20.0, 0.0, 10.0, 10.0)], "sequence long, track long, frame long, x double, y double, w double, h double")
    frames = spark.createDataFrame([(1, f) for f in range(0, 500, 50)], "sequence long, frame long")
    boxes = {r.frame: (r.x, r.w) for r in tracker.rendered(seen, frames, 60, 0.0).collect()}
    assert boxes == {50: (0.0, 10.0), 100: (0.0, 10.0), 150: (0.0, 30.0), 200: (0.0, 30.0), 250: (0.0, 30.0), 300: (20.0, 10.0), 350: (20.0, 10.0)}


def test_only_signed_events_pass(spark):
    good = hmac.new(b"key", b"body", hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([("body", good), ("body", "sha256=" + good.upper()), ("body!", good), ("body", None)], "body string, sig string")
    assert streams.signed(rows, "body", "sig", b"key").count() == 2
    tasks = spark.createDataFrame([("t1", "r1")], "task string, reviewer_id string")
    assert {r.task: r.reviewer_id for r in streams.with_assignment(spark.createDataFrame([("t1",), ("t2",)], "task string"), tasks, "task").collect()} == {"t1": "r1", "t2": None}


def test_states_are_forgotten(spark, tmp_path):
    columns = "k int, at string, state string"
    for n, rows in enumerate([[(1, "2024-01-01 00:00:00", "raw"), (2, "2024-01-01 00:00:00", "done")], [(2, "2024-01-03 00:00:00", "raw")], [(1, "2024-01-04 00:00:00", "raw"), (2, "2024-01-04 00:00:00", "raw")]]):
        spark.createDataFrame(rows, columns).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        like = spark.read.parquet(f"{tmp_path}/in")
        moves = streams.lifecycle(streams.read(spark, f"{tmp_path}/in", like), "k", "at", "state", ["raw", "done"], forget="36 hours")
        streams.each_batch(moves, lambda df, _, n=n: df.write.mode("append").parquet(f"{tmp_path}/out{n}"), f"{tmp_path}/c")
        got = sorted((r.key, r.before, r.after) for r in spark.read.schema(moves.schema).parquet(f"{tmp_path}/out{n}").collect())
        # Key 1 wasn't heard of for more than 36 hours and starts anew; key 2 never goes back from done.
        assert got == [[(1, None, "raw"), (2, None, "done")], [], [(1, None, "raw")]][n]


def test_the_surest_detection_chooses_first():
    """Crowds of boxes, against a plain loop: detections choose in order of score, equal areas go to the track opened last."""
    import random

    rng = random.Random(4)
    state, tracks = None, []
    for at in range(0, 3000, 100):
        found = [(i, rng.choice("ab"), (float(rng.randint(0, 6)), 0.0, 6.0, 6.0), rng.choice([0.2, 0.5, 0.9])) for i in range(rng.randint(0, 7))]
        state, given = tracker.advance(state, at, found, 0.3, 250)
        still = [t for t in tracks if at - t["at"] <= 250]
        used, want = set(), {}
        for i, kind, box, _ in sorted(found, key=lambda f: -f[3]):
            best, most = None, 0.3
            for k, t in enumerate(still):
                if k not in used and t["kind"] == kind and tracker.shared(t["box"], box) >= most:
                    best, most = k, tracker.shared(t["box"], box)
            if best is None:
                tracks.append({"kind": kind, "box": box, "at": at, "n": len(tracks)})
                want[i] = tracks[-1]["n"]
            else:
                used.add(best)
                still[best] |= {"box": box, "at": at}
                want[i] = still[best]["n"]
        assert dict(given) == want
    assert state["next"] == len(tracks) > 5
