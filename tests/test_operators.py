"""Edges of the library's operators, by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.functions import geometry, hashing, text, times
from weftline.operators import history, joins, metrics, rollups, sampling, splits, temporal
from weftline.plans import report_queries
from weftline.sources import tables
from weftline.streaming import events as streams


def spans(spark, *rows):
    return spark.createDataFrame([("k", i, s, e) for i, (s, e) in enumerate(rows)], "k string, id int, s long, e long")


def test_merge_looks_at_the_latest_end_so_far(spark):
    rows = temporal.merged(spans(spark, (0, 100), (10, 20), (90, 95), (105, 110), (120, 130)), ["k"], "s", "e", "id", 5).orderBy("s").collect()
    assert [(r.s, r.e, r.n) for r in rows] == [(0, 110, 4), (120, 130, 1)]


def test_holes_and_subtraction(spark):
    got = temporal.holes(spans(spark, (5, 10), (8, 12), (20, 99)), ["k"], "s", "e", "id", 0, 30).orderBy("hole_start").collect()
    assert [(r.hole_start, r.hole_end) for r in got] == [(0, 5), (12, 20)]
    parts = temporal.subtracted(spans(spark, (0, 10), (20, 30)), spans(spark, (2, 4), (3, 6)), ["k"], "id", "s", "e", "id").orderBy("part_start").collect()
    assert [(r.id, r.part_start, r.part_end) for r in parts] == [(0, 0, 2), (0, 6, 10), (1, 20, 30)]


def test_a_key_outside_the_window_is_one_hole(spark):
    rows = spark.createDataFrame([("in", 1, 5, 10), ("late", 2, 40, 50), ("early", 3, -9, 0), ("empty", 4, 7, 7)], "k string, id int, s long, e long")
    got = sorted((r.k, r.hole_start, r.hole_end) for r in temporal.holes(rows, ["k"], "s", "e", "id", 0, 30).collect())
    assert got == [("early", 0, 30), ("empty", 0, 30), ("in", 0, 5), ("in", 10, 30), ("late", 0, 30)]


def test_hysteresis_needs_to_exceed_on_and_holds_at_off(spark):
    values = [0, 3, 5, 9, 5, 3, 3, 2, 3, 9, 1]
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, t int, v int")
    got = temporal.hysteresis(rows, ["k"], "t", "t", "v", 8, 3).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(2, 6), (9, 9)]


def test_asof_ties_and_limits(spark):
    left = spark.createDataFrame([("k", 1, 10), ("k", 2, 15), ("z", 3, 1)], "k string, id int, t int")
    right = spark.createDataFrame([("k", 7, 10, "a"), ("k", 8, 20, "b"), ("k", 9, 10, "c")], "k string, id int, t int, v string")
    back = {r.id: r.v for r in joins.asof(left, right, ["k"], "t", "id", "id", ["v"]).collect()}
    near = {r.id: r.match_id for r in joins.asof(left, right, ["k"], "t", "id", "id", ["v"], "nearest").collect()}
    close = {r.id: r.v for r in joins.asof(left, right, ["k"], "t", "id", "id", ["v"], "forward", 4.0).collect()}
    assert back == {1: "c", 2: "c", 3: None} and near == {1: 9, 2: 9, 3: None} and close == {1: "a", 2: None, 3: None}


def test_interpolation_rules(spark):
    grid = spark.createDataFrame([("k", t) for t in (0, 10, 15, 20, 40)], "k string, t int")
    samples = spark.createDataFrame([("k", 10, 1.0), ("k", 20, 3.0)], "k string, t int, v double")
    spacing = {r.t: r.v for r in joins.interpolated(grid, samples, ["k"], "t", "t", "t", "v", 10.0).collect()}
    nearer = {r.t: r.v for r in joins.interpolated(grid, samples, ["k"], "t", "t", "t", "v", 10.0, "nearer").collect()}
    assert spacing == {0: None, 10: 1.0, 15: 2.0, 20: 3.0, 40: None} and nearer == {0: 1.0, 10: 1.0, 15: 2.0, 20: 3.0, 40: None}


def test_overlap_of_long_intervals_comes_once(spark):
    a = spans(spark, (0, 100)).select("k", F.col("id").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = spans(spark, (50, 200), (100, 110)).select("k", F.col("id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    assert [(r.a, r.b, r.overlap) for r in joins.overlaps(a, b, ["k"], ("s1", "e1"), ("s2", "e2"), 7).collect()] == [(0, 0, 50)]


def test_history_hides_seeded_descendants_and_retractions(spark):
    rows = spark.createDataFrame([(1, None, False, False), (2, 1, False, False), (3, None, True, False), (4, None, False, True), (5, 4, False, False), (6, None, False, False), (7, 6, True, False)], "id int, parent int, gone boolean, seeded boolean")
    assert [r.id for r in history.current(rows, "id", "parent", F.col("gone"), F.col("seeded")).orderBy("id").collect()] == [2]
    roots = {r.id: (r.root, r.depth) for r in history.chain_roots(rows, "id", "parent").collect()}
    assert roots[5] == (4, 1) and roots[1] == (1, 0)


def test_reconciliation_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (4, "n")], "id int, v string")
    assert {r.id: r.outcome for r in joins.compared(a, b, ["id"], ["v"]).collect()} == {1: "accepted", 2: "corrected", 3: "deleted", 4: "added"}


def test_metrics_without_data(spark):
    rows = spark.createDataFrame([("a", "x", "x", 0.0), ("a", "x", "x", 1.0)], "k string, t string, g string, c double")
    assert metrics.kappa(rows, ["k"], "t", "g").first().kappa is None
    bins = {r.bin: r.n for r in metrics.calibration_bins(rows, ["k"], "c", F.lit(True), 15).collect()}
    assert bins == {0: 1, 14: 1}
    assert metrics.average_precision(rows, ["k"], "c", "t", F.lit(False)).first().ap == -1.0


def test_binomial_upper_bound():
    assert sampling.binomial_upper(0, 59) == pytest.approx(1 - 0.05 ** (1 / 59), abs=1e-9)
    assert sampling.binomial_upper(5, 5) == 1.0


def test_plan_shares_load(spark):
    units = spark.range(20).select("id", (F.col("id") / 3).alias("p"))
    loads = [r["count"] for r in sampling.plan(units, "id", F.col("p"), ["a", "b", "c"]).groupBy("reviewer").count().collect()]
    assert max(loads) - min(loads) <= 1


def test_linked_groups(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c")], "w int, s string")
    assert {r.w: r.group for r in splits.linked_groups(rows, "w", "s").collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_linked_groups_of_all_lines_are_union_find(spark, tmp_path):
    # No line of suppliers 1 to 6 passes the modulo filter of linked_groups.
    lines = [(1, 1), (2, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 4), (31, 5), (62, 97), (63, 97), (63, 5)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for w, s in lines:
        a, b = find((0, w)), find((1, s))
        root[max(a, b)] = min(a, b)
    got = {r.w: r.group for r in report_queries.linked_groups_whole(spark, str(tmp_path)).collect()}
    assert got == {w: find((0, w))[1] for w, _ in lines}
    assert got[3] == 1 and got[5] == 4 and got[6] == 6


def test_weeks_clock_ids_and_text(spark):
    row = spark.createDataFrame([(datetime(2027, 1, 1), 3_723_456, "sessions/s1/x.mp4", "call 12345")], "t timestamp, ms long, key string, note string")
    got = row.select(times.iso_week(F.col("t")), times.clock_text(F.col("ms")), text.path_part(F.col("key"), "sessions"), text.guarded(F.col("note"), 99, "-")[0], F.length(hashing.fitted_id(F.lit("x" * 200), F.lit("s"))), text.filled("a{k}", {"k": F.lit(None).cast("string")})).first()
    assert list(got) == ["2026-W53", "1:02:03.4", "s1", "-", 128, None]


def test_box_iou_and_histograms(spark):
    one = [F.lit(float(v)) for v in (0, 0, 2, 2)]
    two = [F.lit(float(v)) for v in (1, 1, 2, 2)]
    got = spark.range(1).select(geometry.box_iou(tuple(one), tuple(two)), geometry.hellinger(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))).first()
    assert got[0] == pytest.approx(1 / 7) and got[1] == pytest.approx(1.0)


def test_retention_and_empty_weeks(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 3), 1.0), (datetime(2024, 1, 17), 2.0)], "t timestamp, v double")
    got = rollups.with_empty_weeks(rows, "t", "2024-01-01", "2024-01-20", n=F.count("*")).orderBy("week").collect()
    assert [r.n for r in got] == [1, None, 1]


def test_contract_checks_and_appends(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 2), ("b", None, 9), (None, 1, 2)], "id string, s int, e int")
    found = tables.faults(rows, {"id": F.col("id").isNotNull(), "span": F.col("e") >= F.col("s")}).collect()
    assert sorted((r.id or "", r.fault) for r in found) == [("", "id"), ("a", "span"), ("b", "span")]
    path = str(tmp_path / "t")
    assert tables.append_missing(rows, path, ["id"]) == 3
    assert tables.append_missing(rows.where("id = 'a'"), path, ["id"]) == 0


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, datetime(2024, 1, 1, i // 4, 15 * (i % 4)), "ab"[i % 2], float(i)) for i in range(24)], "id long, at timestamp, k string, value double")
    rows.union(rows.limit(3)).repartition(3).write.parquet(str(tmp_path / "in"))
    s = streams.read(spark, str(tmp_path / "in"), rows, files=10)
    got = streams.run_once(streams.tumbling(s, "at", "1 day", "2 hours", "k"), "tumbling", "complete", str(tmp_path / "c1"))
    assert got.agg(F.sum("n")).first()[0] == 27
    seen = streams.run_once(streams.first_seen(s, "at", "1 day", "id"), "seen", "append", str(tmp_path / "c2"))
    assert seen.count() == 24
    moves = streams.run_once(streams.lifecycle(s.withColumn("state", F.when(F.col("value") < 8, "raw").otherwise("done")), "k", "at", "state", ["raw", "done"]), "moves", "append", str(tmp_path / "c3"))
    assert sorted((r.key, r.before or "", r.after) for r in moves.collect()) == [("a", "", "raw"), ("a", "raw", "done"), ("b", "", "raw"), ("b", "raw", "done")]
