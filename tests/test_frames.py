"""What is next, in force, sure enough or evenly spread, on rows with ties, gaps and nulls."""

from pyspark.sql import functions as F

from weftline.operators import frames


def test_next_and_in_force(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 3, 6.0), ("a", 2, 7.0), ("b", 1, None)], "k string, t int, v double")
    assert sorted((r.k, r.t, r.action) for r in frames.next_values(rows, ["k"], ["t"], "v").collect()) == [("a", 1, 7.0), ("a", 2, 6.0), ("a", 3, 6.0), ("b", 1, None)]
    made = spark.createDataFrame([("a", 1, True, 5), ("a", 2, False, 9), ("a", 3, True, 5), ("b", 4, None, 1)], "k string, id int, begun boolean, made int")
    assert sorted(map(tuple, frames.in_force(made, ["k"], "id", F.col("begun"), "made").collect())) == [("a", 3), ("b", 4)]


def test_spikes_and_knees(spark):
    rows = spark.createDataFrame([("a", i, i, v) for i, v in enumerate([0.0, 0.1, 9.0, 0.2, 0.3, 5.0, 5.1])], "k string, t int, id int, v double")
    assert [r.id for r in frames.spikes(rows, ["k"], "t", "id", "v", 2.0).collect()] == [2]
    points = spark.createDataFrame([("a", 1, 10, 0.1), ("a", 2, 30, 0.9), ("a", 3, 20, 0.2), ("a", 4, 20, 0.2), ("b", 1, 5, 0.9), ("b", 2, 7, None)], "k string, load int, n int, p95 double")
    assert sorted(map(tuple, frames.knee(points, ["k"], "load", "n", "p95", 0.5).collect())) == [("a", 3, 20, False), ("b", 2, 7, True)]
    assert sorted(map(tuple, frames.knee(points, ["k"], "load", "n").drop("over").collect())) == [("a", 2, 30), ("b", 2, 7)]


def test_vocabularies_picks_and_tracks(spark):
    words = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0), ("c", 2)], "w string, at int")
    assert sorted(map(tuple, frames.vocabulary(words, "w", "at").collect())) == [("a", 1), ("b", 0), ("c", 2)]
    rows = spark.createDataFrame([("a", t) for t in range(10)] + [("b", t) for t in range(2)], "k string, t int")
    picked = frames.evenly(rows, ["k"], ["t"], 4).collect()
    assert sorted(r.t for r in picked if r.k == "a") == [t for t in range(10) if t == 0 or t * 4 // 10 > (t - 1) * 4 // 10] and sum(r.k == "b" for r in picked) == 2
    tracks = spark.createDataFrame([("a", t, 0.9 if t == 3 else 0.1) for t in range(10)] + [("b", t, 0.1) for t in range(10)] + [("c", 9, 0.9)], "k string, t int, sure double")
    assert [tuple(r) for r in frames.confident(tracks, ["k"], "t", F.col("sure") > 0.5, 2, 5).collect()] == [("a", 7, 6)]
    pairs = spark.createDataFrame([("a", 1.0, 0.5), ("a", 1.0, None), ("b", None, 1.0)], "k string, t double, g double")
    assert [tuple(r) for r in frames.absolute_error(pairs, ["k"], "t", "g").collect()] == [("a", 2, 0.75)]
