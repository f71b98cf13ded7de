"""Operational tables: appended once by key, scanned in order, checked before anything is written."""

import datetime

import pytest
from pyspark.sql import functions as F
from weftline.sources import records


def test_append_fetch_and_list(spark, tmp_path):
    folder, day = str(tmp_path), datetime.datetime(2024, 1, 1)
    assert records.listed(spark, folder, "review_work") is None and records.fetched(spark, folder, "review_work", "w1") is None
    rows = spark.createDataFrame([(f"w{i}", f"s{i % 2}", day + datetime.timedelta(days=i), float(i)) for i in range(5)], "work_id string, session_id string, recorded_at timestamp, seconds double")
    assert records.appended(rows.where("work_id <> 'w4'"), folder, "review_work") == 4
    assert records.appended(rows, folder, "review_work") == 1 and records.appended(rows, folder, "review_work") == 0
    assert records.fetched(spark, folder, "review_work", "w3").first().seconds == 3
    got = records.listed(spark, folder, "review_work", since=day + datetime.timedelta(days=1), until=day + datetime.timedelta(days=4), session_id="s1")
    assert [r.work_id for r in got.collect()] == ["w1", "w3"]
    for bad in (rows.withColumn("work_id", F.lit(None).cast("string")), rows.drop("work_id")):
        with pytest.raises(ValueError):
            records.appended(bad, folder, "review_work")
    with pytest.raises(ValueError, match="positive"):
        records.appended(rows.withColumn("work_id", F.concat("work_id", F.lit("x"))), folder, "review_work", {"positive": F.col("seconds") > 0})
    assert records.scan(spark, folder, "review_work").count() == 5


def test_state_folds(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string")
    assert sorted((r.k, r.v) for r in records.latest(log, ["k"], "at").collect()) == [(1, "b"), (2, "c")]
    changes = spark.createDataFrame([(1, 1, "x", None), (1, 2, None, "y")], "k int, at int, v string, w string")
    base = spark.createDataFrame([(1, "v", "w"), (2, "v", "w")], "k int, v string, w string")
    assert sorted(map(tuple, records.revised(base, changes, ["k"], ["at"], ["v", "w"]).collect())) == [(1, "x", "y"), (2, "v", "w")]
    tasks = spark.createDataFrame([(1, 1, None), (2, 1, 2), (3, None, None)], "k int, asked int, done int")
    assert [r.k for r in records.unfinished(tasks, "asked", "done").collect()] == [1]
