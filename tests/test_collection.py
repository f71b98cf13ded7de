"""Reviews from streams: late, doubled and replayed events."""

import shutil

import pytest
from pyspark.sql import functions as F

from weftline.streaming import collection
from weftline.streaming import events as streams

SENT = "task string, assignee string, sent_at string"
RESULT = "task string, event_id string, reviewer string, at string"


def day(text):
    return f"2024-01-{text}:00"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def arrive(spark, folder, rows, schema, at):
    spark.createDataFrame(rows, schema).withColumn(at, F.to_timestamp(at)).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def test_results_meet_their_tasks(spark, tmp_path):
    sent, results = f"{tmp_path}/sent", f"{tmp_path}/results"
    batches = [
        ([("t1", "ann", day("01 10:00")), ("t2", None, day("01 10:00")), ("t3", "bob", day("01 10:00"))], [("t1", "e1", "ann", day("01 12:00")), ("t9", "e9", "ann", day("01 12:00"))]),
        ([("t4", "cas", day("03 10:00"))], [("t2", "e2", "eve", day("01 13:00")), ("t1", "e3", "eve", day("01 14:00")), ("t4", "e4", "cas", day("03 11:00"))]),
        ([("t5", "cas", day("09 10:00"))], [("t3", "e5", "bob", day("09 10:00")), ("t5", "e6", "cas", day("09 11:00"))]),
        ([("t6", "cas", day("12 10:00"))], [("t6", "e7", "cas", day("12 11:00"))]),
    ]
    met, lost = [], []
    for n, (tasks, answers) in enumerate(batches):
        a, b = arrive(spark, sent, tasks, SENT, "sent_at"), arrive(spark, results, answers, RESULT, "at")
        for make, out, name in ((collection.met_results, met, "met"), (collection.unanswered, lost, "lost")):
            joined = make(streams.read(spark, sent, a, 9), streams.read(spark, results, b, 9), "1 day", "2 days")
            streams.each_batch(joined, lambda df, _, out=out: out.extend(df.collect()), f"{tmp_path}/c-{name}")
    assert sorted((r.task, r.event_id, r.theirs) for r in met) == [("t1", "e1", True), ("t1", "e3", False), ("t2", "e2", True), ("t4", "e4", True), ("t5", "e6", True), ("t6", "e7", True)]
    assert [r.task for r in lost] == ["t3"]


def test_a_task_is_decided_once(rocks, tmp_path):
    spark, folder, got = rocks, f"{tmp_path}/events", []
    schema = "task string, event_id string, kind string, reviewer string, theirs boolean, at string"
    batches = [
        [("t1", "e2", "result", "ann", True, day("01 12:00")), ("t1", "e1", "result", "eve", False, day("01 11:00")), ("t2", "r1", "revoke", None, None, day("01 10:00"))],
        [("t1", "e2", "result", "ann", True, day("01 12:00")), ("t1", "r2", "revoke", None, None, day("01 13:00")), ("t2", "e3", "result", "bob", True, day("01 09:00")), ("t3", "e4", "result", "bob", True, day("01 09:00"))],
    ]
    for rows in batches:
        like = arrive(spark, folder, rows, schema, "at")
        streams.each_batch(collection.decisions(streams.read(spark, folder, like, 9)), lambda df, _: got.extend(df.collect()), f"{tmp_path}/c")
    assert sorted((r.task, r.event_id, r.outcome) for r in got) == [("t1", "e1", "refused"), ("t1", "e2", "again"), ("t1", "e2", "collected"), ("t1", "r2", "late"), ("t2", "e3", "late"), ("t2", "r1", "revoked"), ("t3", "e4", "collected")]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder, target = f"{tmp_path}/in", f"{tmp_path}/out"
    read = lambda: sorted((r.k, r.v, r.batch) for r in spark.read.parquet(target).collect())
    for rows in ([("a", 1), ("b", 2), ("b", 1)], [("b", 9), ("c", 3)], [("a", 8), ("d", 4)]):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(folder)
        stream = streams.read(spark, folder, spark.read.parquet(folder))
        streams.each_batch(stream, collection.once(target, ["k"]), f"{tmp_path}/c")
    want = [("a", 1, 0), ("b", 1, 0), ("c", 3, 1), ("d", 4, 2)]
    assert read() == want
    # The last commit is lost, as when the driver dies after writing: the batch comes again.
    for log in (tmp_path / "c" / "commits").glob("*2*"):
        log.unlink()
    stream = streams.read(spark, folder, spark.read.parquet(folder))
    streams.each_batch(stream, collection.once(target, ["k"]), f"{tmp_path}/c")
    assert read() == want
    # So does a batch in the middle, and one that had written half of its rows.
    write = collection.once(target, ["k"])
    shutil.rmtree(f"{target}/batch=1")
    write(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), 1)
    write(spark.createDataFrame([("b", 2), ("a", 1), ("b", 1)], "k string, v int"), 0)
    assert read() == want
