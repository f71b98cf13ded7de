"""Numbers over a whole table, and tables that end a plan."""

import random

from pyspark.sql import functions as F

from weftline.operators.numbering import numbered
from weftline.operators.settled import settled


def test_numbers_follow_the_order(spark):
    rows = [(random.Random(i).randint(0, 400), f"n{i}") for i in range(1000)] + [(None, "none"), (None, "nothing")]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(df, ["a", "b"], "n", 5, falling=[0]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(5, 5 + len(rows)))
    assert numbered(df.limit(0), ["a"], "n").collect() == []


def test_ended_plans_are_tables(spark):
    df = settled(spark.range(5).select("id", F.lit("x").alias("my col"), F.array(F.lit(1.5)).alias("v")))
    assert sorted(map(tuple, df.collect())) == [(i, "x", [1.5]) for i in range(5)]
    assert "Range" not in df._jdf.queryExecution().toString()
