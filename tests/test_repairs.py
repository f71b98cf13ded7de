"""Cases that are easy to get wrong: cycles, repeated times, keyed digests, long identifiers, greedy splits."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F
from weftline.functions import hashing
from weftline.operators import graph, history, smoothing, splits


def test_chains_of_any_length_and_cycles(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    rows = spark.createDataFrame([*chain, (1000, 1001), (1001, 1000), (1002, 1001), (1003, 9999)], "id long, parent long")
    roots = {r.id: (r.root, r.depth) for r in history.chain_roots(rows, "id", "parent").collect()}
    assert all(roots[i] == (0, i) for i in range(300))
    assert roots[1000] == (1000, 0) and roots[1001] == (1001, 0) and roots[1002] == (1001, 1) and roots[1003] == (1003, 0)
    marked = spark.createDataFrame([(250,), (1000,), (9999,)], "id long")
    assert {r.id for r in history.closure(rows, marked, "id", "parent").collect()} == {*range(250, 300), 1000, 1001, 1002, 1003, 9999}


def test_parts_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400)], "a long, b long")
    got = {r.node: r.root for r in graph.parts(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}
    assert graph.parts(links.limit(0), "a", "b").count() == 0


def test_filter_starts_anew_when_time_stands_still(spark):
    rows = spark.createDataFrame([(0, 0.0, [0.0, 1.0]), (10, 1.0, [1.0, 1.0]), (10, 5.0, [5.0, 5.0]), (20, 5.0, [5.0, 5.0])], "ms long, v double, w array<double>").withColumn("k", F.lit("a"))
    got = [r.smooth for r in smoothing.one_euro(rows, ["k"], "ms", "v").orderBy("ms", "v").collect()]
    assert got[0] == 0 and 0 < got[1] < 1 and got[2:] == [5.0, 5.0]
    many = [r.smooth for r in smoothing.one_euro(rows, ["k"], "ms", "w").orderBy("ms", "v").collect()]
    assert many[1] == [pytest.approx(got[1]), 1.0] and many[3] == [5.0, 5.0]


@pytest.mark.parametrize("key", [b"short", b"k" * 64, b"long" * 40])
def test_hmac_is_the_standard_one(spark, key):
    row = spark.createDataFrame([("naïve",)], "v string").select(hashing.hmac(key, F.col("v")).alias("h"), hashing.pseudonym("worker", F.col("v"), key).alias("p")).first()
    assert row.h == hmac.new(key, "naïve".encode(), hashlib.sha256).hexdigest()
    assert row.p == "worker-" + hmac.new(key, "worker:naïve".encode(), hashlib.sha256).hexdigest()[:16]


def test_long_identifiers_keep_a_digest_of_their_base(spark):
    base = "b" * 150
    got = spark.range(1).select(hashing.fitted_id(F.lit(base), F.lit("s1")).alias("x"), hashing.fitted_id(F.lit("a"), F.lit("s1")).alias("y")).first()
    tail = ":h" + hashlib.sha256(base.encode()).hexdigest()[:16] + ":s1"
    assert got.x == "b" * (128 - len(tail)) + tail and got.y == "a:s1"
    with pytest.raises(Exception, match="too long"):
        spark.range(1).select(hashing.fitted_id(F.lit(base), F.lit("s" * 140)).alias("x")).collect()


def greedy(rows, share):
    """The rule, counted anew for every candidate."""
    workers, sites = set(), set()

    def sides(ws, ss):
        flags = [(w in ws, s in ss) for _, w, s in rows]
        return sum(a and b for a, b in flags), sum(a != b for a, b in flags)

    while sides(workers, sites)[0] < share * len(rows):
        options = []
        for w in {w for _, w, _ in rows} - workers:
            val, mixed = sides(workers | {w}, sites | {s for _, v, s in rows if v == w})
            if val > sides(workers, sites)[0]:
                options.append((mixed, -val, w))
        if not options:
            break
        chosen = min(options)[2]
        workers.add(chosen)
        sites |= {s for _, v, s in rows if v == chosen}
    return {i: "val" if w in workers and s in sites else "holdout" if w in workers or s in sites else "train" for i, w, s in rows}


def test_greedy_split_is_the_rule(spark):
    import random

    draw = random.Random(3)
    rows = [(i, f"w{draw.randrange(12)}", f"s{draw.randrange(9)}") for i in range(60)]
    pool = spark.createDataFrame(rows, "id int, w string, s string")
    for share in (0.1, 0.4):
        assert {r.id: r.split for r in splits.greedy_validation(pool, "w", "s", share).collect()} == greedy(rows, share)
    sides = {r.id: r.side for r in splits.held_apart(pool, "id", "w", "s", spark.createDataFrame([(0,)], "id int")).collect()}
    assert sides == {i: "golden" if i == 0 else "holdout" if w == rows[0][1] or s == rows[0][2] else "pool" for i, w, s in rows}
