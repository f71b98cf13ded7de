"""Results on borders, and what must not grow with the table in one task."""

import heapq
import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import contacts, history, numbering, picks, scenes, spectra, splits


def test_cells_exactly_the_radius_away_are_swept(spark):
    # A level path at 0.2: the middles at 0.35 are 0.15 away.
    path = spark.createDataFrame([(1, 1, 1, 1, 0.1, 0.2, 2.0, 1.0), (1, 1, 2, 2, 0.4, 0.2, 2.0, 1.0)], "k int, c int, id int, t int, a double, b double, width double, height double")
    cells = {(r.ix, r.iy) for r in contacts.swept_cells(path, ["k"], "c", "t", "id", 0.15, 0.1).collect()}
    assert {(i, 3) for i in range(2, 8)} <= cells and not any(iy == 4 for _, iy in cells)


def widest(spark, run):
    """The most rows that one task wrote into a settled table, of all that ``run`` settles, and its result."""
    seen = []

    def spy(df):
        out = whole(df)
        seen.append(out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] or 0)
        return out

    modules = [importlib.import_module(f"weftline.operators.{m}") for m in ("history", "numbering")]
    whole = modules[0].settled
    for m in modules:
        m.settled = spy
    try:
        return run().collect(), max(seen)
    finally:
        for m in modules:
            m.settled = whole


@pytest.fixture
def uncoalesced(spark):
    """Partitions of shuffles and files of tables each have their own task."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "65536"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_seats_are_dealt_to_ranges(spark, uncoalesced):
    loads = {"ada": 3, "ben": 0, "cy": 9000, "dee": 10**9}
    units = spark.range(20_000)
    rows, most = widest(spark, lambda: picks.least_loaded(units, "id", [F.desc("id")], spark.createDataFrame(list(loads.items()), "who string, n long"), "who", "n"))
    got, now = {r.id: r.who for r in rows}, [(n, w) for w, n in loads.items()]
    heapq.heapify(now)
    for i in reversed(range(20_000)):
        n, who = heapq.heappop(now)
        heapq.heappush(now, (n + 1, who))
        assert got[i] == who
    # Four partitions hold units and seats by parts; only as many seats are made as are filled.
    assert 0 < most < 10_000
    assert picks.least_loaded(units, "id", [F.desc("id")], spark.createDataFrame([], "who string, n long"), "who", "n").isEmpty()


def test_ends_of_chains_are_not_all_in_one_task(spark, uncoalesced):
    # Chains of four: most records have been followed to their end after a round.
    edges = spark.range(8000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") - 1).alias("up"))
    edges = edges.unionAll(spark.createDataFrame([(9001, 9002), (9002, 9001)], "id long, up long"))
    rows, most = widest(spark, lambda: history.closure(edges, spark.createDataFrame([(1,), (4002,)], "id long"), "id", "up"))
    assert sorted(r.id for r in rows) == [1, 2, 3, 4002, 4003]
    assert most < 4000


def test_groups_of_workers_make_no_distinct_pairs(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None), (None, "a")], "w int, s string")
    assert {r.w: r.group for r in splits.worker_groups(rows, "w", "s").collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_numbering_shuffles_rows_once(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 1000).alias("a"), "id").repartition(5)
    out = numbering.numbered(df, ["a", "id"], "n")
    # Rows are numbered where they were written: no window over them and no second exchange.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "row_number" not in plan
    assert [r.n for r in sorted(out.collect(), key=lambda r: (r.a, r.id))] == list(range(1, 3001))


def test_block_sums_hold_no_transforms():
    rng = np.random.default_rng(4)
    here = [(rng.random((3, n)) < 0.6).astype(float) for n in (16, 24)]
    ours, theirs = (np.stack([h, x := h * rng.normal(size=h.shape), x * x], 1) for h in here)
    got = spectra.block_sums(ours, theirs, 4)
    assert got.base is None and got.shape == (3, 6, 9)
    want = [[sum(ours[b, 1, s] * theirs[b, 1, s + lag] for s in range(16) if s + lag < 24) for lag in range(9)] for b in range(3)]
    assert np.allclose(got[:, 5], want)


def test_votes_are_counted_without_lists_of_points(spark):
    pairs = spark.createDataFrame([(1, i, [float(i), 0.0, 1.0], [2.0 * i + (9 if i > 6 else 0), 0.0, 2.0]) for i in range(9)], "k int, id long, s array<double>, t array<double>")
    models = spark.createDataFrame([(1, 0, 2.0, [1.0, 0.0, 0.0, 0.0], [0.0] * 3), (1, 1, 1.0, [1.0, 0.0, 0.0, 0.0], [0.0] * 3)], "k int, h int, scale double, q array<double>, p array<double>")
    out = scenes.votes(pairs, models, ["k"], "id", "s", "t", 0.01)
    assert [(r.k, r.h, r.votes) for r in out.collect()] == [(1, 0, 7)]
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
