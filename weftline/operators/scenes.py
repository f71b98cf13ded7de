"""Two reconstructions of one place: matched descriptors, a robust similarity between them, and whether to trust it.

Descriptors meet block by block: a block of one side and one of the other are compared by a
matrix product in one task, which keeps the nearest alone, so no list of all pairs is ever made. Hypotheses of the
similarity are rows, drawn by hashes; points vote on all of them, and votes are summed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import rotations
from . import poses
from .settled import settled

Keys = Sequence[str]


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def nearest_two(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``a``: distance and id of the nearest row of ``b`` (the least id of equals), and the distance of the second."""
    order = np.argsort(ids, kind="stable")
    b, ids = b[order], ids[order]
    square = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)
    # Products lose what nearly equal vectors differ by: the few nearest are measured again.
    few = np.argpartition(square, min(7, len(b) - 1), axis=1)[:, :8]
    exact = ((a[:, None] - b[few]) ** 2).sum(2)
    place = np.lexsort((few, exact), axis=1)
    row = np.arange(len(a))
    first = few[row, place[:, 0]]
    second = np.sqrt(exact[row, place[:, 1]]) if few.shape[1] > 1 else np.full(len(a), np.inf)
    return np.sqrt(exact[row, place[:, 0]]), ids[first], second


def match_descriptors(a: DataFrame, b: DataFrame, keys: Keys, row_id: str, vector: str, ratio: float, block: int = 2048) -> DataFrame:
    """Pairs ``a_id``, ``b_id`` with ``distance``: each the other's nearest, and nearer than ``ratio`` times a's second nearest. Keys where a side has fewer than two rows have none; equally near ones go by the least id."""
    sizes = lambda df, x: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(x))
    both = sizes(a, "_na").join(sizes(b, "_nb"), list(keys)).where("_na > 1 and _nb > 1")
    both = both.select(*keys, F.ceil(F.col("_na") / block).cast("int").alias("_ba"), F.ceil(F.col("_nb") / block).cast("int").alias("_bb"))

    def dealt(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        rows = df.select(*keys, F.col(row_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")).join(both, list(keys))
        # New names for all columns: the two sides may come from one table.
        return rows.select(*(F.col(c).alias(c) for c in (*keys, "_id", "_v")), F.pmod(F.xxhash64("_id"), F.col(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))

    left, right = dealt(a, "_ba", "_bb", "_i", "_j"), dealt(b, "_bb", "_ba", "_j", "_i")
    cell = [*keys, "_i", "_j"]
    schema = StructType([*(left.schema[k] for k in keys), StructField("side", StringType()), StructField("_id", LongType()), StructField("_near", LongType()), StructField("_d", DoubleType()), StructField("_second", DoubleType())])
    arrow = to_arrow_schema(schema)

    def compared(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return arrow.empty_table()
        ids = [t.column("_id").to_numpy() for t in (x, y)]
        vectors = [_vectors(t.column("_v")) for t in (x, y)]
        parts = []
        for side, i, j in (("a", 0, 1), ("b", 1, 0)):
            d, near, second = nearest_two(vectors[i], vectors[j], ids[j])
            fixed = [pa.array([x.column(k)[0].as_py()] * len(d), type=arrow.field(k).type) for k in keys]
            parts.append(pa.Table.from_arrays([*fixed, pa.array([side] * len(d)), pa.array(ids[i]), pa.array(near), pa.array(d), pa.array(second)], schema=arrow))
        return pa.concat_tables(parts)

    found = settled(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compared, schema))
    # A block gives its nearest and the distance of its second: the two least of all blocks' are the two nearest.
    best = found.groupBy(*keys, "side", "_id").agg(F.min(F.struct("_d", "_near")).alias("_m"), F.slice(F.array_sort(F.flatten(F.collect_list(F.array("_d", "_second")))), 1, 2).alias("_two"))
    ours = best.where("side = 'a'").select(*keys, F.col("_id").alias("a_id"), F.col("_m._near").alias("b_id"), F.col("_m._d").alias("distance"), F.element_at("_two", 2).alias("_next"))
    theirs = best.where("side = 'b'").select(*keys, F.col("_id").alias("b_id"), F.col("_m._near").alias("a_id"))
    return ours.where(F.col("distance") < ratio * F.col("_next")).drop("_next").join(theirs, [*keys, "a_id", "b_id"])


def hypotheses(pairs: DataFrame, keys: Keys, pair_id: str, source: str, target: str, iterations: int, seed: int) -> DataFrame:
    """Rows ``h``, ``scale``, ``q``, ``p``: similarities through three pairs each. The pairs are the first three, by a hash of seed, hypothesis and place of the pair in order of its id."""
    places = [f"_{x}{i}" for x in "st" for i in range(3)]
    numbered = _split(pairs, keys, source, target, pair_id).select(*keys, *places, (F.row_number().over(W.Window.partitionBy(*keys).orderBy(pair_id)) - 1).alias("_i"))
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    draws = sizes.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    # Three different places: two hashes into what is left, moved past those taken.
    hashed = lambda j, n: F.pmod(F.xxhash64(F.lit(seed), F.col("h"), F.lit(j)), n)
    first, second, third = hashed(0, F.col("_n")), hashed(1, F.col("_n") - 1), hashed(2, F.col("_n") - 2)
    draws = draws.withColumn("_a", first).withColumn("_b", second + (second >= F.col("_a")).cast("long"))
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    draws = draws.withColumn("_c", third + (third >= low).cast("long")).withColumn("_c", F.when(F.col("_c") >= high, F.col("_c") + 1).otherwise(F.col("_c")))
    picked = draws.select(*keys, "h", F.explode(F.array("_a", "_b", "_c")).alias("_i")).join(numbered, [*keys, "_i"])
    return poses.similarity(picked.select(*keys, "h", F.array(*places[:3]).alias("_s"), F.array(*places[3:]).alias("_t")), [*keys, "h"], "_s", "_t").where("not isnan(scale) and scale > 0 and scale < 1e12").drop("n")


def _split(pairs: DataFrame, keys: Keys, source: str, target: str, *more: str) -> DataFrame:
    """Points as plain columns: ``_s0`` to ``_s2``, ``_t0`` to ``_t2``."""
    return pairs.select(*keys, *more, *(F.col(c).getItem(i).cast("double").alias(f"_{x}{i}") for x, c in (("s", source), ("t", target)) for i in range(3)))


def _flat(models: DataFrame, name: str, *kept: str) -> DataFrame:
    """Models as twelve plain columns: the scaled rotation by rows, then the shift."""
    rows = models.select(*kept, "scale", "p", rotations.to_matrix(F.col("q")).alias("_r"))
    return rows.select(*kept, *((F.col("scale") * F.col("_r").getItem(i)).alias(f"_{name}{i}") for i in range(9)), *(F.col("p").getItem(i).alias(f"_{name}{9 + i}") for i in range(3)))


def _error(name: str) -> Column:
    """How far the model brings the source point from its target."""
    off = [sum((F.col(f"_{name}{3 * r + c}") * F.col(f"_s{c}") for c in range(3)), F.col(f"_{name}{9 + r}")) - F.col(f"_t{r}") for r in range(3)]
    return F.sqrt(sum((F.pow(x, F.lit(2.0)) for x in off[1:]), F.pow(off[0], F.lit(2.0))))


def votes(pairs: DataFrame, models: DataFrame, keys: Keys, pair_id: str, source: str, target: str, threshold: float) -> DataFrame:
    """``h`` and ``votes`` of each model with any: pairs that it brings within the threshold. Each pair meets each model of its key, and is counted at once."""
    met = _split(pairs, keys, source, target).join(_flat(models, "m", *keys, "h"), list(keys))
    return met.where(_error("m") <= threshold).groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("votes"))


def ransac_similarity(pairs: DataFrame, keys: Keys, pair_id: str, source: str, target: str, threshold: float, iterations: int = 200, seed: int = 1) -> DataFrame:
    """``scale``, ``q``, ``p`` from source to target points (arrays of three), ``inliers`` and their ``rms``, per key with three pairs or more; null where no three agree.

    The hypothesis with most pairs within ``threshold`` (of equals the first) is fitted again to these, twice more to those that the
    fit brings within it. The draws depend on seed and ids alone, so any partitioning gives the same result.
    """
    models = settled(hypotheses(pairs, keys, pair_id, source, target, iterations, seed))
    best = votes(pairs, models, keys, pair_id, source, target, threshold).groupBy(*keys).agg(F.min_by("h", F.struct(-F.col("votes"), "h")).alias("h"))
    fit = models.join(best, [*keys, "h"]).drop("h")
    points = _split(pairs, keys, source, target)
    for _ in range(3):
        near = points.join(_flat(fit, "m", *keys), list(keys)).where(_error("m") <= threshold).select(*keys, F.array("_s0", "_s1", "_s2").alias("_s"), F.array("_t0", "_t1", "_t2").alias("_t"))
        again = settled(poses.similarity(near, keys, "_s", "_t").where("n >= 3").drop("n"))
        used, fit = fit, again
    # What the last fit was made from counts, not what it brings near.
    both = _flat(used, "u", *keys).join(_flat(fit, "m", *keys), list(keys))
    taken = points.join(both, list(keys)).where(_error("u") <= threshold)
    sums = taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("inliers"), F.sqrt(F.avg(F.pow(_error("m"), F.lit(2)))).alias("rms"))
    every = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches")).where("matches >= 3")
    return every.join(fit, list(keys), "left").join(sums, list(keys), "left").fillna({"inliers": 0})


def align_scenes(before: DataFrame, after: DataFrame, keys: Keys, row_id: str, point: str, vector: str, ratio: float, threshold: float, least_inliers: int, least_share: float, most_rms: float, iterations: int = 200, seed: int = 1) -> DataFrame:
    """The similarity from ``after`` to ``before`` for each key, with ``matches``, ``inliers``, ``rms``, whether it is ``accepted``, and else the ``reason``: inliers, share or rms."""
    found = match_descriptors(after, before, keys, row_id, vector, ratio)
    place = lambda df, x: df.select(*keys, F.col(row_id).cast("long").alias(f"{x}_id"), F.col(point).cast("array<double>").alias(f"_{x}"))
    pairs = settled(found.join(place(after, "a"), [*keys, "a_id"]).join(place(before, "b"), [*keys, "b_id"]).select(*keys, "a_id", "_a", "_b"))
    fits = ransac_similarity(pairs, keys, "a_id", "_a", "_b", threshold, iterations, seed)
    scenes = before.select(*keys).unionByName(after.select(*keys)).distinct()
    out = scenes.join(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pairs")), list(keys), "left").join(fits.drop("matches"), list(keys), "left").fillna({"_pairs": 0, "inliers": 0})
    reason = F.when(F.col("scale").isNull() | (F.col("inliers") < least_inliers), "inliers").when(F.col("inliers") < least_share * F.col("_pairs"), "share").when(F.col("rms") > most_rms, "rms")
    return out.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).withColumnRenamed("_pairs", "matches")
