"""Correlation of two series at all lags, by Fourier transforms of overlapping blocks.

The first series is cut into blocks of slots; each block meets the part of the second that any
lag up to the largest can reach. A task transforms a batch of blocks with numpy and gives sums of
products by lag, which Spark adds up: the cost grows as n log n, no row is copied once a lag, and a key may have any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

Keys = Sequence[str]
#: Sums over the slots that both series have, for each lag: number, values, squares, products.
SUMS = ("n", "a", "b", "aa", "bb", "ab")


#: Blocks that are transformed, and handed back, together.
TOGETHER = 256


def _dense(packed: pa.StructArray, size: int) -> np.ndarray:
    """Presence, value and square by slot, for each block of lists of ``p`` and ``v``."""
    lists = packed.field("p"), packed.field("v")
    row = np.repeat(np.arange(len(packed)), pa.compute.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
    at, v = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    out = np.zeros((len(packed), 3, size))
    out[row, 0, at], out[row, 1, at], out[row, 2, at] = 1.0, v, v * v
    return out


def block_sums(ours: np.ndarray, theirs: np.ndarray, most_lag: int) -> np.ndarray:
    """For each block and each of SUMS, values by lag from ``-most_lag``; ``theirs`` starts ``most_lag`` slots before ``ours``."""
    n = ours.shape[-1] + theirs.shape[-1]
    size = 1 << (n - 1).bit_length()
    x, y = np.conj(np.fft.rfft(ours, size)), np.fft.rfft(theirs, size)
    out = np.empty((len(ours), len(SUMS), 2 * most_lag + 1))
    # Presence, values and squares of one series against presence of the other, and values against values.
    for k, (i, j) in enumerate(((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))):
        out[:, k] = np.fft.irfft(x[:, i] * y[:, j], size)[:, : 2 * most_lag + 1]
    return out


def correlations(a: DataFrame, b: DataFrame, keys: Keys, slot: str, value: str, most_lag: int, block: int | None = None) -> DataFrame:
    """Pearson correlation of two binned series (one row a slot) for each lag with slots in both: b's slot minus a's; null where a side doesn't vary. Blocks have ``block`` slots, by default four times the largest lag."""
    block = block or max(256, 4 * most_lag)
    # Values are taken from the series' own mean, which no correlation feels, so that sums stay small.
    means = lambda df, name: df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(name))
    middle = means(a, "_ma").join(means(b, "_mb"), list(keys))
    own = a.where(F.col(value).isNotNull()).select(*keys, F.col(slot).cast("long").alias("_s"), F.col(value).cast("double").alias("_v")).withColumn("_block", F.floor(F.col("_s") / block))
    reach = F.sequence(F.floor((F.col("_s") - most_lag) / block), F.floor((F.col("_s") + most_lag) / block))
    other = b.where(F.col(value).isNotNull()).select(*keys, F.col(slot).cast("long").alias("_s"), F.col(value).cast("double").alias("_v")).withColumn("_block", F.explode(reach))
    packed = lambda df, shift, x: df.groupBy(*keys, "_block").agg(F.collect_list(F.struct((F.col("_s") - F.col("_block") * block + shift).alias("p"), F.col("_v").alias("v"))).alias(x))
    blocks = packed(own, 0, "_a").join(packed(other, most_lag, "_b"), [*keys, "_block"]).join(middle, list(keys))
    parts = blocks.select(*keys, F.col("_a.p").alias("_ap"), F.transform("_a.v", lambda v: v - F.col("_ma")).alias("_av"), F.col("_b.p").alias("_bp"), F.transform("_b.v", lambda v: v - F.col("_mb")).alias("_bv"))
    schema = StructType([*(blocks.schema[k] for k in keys), StructField("lag", ArrayType(LongType())), *(StructField(f"_{s}", ArrayType(DoubleType())) for s in SUMS)])
    arrow = to_arrow_schema(schema)
    lags = np.arange(-most_lag, most_lag + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(start, TOGETHER)
                sides = [pa.StructArray.from_arrays([some.column(f"_{x}p"), some.column(f"_{x}v")], ["p", "v"]) for x in "ab"]
                sums = block_sums(_dense(sides[0], block), _dense(sides[1], block + 2 * most_lag), most_lag)
                ends = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * len(lags))
                columns = [*(some.column(k) for k in keys), pa.ListArray.from_arrays(ends, pa.array(np.tile(lags, some.num_rows)))]
                columns += [pa.ListArray.from_arrays(ends, pa.array(sums[:, i].ravel())) for i in range(len(SUMS))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    rows = parts.mapInArrow(run, schema).select(*keys, F.explode(F.arrays_zip("lag", *(f"_{s}" for s in SUMS))).alias("_x")).select(*keys, "_x.*")
    total = rows.groupBy(*keys, "lag").agg(F.round(F.sum("_n")).cast("long").alias("n"), *(F.sum(f"_{s}").alias(f"_{s}") for s in SUMS[1:])).where("n > 0")
    va, vb = F.col("n") * F.col("_aa") - F.col("_a") * F.col("_a"), F.col("n") * F.col("_bb") - F.col("_b") * F.col("_b")
    # What rounding leaves of no variance at all is no variance.
    varies = (va > 1e-9 * F.col("n") * F.abs("_aa")) & (vb > 1e-9 * F.col("n") * F.abs("_bb")) & (F.col("n") > 1)
    return total.select(*keys, "lag", F.when(varies, (F.col("n") * F.col("_ab") - F.col("_a") * F.col("_b")) / F.sqrt(va * vb)).alias("correlation"), "n")


def peak(rows: DataFrame, keys: Keys, exclude: int, least_others: int = 11) -> DataFrame:
    """The lag of the highest correlation, between lags by a parabola through its neighbours, and how many standard deviations it stands above the others further than ``exclude``: 0 with fewer than ``least_others`` of these."""
    known = rows.where("correlation is not null")
    best = known.groupBy(*keys).agg(F.max(F.struct("correlation", (-F.col("lag")).alias("_l"))).alias("_m")).select(*keys, F.col("_m.correlation").alias("top"), (-F.col("_m._l")).alias("at"))
    met = known.join(best, list(keys))
    beside = lambda d: F.max(F.when(F.col("lag") == F.col("at") + d, F.col("correlation")))
    far = F.when(F.abs(F.col("lag") - F.col("at")) > exclude, F.col("correlation"))
    out = met.groupBy(*keys, "at", "top").agg(beside(-1).alias("_a"), beside(1).alias("_c"), F.count(far).alias("_n"), F.avg(far).alias("_mean"), F.stddev_pop(far).alias("_dev"))
    bend = F.col("_a") - 2 * F.col("top") + F.col("_c")
    shift = F.coalesce(F.when(bend != 0, 0.5 * (F.col("_a") - F.col("_c")) / bend), F.lit(0.0))
    height = F.when(F.col("_n") >= least_others, (F.col("top") - F.col("_mean")) / F.when(F.col("_dev") > 0, F.col("_dev")).otherwise(1e-12)).otherwise(0.0)
    return out.select(*keys, (F.col("at") + shift).alias("lag"), F.col("top").alias("correlation"), height.alias("psr"))


def first_method(results: Sequence[tuple[str, DataFrame]], keys: Keys, usable: str = "ok") -> DataFrame:
    """For each key the result of the first method, in this order, that is ``usable`` there; results have equal columns, and ``method`` names where a row comes from. Keys that no method serves have no row."""
    every = None
    for place, (name, df) in enumerate(results):
        rows = df.withColumn("method", F.lit(name)).withColumn("_place", F.lit(place))
        every = rows if every is None else every.unionByName(rows)
    fit = every.where(F.col(usable))
    values = [c for c in fit.columns if c not in (*keys, "_place")]
    return fit.groupBy(*keys).agg(F.min_by(F.struct(*values), "_place").alias("_b")).select(*keys, "_b.*")
