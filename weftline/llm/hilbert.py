"""Sharding along a Hilbert curve, in DataFrame functions alone.

Three metadata dimensions are quantised to 16 levels each; rows are sorted by the curve's
index of their cell and the order is cut into runs, so that a shard covers a compact
region of all three and a filter on any of them prunes shards. Shard sizes follow the
``rows`` law: counts are at most one apart.

The global place of a row is the number of rows in earlier cells, plus those in earlier
sub-cells of its cell, plus its place in its own sub-cell. A cell may hold a third of all
rows: sub-cells by a hash of the row, as many as keep a task at ``SUBCELL_ROWS`` rows even
then, share it out. Only counts of cells meet in one task, 4,096 at most, and those of a cell's
sub-cells. Inside a shard rows are in order of the curve, and within a cell of hashes: a reader
prunes shards by the ranges of :func:`manifest`, not rows of one cell.

Null texts have no bytes. Null langs and sources count as empty strings. Rows that repeat
are told apart by their place. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import staged

BITS, DIMS = 4, 3
#: Rows of a sub-cell, if one cell held all of them.
SUBCELL_ROWS = 50_000


def curve_index(cell: tuple[int, ...], bits: int) -> int:
    """Place of a cell on the Hilbert curve: undo the turns of each level from the top, then read the Gray code off the bits."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            turn ^= q - 1
        q >>= 1
    x = [v ^ turn for v in x]
    out = 0
    for b in reversed(range(bits)):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def _curve(cell: Column) -> Column:
    """Place on the curve of a cell, out of a constant array of all 4,096."""
    side = 1 << BITS
    places = [str(curve_index((a, b, c), BITS)) for a in range(side) for b in range(side) for c in range(side)]
    return F.element_at(F.split(F.lit(",".join(places)), ",").cast("array<int>"), cell + 1)


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of the text, and 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def dimensions() -> dict[str, Column]:
    """Level, 0 to 15, of each dimension."""
    hashed = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1 << BITS)).cast("int")
    doubling = F.least(F.floor(F.log2(F.col("size"))) - 4, F.lit((1 << BITS) - 1)).cast("int")
    return {"q_source": hashed("source"), "q_lang": hashed("lang"), "q_size": doubling}


def hilbert_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` (null), and the row's levels and place on the curve."""
    rows = docs.select("doc_id", "lang", "source", size_of().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    levels = dimensions()
    rows = rows.select("doc_id", "size", "text_crc32", *(v.alias(k) for k, v in levels.items()))
    number = F.lit(0)
    for k in levels:
        number = number * (1 << BITS) + F.col(k)
    rows = rows.withColumn("curve", _curve(number.cast("int")))
    rows = staged(rows, "hilbert-rows")
    subcells = max(64, -(-rows.count() // SUBCELL_ROWS))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(subcells)).cast("int"))

    counts = rows.groupBy("curve", "sub").agg(F.count("*").alias("n"))
    cells = counts.groupBy("curve").agg(F.sum("n").alias("n"))
    whole = W.Window.orderBy("curve")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("curve", before(whole).alias("cell_start"), F.sum("n").over(W.Window.orderBy("curve").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)).alias("total"))
    starts = counts.withColumn("start", before(W.Window.partitionBy("curve").orderBy("sub"))).drop("n")
    starts = starts.join(F.broadcast(cells), "curve").select("curve", "sub", (F.col("start") + F.col("cell_start")).alias("start"), "total")

    placed = rows.join(starts, ["curve", "sub"]).withColumn("rank", F.col("start") + F.row_number().over(W.Window.partitionBy("curve", "sub").orderBy("doc_id", "text_crc32")) - 1)
    shard = F.expr(f"rank * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("rank") - first)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), *levels, "curve")
    )


def manifest(sharded: DataFrame) -> DataFrame:
    """Per shard: rows, bytes, and the least and greatest level in each dimension; a filter keeps the shards whose ranges meet it."""
    ranges = [f(c).alias(f"{n}_{c}") for c in dimensions() for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *ranges)
