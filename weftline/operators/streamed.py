"""Recurrences over sorted sequences, with the state carried from batch to batch.

Rows of a key meet in one task, sorted by Spark, and stream through Python an Arrow batch at a
time: a key may be longer than memory. Only for what no window function can say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def streamed(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[Any, dict], tuple[Any, list[dict]]], schema: StructType, end: Callable[[Any], list[dict]] | None = None) -> DataFrame:
    """``step`` gets the state (None at the first row of a key) and a row, and gives the state and rows to put out; ``end`` gives the last rows of a key."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, started = None, None, False
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if started and key != held:
                    out += end(state) if end else []
                    state = None
                held, started = key, True
                state, rows = step(state, row)
                out += rows
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if started and end and (rows := end(state)):
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def in_groups(df: DataFrame, keys: Sequence[str], solve: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """``solve`` gets whole groups, many at a time: rows sorted by key, and where each group starts. One group must fit in memory."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from solve(table, starts).cast(arrow).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            starts = _starts(table, keys)
            if len(starts) > 1:
                yield from solved(table.slice(0, starts[-1]), starts[:-1])
                held = table.slice(starts[-1]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from solved(table, _starts(table, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    fresh = np.zeros(table.num_rows, dtype=bool)
    fresh[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(fresh)


def with_rivals(pairs: DataFrame, keys: Sequence[str], left: str, right: str, name: str = "rivals") -> DataFrame:
    """Adds whether a side of the pair is in another pair of its key, too. One shuffle, by ``keys``."""
    count = lambda side: F.count(F.lit(1)).over(W.Window.partitionBy(*keys, side))
    return pairs.repartition(*keys).withColumn(name, (count(left) > 1) | (count(right) > 1))
