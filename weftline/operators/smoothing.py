"""Smoothing of tracks whose next value depends on the one before."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .streamed import streamed


def one_euro(df: DataFrame, keys: Sequence[str], time_ms: str, value: str, *, least_cutoff: float = 1.0, speed_weight: float = 0.01, speed_cutoff: float = 1.0) -> DataFrame:
    """Adds ``smooth``: a low-pass filter for each track whose cut-off rises with the filtered speed.

    ``value`` is a number or an array of numbers, each filtered by itself. A sample of no later
    time than the one before starts anew: its value stands and the speed is 0.
    """

    def weight(cutoff: float, dt: float) -> float:
        return 1 / (1 + 1 / (2 * math.pi * cutoff * dt))

    many = isinstance(df.schema[value].dataType, ArrayType)

    def step(state: tuple | None, row: dict) -> tuple[tuple, list[dict]]:
        t, values = row[time_ms], row[value] if many else [row[value]]
        if state is None or t <= state[0]:
            held, speeds = list(values), [0.0] * len(values)
        else:
            dt, held, speeds = (t - state[0]) / 1000, [], []
            for v, last, speed in zip(values, state[1], state[2], strict=True):
                speed += weight(speed_cutoff, dt) * ((v - last) / dt - speed)
                speeds.append(speed)
                held.append(last + weight(least_cutoff + speed_weight * abs(speed), dt) * (v - last))
        return (t, held, speeds), [row | {"smooth": held if many else held[0]}]

    kind = ArrayType(DoubleType()) if many else DoubleType()
    return streamed(df, keys, [time_ms], step, StructType([*df.schema.fields, StructField("smooth", kind)]))
