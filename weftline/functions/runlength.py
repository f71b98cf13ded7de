"""Run-length masks: counts down the columns, and their printable string."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def runs(mask: np.ndarray) -> list[int]:
    """Lengths of runs of a mask read down its columns, zeros first (0 if it starts with a one)."""
    flat = np.asarray(mask, dtype=np.uint8).ravel(order="F")
    if not len(flat):
        return []
    edges = np.flatnonzero(np.diff(flat)) + 1
    counts = np.diff(np.concatenate([[0], edges, [len(flat)]]))
    return ([0] if flat[0] else []) + counts.tolist()


def written(counts: list[int]) -> str:
    """Counts as text: from the fourth on the difference to the count two before; five bits a character from 48 on, the sixth says that more follow."""
    out = []
    for i, n in enumerate(counts):
        x, more = n - counts[i - 2] if i > 2 else n, True
        while more:
            bits, x = x & 31, x >> 5
            more = x != (-1 if bits & 16 else 0)
            out.append(chr(48 + (bits | 32 if more else bits)))
    return "".join(out)


def read(text: str) -> list[int]:
    """The inverse of :func:`written`."""
    out: list[int] = []
    x = shift = 0
    for c in text:
        bits = ord(c) - 48
        x |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            if bits & 16:
                x |= -1 << shift
            out.append(x + out[-2] if len(out) > 2 else x)
            x = shift = 0
    return out


def mask_of(counts: list[int], height: int, width: int) -> np.ndarray:
    flat = np.repeat(np.arange(len(counts)) % 2, counts).astype(bool)
    if len(flat) != height * width:
        raise ValueError(f"runs cover {len(flat)} of {height * width} pixels")
    return flat.reshape((height, width), order="F")


def encode(mask: Column) -> Column:
    """Text of a mask, an array of rows of booleans; null for null."""

    @F.pandas_udf("string")
    def each(masks: pd.Series) -> pd.Series:
        return masks.map(lambda m: None if m is None else written(runs(np.stack([np.asarray(r, dtype=bool) for r in m]) if len(m) else np.zeros((0, 0)))))

    return each(mask)


def decode(text: Column, height: Column, width: Column) -> Column:
    """The mask of a text, as an array of rows; an error where its runs don't fill the size."""

    @F.pandas_udf("array<array<boolean>>")
    def each(texts: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [list(map(bool, r)) for r in mask_of(read(t), int(h), int(w))] for t, h, w in zip(texts, heights, widths, strict=True)], dtype=object)

    return each(text, height, width)


def area_and_box(text: Column, height: Column) -> Column:
    """``area`` and the box ``x``, ``y``, ``w``, ``h`` of a mask's text, from its runs alone; an empty mask's box is all 0."""

    def one(t: str | None, h: int) -> dict:
        if t is None:
            return dict.fromkeys(("area", "x", "y", "w", "h"))
        ends = np.cumsum(read(t))
        starts, stops = ends[0::2][: len(ends) // 2], ends[1::2]
        starts, stops = starts[stops > starts], stops[stops > starts]
        if not len(starts):
            return dict.fromkeys(("area", "x", "y", "w", "h"), 0)
        left, right = int(starts.min() // h), int((stops.max() - 1) // h)
        # A run over the end of a column touches the last row and the first.
        over = starts // h != (stops - 1) // h
        low = 0 if over.any() else int((starts % h).min())
        high = h - 1 if over.any() else int(((stops - 1) % h).max())
        return {"area": int((stops - starts).sum()), "x": left, "y": low, "w": right - left + 1, "h": high - low + 1}

    @F.pandas_udf("struct<area: long, x: long, y: long, w: long, h: long>")
    def each(texts: pd.Series, heights: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t, int(h)) for t, h in zip(texts, heights, strict=True)], columns=["area", "x", "y", "w", "h"])

    return each(text, height)
