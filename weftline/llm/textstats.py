"""Statistics of one text: counts for quality rules and inputs of the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, schema_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPE = ("n_chars", "n_lines", "n_distinct", "n_upper", "n_lower", "n_digit", "n_bang", "n_pipe", "n_punct", "n_other", "longest_word", "top_word", "n_stop_like", "n_line_ends")
SCHEMA = ", ".join(f"{c} long" for c in (*COUNTS, *SHAPE))
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

#: Class of each ASCII character; all others count as letters beyond ASCII.
_KINDS = np.zeros(129, dtype=np.uint8)
for _kind, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "|", ".,;:?'\"()-"), start=1):
    for _c in _chars:
        _KINDS[ord(_c)] = _kind
_KINDS[128] = 7


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more. Windows are numbered by doubling, so equality is exact."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    number, span = ids, 1
    while span < width:
        step = min(span, width - span)
        m = len(ids) - (span + step) + 1
        pair = number[:m] * (int(number.max()) + 1) + number[step : step + m]
        number = np.unique(pair, return_inverse=True)[1]
        span += step
    twice = np.bincount(number) > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    hit = twice[number]
    edge[:n] += hit
    edge[width : width + n] -= hit
    return int((np.cumsum(edge)[:-1] > 0).sum())


def stats_of(text: str | None) -> tuple[int, ...]:
    """One value for each of COUNTS and SHAPE; a null text is as an empty one."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(_KINDS[np.minimum(chars, 128)], minlength=8)
    lines = text.split("\n")
    full = [x for x in lines if x.strip(SPACES)]
    return (
        len(words),
        len(chars) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(full) - len(set(full)),
        repeated_words(ids),
        len(chars),
        len(full),
        len(numbers),
        *(int(k) for k in kinds[1:8]),
        int(lengths.max()) if len(ids) else 0,
        int(np.bincount(ids).max()) if len(ids) else 0,
        int((lengths <= 3).sum()),
        sum(x.rstrip(SPACES)[-1:] in ".!?" for x in full),
    )


def stats_table(texts: pa.Array) -> np.ndarray:
    """A row for each text, in the order of COUNTS and SHAPE."""
    return np.array([stats_of(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS) + len(SHAPE))


def with_stats(df: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of the rows, and the statistics of their whole texts."""
    names = (*COUNTS, *SHAPE)

    def each(batch: pa.RecordBatch) -> dict:
        table = stats_table(batch.column("text"))
        return {c: batch.column(c) for c in columns} | {c: table[:, i] for i, c in enumerate(names)}

    return map_batches(df.select(*dict.fromkeys(("text", *columns))), each, schema_of(df, columns, SCHEMA))


def boxed(docs: DataFrame) -> DataFrame:
    """``text`` and, in a struct ``_rest`` if there are any, the other columns, whatever their names: rows go to Python whole, with their text once."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("text", *([F.struct(*rest).alias("_rest")] if rest else []))


def unboxed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of :func:`boxed` with their ``columns`` again."""
    return rows.select(*(F.col("text") if c == "text" else F.col(f"_rest.`{c}`") for c in columns))
