"""Quality classifier: gradient-boosted trees on histograms of document statistics.

Statistics of all texts are taken in one pass. A bounded sample of labelled rows
(about ``max_rows``, those of least id hash) is binned by its quantiles and fitted with
second-order logistic boosting; trees become flat arrays that Arrow tasks walk for a
whole batch at once.

Null texts count as empty and get a score. Labels that are null, or whose document is
missing, are left out; a document with several labels takes the largest. Without
training rows every score is the prior, 0.5. Very long texts are counted whole; repeated
rows score alike; an empty table gives an empty result. Extra columns, whatever their
names, play no part in scores and pass through :func:`accepted` as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import label_sample, map_batches, remainder_of_id, schema_of, staged
from .textstats import COUNTS, SHAPE, boxed, stats_table, unboxed, with_stats

INPUTS = (*COUNTS, *SHAPE)


def features(counts: np.ndarray) -> np.ndarray:
    """Counts, one row each in the order of INPUTS, to ratios that don't depend on length, and two sizes."""
    c = {k: counts[:, i].astype(np.float64) for i, k in enumerate(INPUTS)}
    words, lines, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["word_chars"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"] + c["n_other"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), np.log1p(c["n_lines"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_distinct"] / words, c["n_upper"] / letters, c["n_lower"] / chars, c["n_digit"] / chars, c["n_bang"] / words, c["n_pipe"] / words, c["n_punct"] / words,
        c["n_other"] / chars, c["longest_word"], c["top_word"] / words, c["n_stop_like"] / words, c["n_line_ends"] / lines, c["n_words"] / lines,
    ])


@dataclass
class Forest:
    """Trees as arrays over all nodes: a node's input, the value up to which rows go left, its left child (right is the next), and its leaf value. A leaf is its own child."""

    roots: np.ndarray
    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all rows and trees go down together, a level at a time."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, dtype=np.int64)
            for _ in range(self.depth):
                inner = self.left[at] != at
                at = np.where(inner, self.left[at] + (x[rows, self.column[at]] > self.cut[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least_rows: int = 10) -> Forest:
    """Boosting by histograms: gradients are summed by (node, column, bin), and each node takes the bin edge of most gain."""
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    flat: dict[str, list] = {k: [] for k in ("column", "cut", "left", "value")}
    roots: list[int] = []

    def node() -> int:
        for k, v in (("column", 0), ("cut", np.inf), ("left", len(flat["left"])), ("value", 0.0)):
            flat[k].append(v)
        return len(flat["left"]) - 1

    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)]).astype(np.int64) if n else np.zeros((0, width), np.int64)
    offsets = np.arange(width) * bins
    margin = np.full(n, start)
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        roots.append(node())
        at, live = np.full(n, roots[-1]), [roots[-1]]
        for level in range(depth + 1):
            number = np.full(len(flat["left"]), -1)
            number[live] = np.arange(len(live))
            rows = np.flatnonzero(number[at] >= 0)
            cell = ((number[at[rows]] * width * bins)[:, None] + offsets + binned[rows]).ravel()
            sums = [np.bincount(cell, np.repeat(v, width), len(live) * width * bins).reshape(len(live), width, bins) for v in (gradient[rows], weight[rows], np.ones(len(rows)))]
            g, h, c = (s.cumsum(2) for s in sums)
            grown: list[int] = []
            for k, parent in enumerate(live):
                gt, ht, ct = g[k, 0, -1], h[k, 0, -1], c[k, 0, -1]
                flat["value"][parent] = float(-rate * gt / (ht + ridge))
                gain = g[k] ** 2 / (h[k] + ridge) + (gt - g[k]) ** 2 / (ht - h[k] + ridge) - gt**2 / (ht + ridge)
                gain[(c[k] < least_rows) | (ct - c[k] < least_rows)] = 0
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if level == depth or gain[j, b] <= 1e-6 or b >= len(edges[j]):
                    continue
                left, right = node(), node()
                flat["column"][parent], flat["cut"][parent], flat["left"][parent] = int(j), float(edges[j][b]), left
                mine = rows[at[rows] == parent]
                at[mine] = np.where(binned[mine, j] > b, right, left)
                grown += [left, right]
            if not (live := grown):
                break
        margin += np.array(flat["value"])[at]
    arrays = {k: np.array(v, dtype=np.float64 if k in ("cut", "value") else np.int64) for k, v in flat.items()}
    return Forest(np.array(roots, dtype=np.int64), depth=depth, start=start if len(y) else 0.0, **arrays)


def trained(stats: DataFrame, labels: DataFrame, label: str, held_out: Column, max_rows: int) -> Forest:
    """Trees fitted to the sampled rows' statistics; of rows that repeat an id one takes part, that of least statistics."""
    sample = label_sample(labels, label, ~held_out, max_rows)
    rows = stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("_label", *INPUTS)).alias("_r")).select("_r.*").toPandas()
    counts = rows[list(INPUTS)].to_numpy(dtype=np.int64).reshape(-1, len(INPUTS))
    return fit_forest(features(counts), rows["_label"].to_numpy(dtype=np.float64))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id`` and ``score``."""

    def each(batch: pa.RecordBatch) -> dict:
        counts = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in INPUTS])
        return {"doc_id": batch.column("doc_id"), "score": forest.score(features(counts))}

    return map_batches(stats, each, schema_of(stats, ("doc_id",), "score double"))


def quality_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_fold: int = 0, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of each document."""
    stats = staged(with_stats(docs), "classifier-stats")
    held = remainder_of_id("doc_id", folds) == held_fold
    forest = trained(stats, labels, "quality", held, max_rows)
    return scored(stats, forest).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_fold: int = 0, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """The documents predicted to be good, same columns. Statistics are taken twice, of the sample and of all rows; texts are never shuffled.

    One Python worker a task counts, scores and drops: two in a row would double the workers that executors hold from then on.
    """
    held = remainder_of_id("doc_id", folds) == held_fold
    sampled = docs.select("doc_id", "text").join(F.broadcast(label_sample(labels, "quality", ~held, max_rows).select("doc_id")), "doc_id", "left_semi")
    forest = trained(with_stats(sampled), labels, "quality", held, max_rows)
    rows = boxed(docs)
    names = tuple(rows.columns)

    def each(batch: pa.RecordBatch) -> dict:
        good = pa.array(forest.score(features(stats_table(batch.column("text")))) >= threshold)
        return {c: batch.column(c).filter(good) for c in names}

    return unboxed(map_batches(rows, each, rows.schema), docs.columns)
