"""Optimal one-to-one matching: of any candidate pairs by cost, and of events by time."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .streamed import in_groups, streamed, with_rivals

Keys = Sequence[str]
#: Cost of a pair that isn't allowed.
NEVER = 1e12


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, each row and column once at most; as many pairs as the shorter side has."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in least_cost(cost.T))
    rows, columns = cost.shape
    price_row, price_column = np.zeros(rows), np.zeros(columns)
    holder = np.full(columns, -1)
    for start in range(rows):
        slack, came_from, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, last = start, -1
        while True:
            reduced = cost[row] - price_row[row] - price_column
            better = ~done & (reduced < slack)
            slack[better], came_from[better] = reduced[better], last
            nearest = int(np.where(done, np.inf, slack).argmin())
            step = slack[nearest]
            price_row[start] += step
            price_row[holder[done]] += step
            price_column[done] -= step
            slack[~done] -= step
            done[nearest], last, row = True, nearest, holder[nearest]
            if row < 0:
                break
        while last >= 0:
            before = came_from[last]
            holder[last] = holder[before] if before >= 0 else start
            last = before
    return sorted((int(r), c) for c, r in enumerate(holder) if r >= 0)


def assigned(pairs: DataFrame, group: Keys, left: str, right: str, cost: str, *, optional: bool = False) -> DataFrame:
    """Of candidate pairs, those of the cheapest matching that has as many pairs as can be, for each group. ``optional``: of the cheapest matching of any size, where a negative cost is a gain.

    A group is what must be decided at once, such as the boxes of one frame or the tracks of one recording.
    """
    names = [*group, left, right, cost]
    near = with_rivals(pairs.select(names), group, left, right, "_rivals")
    # A pair whose sides are in no other pair is decided by itself.
    lone = near.where("not _rivals" + (f" and `{cost}` < 0" if optional else "")).drop("_rivals")

    def solve(table: pa.Table, starts: np.ndarray) -> pa.Table:
        a, b = (np.unique(table.column(c).to_numpy(), return_inverse=True)[1] for c in (left, right))
        costs, none, hits = table.column(cost).to_numpy().astype(float), 0.0 if optional else NEVER, []
        for low, high in zip(starts, [*starts[1:], table.num_rows], strict=True):
            x, y = (np.unique(v[low:high], return_inverse=True)[1] for v in (a, b))
            whole = np.full((x.max() + 1, y.max() + 1), none)
            np.minimum.at(whole, (x, y), costs[low:high])
            chosen = {(r, c) for r, c in least_cost(whole) if whole[r, c] < none}
            for i, pair in enumerate(zip(x, y, strict=True)):
                if pair in chosen:
                    chosen.remove(pair)
                    hits.append(low + i)
        return table.take(hits)

    rest = near.where("_rivals").drop("_rivals")
    return lone.unionByName(in_groups(rest, group, solve, rest.schema))


def event_matches(truth: DataFrame, found: DataFrame, keys: Keys, time: str, tolerance: int) -> DataFrame:
    """Hits, misses and false alarms per key: events match one to one within an inclusive tolerance, as many as can be.

    On a line the earliest truth and the earliest find that are near enough can always be a pair
    of a largest matching. So events pass in order of time, and only those still waiting are
    held: no more than fall within the tolerance.
    """
    both = truth.select(*keys, F.col(time).alias("at"), F.lit(True).alias("real")).unionAll(found.select(*keys, F.col(time).alias("at"), F.lit(False).alias("real")))

    def row(state: dict) -> list[dict]:
        return [state["key"] | {"hits": state["hits"], "misses": state["seen"][True] - state["hits"], "false_alarms": state["seen"][False] - state["hits"]}]

    def step(state: dict | None, event: dict) -> tuple[dict, list[dict]]:
        if state is None:
            state = {"key": {k: event[k] for k in keys}, "hits": 0, "seen": {True: 0, False: 0}, "waiting": deque(), "kind": True}
        waiting, real, at = state["waiting"], event["real"], event["at"]
        state["seen"][real] += 1
        while waiting and at - waiting[0] > tolerance:
            waiting.popleft()
        if waiting and state["kind"] != real:
            waiting.popleft()
            state["hits"] += 1
        else:
            state["kind"] = real
            waiting.append(at)
        return state, []

    schema = StructType([*(both.schema[k] for k in keys), *(StructField(c, LongType()) for c in ("hits", "misses", "false_alarms"))])
    return streamed(both, keys, ["at", "real"], step, schema, end=row)
