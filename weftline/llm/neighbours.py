"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Equal vectors are indexed once. Distinct vectors are dealt by hash to shards of about
``SHARD`` and each shard becomes one row of flat arrays: vectors, ids, and for each level
its nodes and their neighbours. A task opens a shard once and streams queries through it;
the shards' nearest are merged, copies of found vectors are added, and scores are exact on
the originals.

Nodes enter a graph in batches that double its size. Each links to earlier nodes that
spread around it; these link back, and a node with too many neighbours chooses anew among
all of them by the same rule, so that clusters keep their ways in and out. What the entry
can't reach in the end is hung on its nearest node that it can reach.

Vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do rows without an id. Vectors meet only vectors of their own length. Ties go to the
smaller id; with fewer candidates than asked for, all come. An id that repeats counts as
several candidates with one name. An empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import importable, map_batches, staged, unstage

#: Vectors of a shard; links of a node (twice as many on the ground level, and ``SPARE`` for nodes else out of reach); candidates that new links are chosen from; width of a search; nodes it opens at once; queries walking together; queries that a copy of a shard serves.
SHARD, LINKS, SPARE, CANDIDATES, SEARCH_WIDTH, OPENED, TOGETHER, SERVED = 8192, 16, 2, 64, 96, 8, 256, 4096


def _spread(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates, nearest first and -1 for none: those that lie nearer to the node than to one already chosen; then the nearest others, up to ``most``."""
    valid, near = ids >= 0, vectors[ids]
    between = near @ near.transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, dtype=bool)
    for k in range(ids.shape[1]):
        closest = np.where(chosen, between[:, k], -2).max(1)
        chosen[:, k] = valid[:, k] & (closest < sims[:, k]) & (chosen.sum(1) < most)
    place = np.where(valid, np.where(chosen, 0, ids.shape[1]) + np.arange(ids.shape[1]), 3 * ids.shape[1])
    order = place.argsort(1, kind="stable")[:, :most]
    return np.take_along_axis(np.where(valid, ids, -1), order, 1)


def _linked_back(vectors: np.ndarray, links: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Nodes that were chosen link to those that chose them."""
    most = links.shape[1]
    source, target = np.repeat(nodes, (chosen >= 0).sum(1)), chosen[chosen >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    # A node gets ``most`` new ones at a time, so that no array grows with its popularity.
    for turn in range(int(place.max(initial=-1)) // most + 1):
        mine = place // most == turn
        ids, row = np.unique(target[mine], return_inverse=True)
        rows = np.full((len(ids), 2 * most), -1, dtype=np.int64)
        rows[:, :most] = links[ids]
        rows[row, most + place[mine] % most] = source[mine]
        width = max(8, 4_000_000 // (2 * most * vectors.shape[1]))
        for at in range(0, len(ids), width):
            part, own = rows[at : at + width], ids[at : at + width]
            sims = np.where(part >= 0, (vectors[part] @ vectors[own][:, :, None])[:, :, 0], -2)
            order = (-sims).argsort(1, kind="stable")
            links[own] = _spread(vectors, np.take_along_axis(part, order, 1), np.take_along_axis(sims, order, 1), most)


def _graph(vectors: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of each node (-1 where none) on one level."""
    n, done = len(vectors), 1
    links = np.full((n, most), -1, dtype=np.int32)
    width = max(8, 8_000_000 // (CANDIDATES * vectors.shape[1]))
    while done < n:
        end = min(n, 2 * done, done + width)
        sims = vectors[done:end] @ vectors[:end].T
        sims[np.arange(end) >= np.arange(done, end)[:, None]] = -2
        k = min(CANDIDATES, end)
        ids = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(sims, ids, 1)
        order = np.lexsort((ids, -near), axis=1)
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        chosen = _spread(vectors, np.where(near > -2, ids, -1), near, max(1, most // 2))
        links[done:end, : chosen.shape[1]] = chosen
        _linked_back(vectors, links, np.arange(done, end), chosen)
        done = end
    return links


def _reached(links: np.ndarray) -> np.ndarray:
    """Which nodes node 0 reaches."""
    seen = np.zeros(len(links) + 1, dtype=bool)
    seen[-1] = seen[0] = True
    front = np.array([0])
    while len(front):
        front = np.unique(links[front])
        front = front[~seen[front]]
        seen[front] = True
    return seen[:-1]


def build(vectors: np.ndarray) -> list[np.ndarray]:
    """Per level from 0, an array of each node's neighbours (-1 where none). Vectors have length one; node 0 is on all levels, where searches enter."""
    n = len(vectors)
    levels = np.minimum((-np.log(1 - np.random.default_rng(n).random(n)) / np.log(LINKS)).astype(int), 8)
    levels[:1] = levels.max(initial=0)
    out = []
    for level in range(int(levels.max(initial=0)) + 1):
        nodes = np.flatnonzero(levels >= level)
        own = _graph(vectors[nodes], LINKS * (1 if level else 2))
        links = np.full((n, own.shape[1] + (0 if level else SPARE)), -1, dtype=np.int32)
        links[nodes, : own.shape[1]] = np.where(own >= 0, nodes[own], -1)
        out.append(links)
    ground, free = out[0], np.full(n, SPARE)
    while not (seen := _reached(ground)).all():
        lost, hosts = np.flatnonzero(~seen)[:512], np.flatnonzero(seen & (free > 0))
        nearest = hosts[(vectors[lost] @ vectors[hosts].T).argmax(1)]
        host, first = np.unique(nearest, return_index=True)
        ground[host, -free[host]] = lost[first]
        free[host] -= 1
    return out


def search(unit: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
    """Best-first walks from node 0, all queries together: the ``width`` nearest nodes met by each, nearest first, -1 where there are fewer."""
    rows = np.arange(len(queries))
    at = np.zeros(len(queries), dtype=np.int64)
    near = unit[at[:1]] @ queries.T
    near = near[0]
    for links in levels[:0:-1]:
        while True:
            around = links[at]
            sims = np.where(around >= 0, (unit[around] @ queries[:, :, None])[:, :, 0], -2)
            best = sims.argmax(1)
            better = sims[rows, best] > near
            if not better.any():
                break
            at, near = np.where(better, around[rows, best], at), np.where(better, sims[rows, best], near)
    n = len(unit)
    seen, mark = np.zeros((len(queries), n + 1), dtype=bool), np.zeros((len(queries), n + 1), dtype=np.int16)
    seen[:, -1], seen[rows, at] = True, True
    ids, sims = np.full((len(queries), width), -1, dtype=np.int64), np.full((len(queries), width), -2.0)
    ids[:, 0], sims[:, 0] = at, near
    ahead = ids >= 0
    while True:
        mine = np.flatnonzero(ahead.any(1))
        if not len(mine):
            return ids
        turn = ahead[mine] & (ahead[mine].cumsum(1) <= OPENED)
        ahead[mine] &= ~turn
        row, place = np.nonzero(turn)
        row = mine[row]
        around = levels[0][ids[row, place]]
        slot = ((turn.cumsum(1) - 1)[turn][:, None] * around.shape[1] + np.arange(around.shape[1])).astype(np.int16)
        who = np.repeat(row, around.shape[1])
        around, slot = around.ravel(), slot.ravel()
        fresh = ~seen[who, around]
        who, around, slot = who[fresh], around[fresh], slot[fresh]
        # A node that several opened ones link to counts once.
        mark[who, around] = slot
        once = mark[who, around] == slot
        who, around, slot = who[once], around[once], slot[once]
        seen[who, around] = True
        met = np.full((len(queries), OPENED * levels[0].shape[1]), -1, dtype=np.int64)
        close = np.full(met.shape, -2.0)
        met[who, slot], close[who, slot] = around, np.einsum("ij,ij->i", unit[around], queries[who])
        all_ids, all_sims, all_ahead = np.hstack([ids[mine], met[mine]]), np.hstack([sims[mine], close[mine]]), np.hstack([ahead[mine], met[mine] >= 0])
        order = (-all_sims).argsort(1, kind="stable")[:, :width]
        ids[mine], sims[mine], ahead[mine] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_sims, all_ahead))


def _index(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One shard's graph as a row of flat arrays; upper levels keep their own nodes only."""
    rows = rows.sort_by("rep")
    ids = rows.column("rep").to_numpy()
    vectors = np.stack([np.frombuffer(v.as_py(), dtype="<f8") for v in rows.column("vec")])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = build(unit)
    upper, sizes = [], []
    for level in links[1:]:
        nodes = np.flatnonzero((level >= 0).any(1)).astype(np.int32)
        sizes.append(len(nodes))
        upper += [nodes.tobytes(), level[nodes].tobytes()]
    out = {"dim": [int(key[0].as_py())], "shard": [int(key[1].as_py())], "ids": [ids.astype("<i8").tobytes()], "vectors": [vectors.tobytes()], "ground": [links[0].tobytes()], "sizes": [sizes], "upper": [b"".join(upper)]}
    return pa.table(out, schema=_INDEX)


_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("ground", pa.binary()), ("sizes", pa.list_(pa.int32())), ("upper", pa.binary())])


def _opened(row: dict) -> tuple:
    """A shard's ids, originals, their lengths, unit vectors and levels."""
    ids = np.frombuffer(row["ids"], dtype="<i8")
    vectors = np.frombuffer(row["vectors"], dtype="<f8").reshape(len(ids), -1)
    levels, at = [np.frombuffer(row["ground"], dtype=np.int32).reshape(len(ids), -1)], 0
    for k in row["sizes"]:
        level = np.full((len(ids), LINKS), -1, dtype=np.int32)
        nodes = np.frombuffer(row["upper"], dtype=np.int32, count=k, offset=at)
        level[nodes] = np.frombuffer(row["upper"], dtype=np.int32, count=k * LINKS, offset=at + 4 * k).reshape(k, LINKS)
        levels.append(level)
        at += 4 * k * (1 + LINKS)
    norms = np.linalg.norm(vectors, axis=1)
    return ids, vectors, norms, vectors / norms[:, None], levels


def _searched(k: int):
    """Rows of graphs, each followed by its queries: ``query_id``, ``rep`` and ``score`` of each query's ``k`` nearest in the graph, and one more, as the query itself may be among them."""
    schema = pa.schema([("query_id", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])

    def walked(graph: tuple, names: list[int], vectors: list[bytes]) -> pa.RecordBatch:
        ids, originals, norms, unit, levels = graph
        queries = np.frombuffer(b"".join(vectors), dtype="<f8").reshape(len(names), -1)
        lengths = np.linalg.norm(queries, axis=1)
        out: dict[str, list] = {f.name: [] for f in schema}
        for name, q, length, found in zip(names, queries, lengths, search(unit, levels, queries / lengths[:, None]), strict=True):
            found = found[found >= 0]
            scores = originals[found] @ q / (norms[found] * length)
            best = np.lexsort((ids[found], -scores))[: k + 1]
            out["query_id"] += [name] * len(best)
            out["rep"] += ids[found][best].tolist()
            out["score"] += scores[best].tolist()
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, names, vectors = None, [], []
        for batch in batches:
            for i, query_id in enumerate(batch.column("query_id").to_pylist()):
                if names and (query_id is None or len(names) == TOGETHER):
                    yield walked(graph, names, vectors)
                    names, vectors = [], []
                if query_id is None:
                    graph = _opened(batch.slice(i, 1).to_pylist()[0]["graph"])
                else:
                    names.append(query_id), vectors.append(batch.column("vec")[i].as_py())
        if names:
            yield walked(graph, names, vectors)

    return run


def nearest_neighbours(table: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` nearest rows of each row whose ``vec_id`` is divisible by ``every``: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = table.sparkSession
    importable(spark)

    def usable(batch: pa.RecordBatch) -> dict:
        ids, vecs, dims = [], [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
            if i is None or not v.is_valid or not len(v) or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
            if np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0:
                ids.append(i), vecs.append(x.tobytes()), dims.append(len(x))
        return {"vec_id": ids, "vec": vecs, "dim": dims}

    rows = staged(map_batches(table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), usable, "vec_id long, vec binary, dim int"), "vectors")
    reps = staged(rows.groupBy("dim", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct-vectors")
    sizes = reps.groupBy("dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = reps.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int").alias("shard"), "rep", "vec")
    graphs = staged(dealt.groupBy("dim", "shard").applyInArrow(_index, "dim int, shard int, ids binary, vectors binary, ground binary, sizes array<int>, upper binary"), "graphs")

    asked = rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-asked.count() // SERVED))
    whole = [c for c in graphs.columns if c not in ("dim", "shard")]
    of_graphs = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("binary").alias("vec"), F.struct(*whole).alias("graph"))
    of_queries = asked.join(sizes, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.col("vec_id").alias("query_id"), "vec")
    met = of_graphs.unionByName(of_queries, allowMissingColumns=True).repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", F.asc_nulls_first("query_id"))
    found = staged(_best(met.select("query_id", "vec", "graph").mapInArrow(_searched(k), "query_id long, rep long, score double"), "rep", k + 1).select("query_id", "rep", "score"), "found")
    unstage(graphs)
    several = reps.where("copies > 1").select("vec", "dim", F.col("rep").alias("_rep"))
    named = rows.join(several, ["dim", "vec"]).select(F.col("_rep"), "vec_id")
    # Each query can use k + 1 copies of a vector at most, those of least id.
    named = named.withColumn("place", F.row_number().over(W.Window.partitionBy("_rep").orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place")
    full = found.join(named, found["rep"] == named["_rep"], "left").select("query_id", F.coalesce("vec_id", "rep").alias("vec_id"), "score").where("vec_id <> query_id")
    return _best(full, "vec_id", k)


def _best(found: DataFrame, name: str, k: int) -> DataFrame:
    nearest = W.Window.partitionBy("query_id").orderBy(F.desc("score"), name)
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", name, "score")
