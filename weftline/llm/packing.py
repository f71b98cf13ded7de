"""Packing of token streams with a controlled mixture of sources.

Each source is a queue with a target share of every window of ``WINDOW`` tokens: the share
given in ``targets``, else its part of what those leave, by its tokens; without targets
that is the corpus's own mixture. When a queue ends, its share goes to the others in
proportion to theirs. So the tokens that a queue has given by any place of the packed
stream follow from the queues' totals alone, and a document's place in its queue says
which blocks of ``BLOCK`` tokens it falls into, wherever it lies in the table.

A block is packed by one task: deficit round-robin fills its windows, each opening with
what the queues were owed or overdrawn at the end of the block before. Windows are cut into
sequences, documents wherever a window, sequence or block ends; only the very last sequence
can be short.

Sources with less than one in ``MOST_QUEUES`` of all tokens, unless named in ``targets``,
form one queue together, whose windows hold them in no fixed proportion.

Null texts count as empty; each document has an end token at least. Null sources are one
source. Very long texts are cut over as many blocks as they need. Rows that repeat an id are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .bpe import bpe
from .common import importable, map_batches, slices, staged

SEQUENCE, WINDOW = 1024, 32 * 1024
BLOCK, MOST_QUEUES = 64 * WINDOW, 1000
#: Rows, of some 50 bytes, that are broadcast.
MOST_STARTS = 100_000
#: Bytes of text that are encoded at once: their new words and tables of parts take some ten times as much.
ENCODE_BYTES = 2 << 20
#: The end token.
END = np.uint32(0)

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ENCODED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def queue_key(source: str | None) -> str:
    return "none" if source is None else f"source {source}"


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``source`` (as a key, never null), ``part`` (the task), ``at`` (tokens of the source before it in the part), ``n`` (tokens with the end) and ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, past = bpe(vocabulary), TaskContext.get().partitionId(), Counter()
        for b in (piece for whole in batches for piece in slices(whole, ENCODE_BYTES)):
            flat, ends = coder.encode_column(b.column("text"))
            ids = [np.append(flat[a:z], END) for a, z in zip([0, *ends], ends, strict=False)]
            sources, places = [queue_key(s) for s in b.column("source").to_pylist()], []
            for s, x in zip(sources, ids, strict=True):
                places.append(past[s])
                past[s] += len(x)
            columns = (b.column("doc_id"), sources, [part] * len(ids), places, [len(x) for x in ids], [_small(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, ENCODED, strict=True)], schema=ENCODED)

    importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, part long, at long, n long, ids binary")


def _small(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, marked by a first byte; else four."""
    return b"\x02" + ids.astype("<u2").tobytes() if int(ids.max()) < 1 << 16 else b"\x04" + ids.tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype("<u4")


class Mixture:
    """What each queue has given by any place of the packed stream. Queues run at their shares until they end."""

    def __init__(self, tokens: list[int], shares: list[float]):
        self.n, self.p = np.array(tokens, dtype=np.float64), np.array(shares, dtype=np.float64)
        self.total = int(sum(tokens))
        self.blocks = -(-self.total // BLOCK)
        ends = self.n / self.p
        #: Times at which queues end, and the places of the stream by then.
        self.times = np.unique(np.append(0.0, ends))
        self.places = np.minimum(self.n, self.p * self.times[:, None]).sum(1)
        #: Queues that end last, the largest first, take what rounding leaves.
        self.order = np.lexsort((-self.n, -ends))

    def owed(self, blocks: np.ndarray) -> np.ndarray:
        """Tokens, with fractions, of each queue (columns) that belong before each block (rows)."""
        time = np.interp(blocks * float(BLOCK), self.places, self.times)
        return np.minimum(self.n, self.p * time[:, None])

    def given(self, blocks: np.ndarray) -> np.ndarray:
        """Whole tokens of each queue before each block; they add up to the block's place."""
        out = np.floor(self.owed(blocks)).astype(np.int64)
        out[blocks >= self.blocks] = self.n
        left = np.minimum(blocks * BLOCK, self.total) - out.sum(1)
        for s in self.order:
            more = np.minimum(left, self.n[s].astype(np.int64) - out[:, s])
            out[:, s] += more
            left = left - more
            if not left.any():
                break
        return out

    def block_of(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The block that holds each place of a queue."""
        time = place / self.p[queue]
        block = (np.interp(time, self.times, self.places) // BLOCK).astype(np.int64).clip(0, self.blocks - 1)
        while True:
            near, row = np.unique(np.concatenate([block, block + 1]), return_inverse=True)
            table = self.given(near)
            low, high = table[row[: len(block)], queue], table[row[len(block) :], queue]
            if not ((early := low > place) | (late := high <= place)).any():
                return block
            block = block - early + late


def mixture(totals: Mapping[str, int], targets: Mapping[str | None, float] | None) -> tuple[dict[str, int], Mixture]:
    """Number of each queue by its sources' key, and the mixture. ``totals`` holds the large or named sources, and the rest under the empty key."""
    named = {queue_key(s): float(x) for s, x in (targets or {}).items() if totals.get(queue_key(s))}
    others = sum(n for k, n in totals.items() if k not in named)
    free = 1.0 - sum(named.values())
    if any(x <= 0 for x in named.values()) or (others and free <= 1e-9):
        raise ValueError("targets must be positive, and leave a share to the sources they don't name")
    keys = [k for k in sorted(totals) if totals[k]]
    shares = [named[k] if k in named else free * totals[k] / others for k in keys]
    return {k: i for i, k in enumerate(keys)}, Mixture([totals[k] for k in keys], [x / sum(shares) for x in shares])


def served(waiting: dict, deficits: dict, shares: dict, room: int) -> list[tuple[str, int]]:
    """One window by deficit round-robin: (source, tokens) in order. Updates ``waiting`` and ``deficits``.

    Each source with tokens waiting gets what it is owed, in whole tokens; what then is
    free goes round the sources still waiting in proportion to their shares.
    """
    out: dict = {}

    def take(s: str, most: int) -> None:
        nonlocal room
        if (k := min(most, waiting[s], room)) > 0:
            out[s] = out.get(s, 0) + k
            waiting[s] -= k
            deficits[s] -= k
            room -= k

    quantum = room
    for s in deficits:
        deficits[s] += shares[s] * quantum
    for s in sorted(deficits, key=lambda s: -deficits[s]):
        take(s, int(deficits[s]))
    while room and (live := [s for s in deficits if waiting[s]]):
        whole, free = sum(shares[s] for s in live), room
        for s in sorted(live, key=lambda s: -deficits[s]):
            take(s, max(1, int(free * shares[s] / whole)))
    return list(out.items())


def _cut(mix: Mixture):
    """Documents to the pieces of them that fall into each block."""

    def each(batch: pa.RecordBatch) -> dict:
        queue, place, n = (batch.column(c).to_numpy() for c in ("queue", "place", "n"))
        first, last = mix.block_of(queue, place), mix.block_of(queue, place + n - 1)
        row = np.repeat(np.arange(len(n)), last - first + 1)
        block = first[row] + np.arange(len(row)) - np.searchsorted(row, row)
        edges, at = np.unique(np.concatenate([block, block + 1]), return_inverse=True)
        table = mix.given(edges)
        start = np.maximum(table[at[: len(row)], queue[row]] - place[row], 0)
        end = np.minimum(table[at[len(row) :], queue[row]] - place[row], n[row])
        data = [x.as_buffer() for x in batch.column("ids")]
        pieces = []
        for r, a, z in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
            width = memoryview(data[r])[0]
            pieces.append(bytes([width]) + memoryview(data[r])[1 + width * a : 1 + width * z].tobytes())
        return {"block": block, "queue": queue[row], "place": place[row] + start, "doc_id": batch.column("doc_id").take(pa.array(row)), "start": start, "n": end - start, "doc_tokens": n[row], "ids": pieces}

    return each


def _packing(mix: Mixture):
    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """All pieces of one block."""
        rows = rows.sort_by([("queue", "ascending"), ("place", "ascending")])
        docs, starts, counts, wholes, ids = (rows.column(c).to_pylist() for c in ("doc_id", "start", "n", "doc_tokens", "ids"))
        queues: dict[int, list[int]] = {}
        for i, s in enumerate(rows.column("queue").to_pylist()):
            queues.setdefault(s, []).append(i)
        block = np.array([key[0].as_py()])
        owed = (mix.owed(block) - mix.given(block))[0]
        deficits, shares = {s: float(owed[s]) for s in queues}, {s: float(mix.p[s]) for s in queues}
        waiting = {s: sum(counts[i] for i in queues[s]) for s in queues}
        heads, at = dict.fromkeys(queues, 0), dict.fromkeys(queues, 0)
        opened: dict[int, np.ndarray] = {}
        out: dict[str, list] = {f.split()[0]: [] for f in PIECES.split(", ")}
        total, sequence, offset = sum(counts), int(block[0]) * (BLOCK // SEQUENCE), 0
        while total:
            room = min(WINDOW, total)
            total -= room
            for s, k in served(waiting, deficits, shares, room):
                while k:
                    i = queues[s][heads[s]]
                    if i not in opened:
                        opened[i] = _wide(ids[i])
                    n = min(k, counts[i] - at[s], SEQUENCE - offset)
                    piece = opened[i][at[s] : at[s] + n]
                    for name, value in zip(out, (docs[i], starts[i] + at[s], n, zlib.crc32(piece.tobytes()), wholes[i], sequence, offset), strict=True):
                        out[name].append(value)
                    k, at[s], offset = k - n, at[s] + n, offset + n
                    if at[s] == counts[i]:
                        heads[s], at[s] = heads[s] + 1, 0
                        del opened[i]
                    if offset == SEQUENCE:
                        sequence, offset = sequence + 1, 0
        return pa.table({k: pa.array(v, type=pa.int64()) for k, v in out.items()})

    return pack


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", targets: Mapping[str | None, float] | None = None) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``targets`` gives sources their shares of each window; shares of sources that don't occur are void.
    """
    spark = docs.sparkSession
    rows = staged(encoded(docs, vocabulary), "encoded")
    counts = staged(rows.groupBy("source", "part").agg(F.sum("n").alias("n")), "token-counts")
    sources = counts.groupBy("source").agg(F.sum("n").alias("n"))
    total = sources.agg(F.sum("n")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], PIECES)
    names = [queue_key(s) for s in targets or {}]
    # No more than MOST_QUEUES sources can be this large.
    large = {r["source"]: r["n"] for r in sources.where((F.col("n") * MOST_QUEUES >= total) | F.col("source").isin(names)).collect()}
    queues, mix = mixture(large | {"": total - sum(large.values())}, targets)
    # As a literal: a list given to createDataFrame starts Python workers of another kind, beside those that executors hold.
    named = [{"source": k, "queue": i} for k, i in queues.items()]
    numbers = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(named)), "array<struct<source:string,queue:int>>")))
    in_queue = W.Window.partitionBy("queue").orderBy("part", "source").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.join(F.broadcast(numbers), "source", "left").fillna({"queue": queues.get("", -1)})
    starts = starts.select("source", "part", "queue", F.coalesce(F.sum("n").over(in_queue), F.lit(0)).alias("past"))
    # One row for each task and source: few enough, they go to the documents, else both meet by a shuffle.
    starts = F.broadcast(starts) if counts.count() <= MOST_STARTS else starts
    placed = rows.join(starts, ["source", "part"]).select("doc_id", "queue", (F.col("past") + F.col("at")).alias("place"), "n", "ids")
    pieces = map_batches(placed, _cut(mix), "block long, queue int, place long, doc_id long, start long, n long, doc_tokens long, ids binary", keeps="bpe")
    return pieces.groupBy("block").applyInArrow(_packing(mix), PIECES)
