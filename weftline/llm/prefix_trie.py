"""Prefix trie of conversations by rolling fingerprints, verified turn by turn.

A turn's hash is the next coefficient of a polynomial modulo two primes, so the fingerprint
of each prefix comes from a scan: numpy scans runs of turns where they lie, and what a run
starts with is carried over from the runs before it, so that a conversation of any length is
spread over many tasks. Fingerprints also shift: the first turns of a conversation are
exchanged for another's without reading a text again.

Prefixes of equal depth and fingerprint form a candidate group. Each member's last turn is
compared with that of the group's representative, the member of least ``conv_id``. As equal
fingerprints and equal last turns make equal parents, groups that hold at every depth are
the nodes. A turn that differs from its representative gets another hash, which moves all
of its conversation's later prefixes with it, and the groups are formed and verified anew.

Totals of subtrees need no walk by levels: every node belongs to its least member, whose nodes
form one path. A conversation's own nodes are summed up from the deep end, and their total is
rolled up to each of the prefixes that belong to others.

Turns are in the order of ``turn``, null first; equal ones by role, the first 32
characters of the text, and its hash. Null roles and texts count as empty. Rows without a
``conv_id`` belong to no conversation. Repeated rows are turns of their own. An empty table has no
node, not even a root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, map_batches, staged, unstage

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_103_515_245, 1_220_703_125)
INVERSES = tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True))
#: Depths that are summed up together before their sums are.
CHUNK = 4096

KEY = ("depth", "f1", "f2")
TURNS = "part int, conv_id long, k long, role string, text string, words long, h1 long, h2 long, g1 long, g2 long"


def turn_hash(role: bytes, text: bytes, salt: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(b"%d:%b%b" % (len(role), role, text), seed=salt)


def powers(base: int, prime: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each of the powers, modulo the prime."""
    out, square, left = np.ones(len(exponents), dtype=np.int64), base, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        left, square = left >> 1, square * square % prime
    return out


def scanned(h: np.ndarray, first: np.ndarray, which: int) -> np.ndarray:
    """Fingerprints of the prefixes of runs of hashes; ``first`` gives for each hash the place where its run starts."""
    p, at = PRIMES[which], np.arange(len(h))
    ahead = np.concatenate([[0], np.cumsum(h * powers(INVERSES[which], p, at) % p)])
    return (ahead[1:] - ahead[first]) % p * powers(BASES[which], p, at) % p


def _word_counts(texts: pa.Array) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, which may not be null."""
    texts = texts.cast(pa.binary())
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[starts[0] : starts[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    starts = starts - starts[0]
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    heads = starts[:-1][starts[:-1] < starts[1:]]
    opens[heads] = word[heads]
    return np.diff(np.concatenate([[0], np.cumsum(opens)])[starts])


def fingerprinted(conversations: DataFrame, hashed: Callable[[bytes, bytes], int] = turn_hash) -> DataFrame:
    """Turns in order, by parts: place ``k`` within the conversation's run in the part, hashes, and fingerprints of the run's prefixes."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows that are equal in all but the last may lie in either order.
    rows = rows.withColumns({"head": F.substring("text", 1, 32), "tie": F.xxhash64("text"), "origin": F.spark_partition_id()})
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "head", "tie", "origin"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    importable(conversations.sparkSession)
    names = [f.split()[0] for f in TURNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, k0, ends = TaskContext.get().partitionId(), None, 0, (0, 0)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("conv_id").to_numpy()
            pairs = zip(b.column("role").cast(pa.binary()).to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True)
            h = np.fromiter((hashed(r, t) for r, t in pairs), dtype=np.uint64, count=len(ids))
            hs = [(x % np.uint64(p)).astype(np.int64) for x, p in zip((h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)), PRIMES, strict=True)]
            at = np.arange(len(ids))
            first = np.maximum.accumulate(np.where(np.concatenate([[True], ids[1:] != ids[:-1]]), at, 0))
            k = at - first + 1
            gs = [scanned(x, first, i) for i, x in enumerate(hs)]
            if ids[0] == last:  # the run goes on
                mine = first == 0
                gs = [np.where(mine, (e * powers(BASES[i], p, k) + g) % p, g) for i, (g, e, p) in enumerate(zip(gs, ends, PRIMES, strict=True))]
                k = np.where(mine, k + k0, k)
            last, k0, ends = ids[-1], int(k[-1]), tuple(int(g[-1]) for g in gs)
            columns = [np.full(len(ids), part, dtype=np.int32), ids, k, b.column("role"), b.column("text"), _word_counts(b.column("text")), *hs, *gs]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return rows.mapInArrow(run, TURNS)


def _carried(group: pd.DataFrame) -> pd.DataFrame:
    """Turns and fingerprints before each run of one conversation; a row for each part that it reaches into."""
    k, c, rows = 0, [0, 0], []
    for r in group.sort_values("part").itertuples():
        rows.append((r.part, r.conv_id, k, *c))
        k, c = k + r.n, [(x * pow(b, int(r.n), p) + g) % p for x, b, p, g in zip(c, BASES, PRIMES, (r.e1, r.e2), strict=True)]
    return pd.DataFrame(rows, columns=["part", "conv_id", "k0", "c1", "c2"])


def placed(turns: DataFrame) -> DataFrame:
    """The turns with their place ``i`` in the whole conversation, and the fingerprints ``f1``, ``f2`` of the prefixes that end with them; without texts."""
    importable(turns.sparkSession)
    runs = turns.groupBy("conv_id", "part").agg(F.max("k").alias("n"), F.max_by(F.struct("g1", "g2"), "k").alias("g")).select("conv_id", "part", "n", F.col("g.g1").alias("e1"), F.col("g.g2").alias("e2"))
    split = runs.groupBy("conv_id").count().where("count > 1").select("conv_id")
    # At most one conversation reaches into a part from before, so this has as many rows as there are parts.
    carry = F.broadcast(runs.join(split, "conv_id").groupBy("conv_id").applyInPandas(_carried, "part int, conv_id long, k0 long, c1 long, c2 long").where("k0 > 0"))
    rows = turns.join(carry, ["part", "conv_id"], "left").select("conv_id", "k", "words", "h1", "h2", "g1", "g2", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("k0", "c1", "c2")))

    def each(b: pa.RecordBatch) -> dict:
        k, k0 = (b.column(c).to_numpy() for c in ("k", "k0"))
        out = {c: b.column(c) for c in ("conv_id", "words", "h1", "h2")} | {"i": k + k0}
        for which, p in enumerate(PRIMES):
            c, g = (b.column(f"{x}{which + 1}").to_numpy() for x in "cg")
            out[f"f{which + 1}"] = (c * powers(BASES[which], p, np.where(k0 > 0, k, 0)) + g) % p
        return out

    return map_batches(rows, each, "conv_id long, i long, words long, h1 long, h2 long, f1 long, f2 long")


def with_own_turns(turns: DataFrame) -> DataFrame:
    """Members of :func:`placed` turns as they are: one row for each prefix of each conversation, the empty one included."""
    rows = placed(turns)
    length = rows.groupBy("conv_id").agg(F.max("i").alias("length"))
    own = rows.join(length, "conv_id").select("conv_id", F.col("i").alias("depth"), "f1", "f2", "h1", "h2", "words", F.col("conv_id").alias("source"), F.col("i").alias("place"), (F.col("i") == F.col("length")).alias("last"))
    return own.unionByName(_roots(length))


def _roots(convs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return convs.select("conv_id", *(zero.alias(c) for c in ("depth", "f1", "f2", "h1", "h2", "words")), F.col("conv_id").alias("source"), zero.alias("place"), (F.col("length") == 0).alias("last"))


def with_shared_heads(turns: DataFrame, span: int = 20, most: int = 4) -> DataFrame:
    """Members when conversation c starts with the first h turns of conversation ``c - c % span``, h being the CRC-32 of c modulo ``most``, and goes on with its own turns after the first h.

    Fingerprints of own turns are shifted from the old start to the new one, so texts aren't read again.
    """
    rows = staged(placed(turns), "trie-places")
    heads = [F.max(F.when(F.col("i") == j, F.struct("f1", "f2", "h1", "h2", "words"))).alias(f"t{j}") for j in range(1, most)]
    convs = staged(rows.groupBy("conv_id").agg(F.max("i").alias("n"), *heads), "trie-heads")
    hosts = convs.select(F.col("conv_id").alias("host"), F.col("n").alias("host_n"), *(F.col(f"t{j}").alias(f"s{j}") for j in range(1, most)))
    convs = convs.withColumns({"host": F.col("conv_id") - F.col("conv_id") % span, "h": F.crc32(F.col("conv_id").cast("string")) % most}).join(hosts, "host", "left")
    convs = convs.withColumn("kept", F.least("h", F.coalesce("host_n", F.lit(0)))).withColumn("length", F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    at = lambda prefix, j, f: F.coalesce(*(F.when(j == x, F.col(f"{prefix}{x}.{f}")) for x in range(1, most)), F.lit(0).cast("long"))
    shifts = convs.select("conv_id", "h", "kept", "length", *(F.pmod(at("s", F.col("kept"), f) - at("t", F.col("h"), f), F.lit(p)).alias(f"a{f[1]}") for f, p in zip(("f1", "f2"), PRIMES, strict=True)))
    own = rows.where(F.col("i") > F.crc32(F.col("conv_id").cast("string")) % most).join(shifts, "conv_id")

    def each(b: pa.RecordBatch) -> dict:
        i, h, kept, length = (b.column(c).to_numpy() for c in ("i", "h", "kept", "length"))
        out = {c: b.column(c) for c in ("conv_id", "h1", "h2", "words")} | {"depth": kept + i - h, "source": b.column("conv_id"), "place": i, "last": kept + i - h == length}
        for which, p in enumerate(PRIMES):
            f, a = (b.column(f"{x}{which + 1}").to_numpy() for x in "fa")
            out[f"f{which + 1}"] = (f + a * powers(BASES[which], p, i - h)) % p
        return out

    own = map_batches(own, each, "conv_id long, depth long, f1 long, f2 long, h1 long, h2 long, words long, source long, place long, last boolean")
    turn = F.explode(F.array(*(F.struct(F.lit(j).cast("long").alias("j"), F.col(f"s{j}").alias("t")) for j in range(1, most)))).alias("x")
    head = convs.select("conv_id", "host", "kept", "length", turn).where("x.j <= kept")
    head = head.select("conv_id", F.col("x.j").alias("depth"), *(F.col(f"x.t.{c}").alias(c) for c in ("f1", "f2", "h1", "h2", "words")), F.col("host").alias("source"), F.col("x.j").alias("place"), (F.col("x.j") == F.col("length")).alias("last"))
    return own.unionByName(head).unionByName(_roots(convs.select("conv_id", "length")))


def differing(members: DataFrame, turns: DataFrame, salt: int) -> DataFrame:
    """Members whose last turn is another than their representative's: conversation, depth, and what the hash of the turn under the new salt adds to the fingerprint there."""
    starts = turns.groupBy("conv_id", "part").agg(F.max("k").alias("n")).withColumn("k0", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    origin = F.struct("source", "place")
    # Only groups of several source turns can differ, and each source turn is compared once.
    sources = members.where("depth > 0").groupBy(*KEY, "source", "place").agg(F.min("conv_id").alias("least"))
    groups = sources.groupBy(*KEY).agg(F.min_by(origin, "least").alias("chosen"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    asked = sources.drop("least").join(groups, list(KEY)).where(origin != F.col("chosen"))
    later = F.broadcast(starts.where("k0 > 0").select("part", "conv_id", "k0"))
    texts = turns.join(later, ["part", "conv_id"], "left").select("conv_id", (F.col("k") + F.coalesce("k0", F.lit(0))).alias("i"), "role", "text")
    theirs = texts.select(F.col("conv_id").alias("r_conv"), F.col("i").alias("r_i"), F.col("role").alias("r_role"), F.col("text").alias("r_text"))
    met = asked.join(texts, (F.col("source") == F.col("conv_id")) & (F.col("place") == F.col("i"))).select(*KEY, "source", "place", "chosen", "role", "text")
    met = met.join(theirs, (F.col("chosen.source") == F.col("r_conv")) & (F.col("chosen.place") == F.col("r_i"))).where((F.col("role") != F.col("r_role")) | (F.col("text") != F.col("r_text")))

    def each(b: pa.RecordBatch) -> dict:
        pairs = zip(b.column("role").cast(pa.binary()).to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True)
        h = np.fromiter((turn_hash(r, t, salt) for r, t in pairs), dtype=np.uint64, count=b.num_rows)
        return {c: b.column(c) for c in (*KEY, "source", "place")} | {"n1": (h & np.uint64(0xFFFFFFFF)) % np.uint64(PRIMES[0]), "n2": (h >> np.uint64(32)) % np.uint64(PRIMES[1])}

    return map_batches(met.select(*KEY, "source", "place", "role", "text"), each, "depth long, f1 long, f2 long, source long, place long, n1 long, n2 long")


def verified(members: DataFrame, turns: DataFrame) -> DataFrame:
    """The members, their fingerprints changed until every group's last turns are equal."""
    salt = 1
    while True:
        apart = staged(differing(members, turns, salt), "trie-apart")
        if apart.isEmpty():
            unstage(apart)
            return members
        # The first such turn of a conversation; later ones are met in the next round.
        hit = members.join(apart, [*KEY, "source", "place"]).groupBy("conv_id").agg(F.min_by(F.struct("depth", "n1", "n2", "h1", "h2"), "depth").alias("x"))
        hit = hit.select("conv_id", F.col("x.depth").alias("d"), *(F.col(f"x.{c}").alias(f"x_{c}") for c in ("n1", "n2", "h1", "h2")))

        def each(b: pa.RecordBatch) -> dict:
            depth, d = (b.column(c).to_numpy() for c in ("depth", "d"))
            out = {c: b.column(c) for c in ("conv_id", "depth", "words", "source", "place", "last")}
            for which, p in enumerate(PRIMES, start=1):
                f, h, n, x = (b.column(f"{c}{which}").to_numpy() for c in ("f", "h", "x_n", "x_h"))
                added = (n - x) % p * powers(BASES[which - 1], p, np.where(d > 0, np.maximum(depth - d, 0), 0)) % p
                out |= {f"f{which}": np.where((d > 0) & (depth >= d), (f + added) % p, f), f"h{which}": np.where((d > 0) & (depth == d), n, h)}
            return out

        nothing = F.lit(0).cast("long")
        changed = members.join(hit, "conv_id", "left").na.fill(0, ["d", "x_n1", "x_n2", "x_h1", "x_h2"])
        changed = map_batches(changed.withColumn("d", F.coalesce("d", nothing)), each, "conv_id long, depth long, f1 long, f2 long, h1 long, h2 long, words long, source long, place long, last boolean")
        old, members, salt = members, staged(changed, "trie-members"), salt + 1
        unstage(old, apart)


def _ends(members: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at each node.

    A digest is taken over all of them in order, so one task reads a node's ids from first to last, as
    texts of the ids of a range of conversations, and holds one such text at a time.
    """
    spark = members.sparkSession
    ranged = members.where("last").select("conv_id", *KEY).repartitionByRange("conv_id").withColumn("range", F.spark_partition_id())
    runs = staged(ranged.groupBy(*KEY, "range").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")), "trie-ends")
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            out = []
            for *key, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if key == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            yield _batch(out)
        yield _batch([(*node, digest.hexdigest())] if node else [])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)], names=[*KEY, "ends_sha256"])

    return runs.repartition(*KEY).sortWithinPartitions(*KEY, "range").mapInArrow(run, "depth long, f1 long, f2 long, ends_sha256 string")


def _suffix_sums(nodes: DataFrame) -> DataFrame:
    """``own_saved``: each node's and all deeper ones' of the same least member; chunks of depths are summed first, so a long path is no single task's."""
    chunked = nodes.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    sums = chunked.groupBy("conv_id", "chunk").agg(F.sum("saved").alias("s"))
    deeper = sums.withColumn("deeper", F.sum("s").over(Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1))).where("deeper > 0").drop("s")
    within = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth"))
    return chunked.join(deeper, ["conv_id", "chunk"], "left").withColumn("own_saved", F.sum("saved").over(within) + F.coalesce("deeper", F.lit(0))).drop("chunk", "deeper")


def trie_nodes(members: DataFrame) -> DataFrame:
    """One row per node of the trie of verified members."""
    up = lambda h, which: F.pmod((F.pmod(F.col(f"f{which}") - h, F.lit(PRIMES[which - 1]))) * INVERSES[which - 1], F.lit(PRIMES[which - 1]))
    least = members.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    nodes = staged(least.select(*KEY, "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), up(F.col("h1"), 1).alias("p1"), up(F.col("h2"), 2).alias("p2")), "trie-nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")]
    children = nodes.where("depth > 0").select(*parent).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = _suffix_sums(nodes.join(children, list(KEY), "left").na.fill(0, ["n_children"]))
    nodes = staged(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-counted")
    totals = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.max("leaf").alias("leaf"), F.min("depth").alias("from")).where("saved > 0 or leaf > 0")
    rolled = members.select("conv_id", *KEY).join(totals, "conv_id").where(F.col("depth") < F.col("from")).groupBy(*KEY).agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    # A path ends in a leaf or not; its nodes all lie above its end.
    ends_in_leaf = totals.select("conv_id", F.col("leaf").alias("own_leaf"))
    above = nodes.select(*(F.col(c).alias(f"up_{c}") for c in KEY), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(rolled, list(KEY), "left").join(ends_in_leaf, "conv_id", "left").join(_ends(members), list(KEY), "left")
    out = out.join(above, (F.col("depth") - 1 == F.col("up_depth")) & (F.col("p1") == F.col("up_f1")) & (F.col("p2") == F.col("up_f2")), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (number("own_leaf") + number("more_leaves")).alias("n_leaves"), (F.col("own_saved") + number("more_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, members_of: Callable[[DataFrame], DataFrame] = with_own_turns, hashed: Callable[[bytes, bytes], int] = turn_hash) -> DataFrame:
    """Nodes of the prefix trie: the least member, depth, parent, members, children, leaves, saved tokens, and a digest of those that end there.

    ``members_of`` may rebuild conversations, as :func:`with_shared_heads` does.
    """
    turns = staged(fingerprinted(conversations, hashed), "trie-turns")
    members = staged(members_of(turns), "trie-members")
    members = verified(members, turns)
    out = trie_nodes(members)
    unstage(turns)
    return out
