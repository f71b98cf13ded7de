"""Near-duplicate documents by bottom-k sketches.

One hash function numbers the word shingles of each text; a sketch is the k least
numbers of its set. Documents with equal sets form one class. Inverted lists from
retained value to classes give the pairs to look at; the sketch of the union estimates
their similarity; the rest is settled by exact Jaccard on full sets.

How pairs stay few without losing a link:

* Values are ordered from rare to common. Two linked sets share at least ``overlap()`` of
  their ``SKETCH`` retained values (each of the union's least k is shared with
  the probability of their similarity), so
  they share one among the ``SKETCH - overlap() + 1`` rarest of each; the others get no list. ``overlap()`` leaves
  out a linked pair in some ten million; sets of ``SKETCH`` values or fewer are their own sketch, and exact.
* Short lists give all their pairs, at most ``SHORT`` for a member.
* Long lists compare all members with a few pivots, central ones among them, and links are merged to components.
  Pairs inside one component need no look.
* What is still apart in a long list is looked up by the exact prefix filter on full
  sets: of n shingles, the rarest n - ceil(0.85 n) + 1, where what is left after a shared
  value must suffice. No list or partner is capped.

Very long texts are whole sets, held one pair at a time. Null and empty texts have no shingles and link with nothing. Rows of a null id get a
null component and are kept. Rows that repeat an id are one node with all their texts.
Ties go to the smaller id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import MOST_SENT, map_batches, shingle_hashes, staged, unstage, word_hashes, words_of
from .components import components

SKETCH, SHORT, PIVOTS = 48, 16, 6


def overlap(percent: int) -> int:
    """Retained values that two linked sets share, but for one pair in about ten million: 6.8 standard deviations below what is expected."""
    p = percent / 100
    return int(SKETCH * p - 6.8 * math.sqrt(SKETCH * p * (1 - p)))


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, a digest of the set and its bottom-k sketch."""

    def each(batch: pa.RecordBatch) -> dict:
        sets = [shingle_hashes(word_hashes(words_of(t.as_py())), width) for t in batch.column("text")]
        return {
            "doc_id": batch.column("doc_id"),
            "n_shingles": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            "sketch": [s[:SKETCH].tobytes() for s in sets],
        }

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, n_shingles long, digest binary, sketch binary")


def _values(classes: DataFrame, column: str) -> DataFrame:
    """A row for each value of each class: ``id``, ``n``, ``value``."""

    def each(batch: pa.RecordBatch) -> dict:
        sets = [np.frombuffer(s.as_buffer(), dtype=np.int64) for s in batch.column(column)]
        sizes = [len(s) for s in sets]
        return {"id": np.repeat(batch.column("id").to_numpy(), sizes), "n": np.repeat(batch.column("n").to_numpy(), sizes), "value": np.concatenate(sets)}

    return map_batches(classes.select("id", "n", column), each, "id long, n long, value long")


def _lists(values: DataFrame, retained: F.Column, prefix: F.Column) -> DataFrame:
    """``value``, ``id``, ``n``, ``rank`` (from rare to common) of the values among each class's ``prefix`` rarest; values of one class only get no list."""
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    mine = W.Window.partitionBy("id", "n")
    ranked = (
        values.join(common, "value")
        .withColumn("rank", F.row_number().over(mine.orderBy("df", "value")) + retained - F.count("*").over(mine))
        .where(F.col("rank") <= prefix)
    )
    return ranked.select("value", "id", "n", "rank")


def _alike_sizes(percent: int) -> F.Column:
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).where("a <> b").distinct()


def _short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    other = lists.select("value", F.col("id").alias("other"), F.col("n").alias("m"))
    return lists.join(other, "value").where(F.col("id") < F.col("other")).where(_alike_sizes(percent)).select("id", "other")


def _pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Every row of ``lists`` against ``PIVOTS`` of the same list.

    Half of them are the most central, with the fewest rarer values; the others are any.
    The same hashes choose them in all lists, so lists alike choose alike.
    """
    central = lambda i: F.col("rank") if i % 2 == 0 else F.lit(0)
    choices = [F.min(F.struct(central(i).alias("r"), F.xxhash64("id", F.lit(i)).alias("h"), F.col("id").alias("other"), F.col("n").alias("m"))).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = lists.groupBy("value").agg(*choices).select("value", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"p{i}.other"), F.col(f"p{i}.m")) for i in range(PIVOTS))))).alias("p")).select("value", "p.*")
    return lists.join(pivots, "value").where(F.col("id") != F.col("other")).where(_alike_sizes(percent)).select("id", "other")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs ``a``, ``b``: those whose sets are alike enough. The first ``SKETCH`` values of a sorted set are its sketch: the estimate from both sketches comes first, exact Jaccard settles what it lets through."""
    shared = overlap(percent)

    def alike(s: np.ndarray, t: np.ndarray) -> bool:
        union, times = np.unique(np.concatenate([s[:SKETCH], t[:SKETCH]]), return_counts=True)
        if (len(s) > SKETCH or len(t) > SKETCH) and int((times[:SKETCH] == 2).sum()) < shared:
            return False
        both = len(np.intersect1d(s, t, assume_unique=True))
        return 100 * both >= percent * (len(s) + len(t) - both)

    def each(batch: pa.RecordBatch) -> dict:
        keep = pa.array([alike(np.frombuffer(s.as_buffer(), dtype=np.uint64), np.frombuffer(t.as_buffer(), dtype=np.uint64)) for s, t in zip(batch.column("s"), batch.column("t"), strict=True)], type=pa.bool_())
        return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    return map_batches(pairs.join(left, "a").join(right, "b"), each, "a long, b long")


def _labelled(lists: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists that hold more than one component, with each member's ``label``; and of these the members outside the list's main component."""
    roots = components(links).select(F.col("node").alias("id"), "root")
    labels = lists.join(roots, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    by_label = labels.groupBy("value", "label").agg(F.count("*").alias("size"))
    main = by_label.groupBy("value").agg(F.max(F.struct("size", "label")).getField("label").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    apart = labels.join(main.drop("parts"), "value")
    apart = staged(apart, "apart")
    return apart, apart.where("label <> main")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` (it is the least of its component).

    Documents link where 100 * intersection >= percent * union of their shingle sets.
    The sketch sizes hold for ``percent`` of 80 or more.
    """
    sketches = staged(sketched(docs, width), "sketches")
    some = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("c")).select("digest", F.col("c.doc_id").alias("id"), F.col("c.n_shingles").alias("n"), F.col("c.sketch").alias("sketch"))
    classes = staged(classes, "classes")

    # A document may stand for several classes (rows that repeat an id): its lists are then those of all of them.
    retained = F.least(F.col("n"), F.lit(SKETCH))
    need = F.least(F.ceil(F.col("n") * percent / 100), F.lit(overlap(percent)))
    lists = _lists(_values(classes, "sketch"), retained, retained - need + 1)
    sizes = lists.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    lists = staged(lists.join(sizes, "value"), "lists")
    short, long = lists.where(F.col("size") <= SHORT), lists.where(F.col("size") > SHORT).drop("size")

    def shingled(batch: pa.RecordBatch) -> dict:
        sets = [shingle_hashes(word_hashes(words_of(t.as_py())), width) for t in batch.column("text")]
        return {"id": batch.column("doc_id"), "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    wanted = lists.select(F.col("id").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    sets = staged(map_batches(texts, shingled, "id long, n long, shingles binary"), "sets")
    verified = lambda pairs, name: staged(_verified(_ordered(pairs), sets, percent), name)

    links = verified(_short_pairs(short, percent).unionAll(_pivot_pairs(long, percent)), "links")
    apart, outside = _labelled(long, links)
    rest = sets.join(apart.select("id", "label").distinct(), "id")
    full = _lists(_values(rest.select("id", "n", "shingles"), "shingles"), F.col("n"), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    full = staged(full.join(apart.select("id", "label").distinct(), "id"), "full-lists")
    seekers = full.join(outside.select("id").distinct(), "id", "left_semi")
    found = full.select("value", F.col("id").alias("other"), F.col("n").alias("m"), F.col("label").alias("other_label"), F.col("rank").alias("other_rank"))
    # The rarest value that two sets share leaves them the values after it: too few, and they can't be alike.
    left = F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("other_rank")) + 1
    enough = left * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    pairs = seekers.join(found, "value").where(F.col("label") != F.col("other_label")).where(_alike_sizes(percent)).where(enough).select("id", "other")
    more = verified(pairs, "links")
    made, links = [links, more], links.unionAll(more)

    copies = some.join(classes.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    roots = components(copies.unionAll(links.select("a", "b")))
    unstage(classes, lists, apart, sets, full, *made)
    out = sketches.select("doc_id", "n_shingles").join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce(F.coalesce("root", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the least of their group, same columns. Rows without an id stay.

    Rows that repeat an id are one document if their texts are equal, and of those one stays. Other texts of an id are
    documents of their own: all but that of least hash go under a number made of the id and the text, which stands after the ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")).where("doc_id is not null")
    hashed = F.xxhash64("text")
    several = rows.select("doc_id", hashed.alias("h")).groupBy("doc_id").agg(F.min("h").alias("_least"), F.max("h").alias("_most")).where("_least <> _most").select(F.col("doc_id").alias("_several"), "_least")
    own = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    # Texts go through these shuffles only where an id has several texts, or a kept row repeats.
    if not several.isEmpty():
        rows = rows.join(several, rows["doc_id"] == several["_several"], "left").select(F.when(F.col("_least").isNull() | (F.col("_least") == hashed), F.col("doc_id")).otherwise(own).alias("doc_id"), "text", "_row")
    kept = staged(near_duplicates(rows.select("doc_id", "text"), width=width, percent=percent).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_times")), "kept")
    rows, single = rows.select("doc_id", "_row"), kept.where("_times = 1").select("doc_id")
    single = F.broadcast(single) if kept.count() <= MOST_SENT else single
    out = rows.join(single, "doc_id", "left_semi").select("_row.*")
    if not (twice := kept.where("_times > 1")).isEmpty():
        out = out.unionAll(rows.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*"))
    return out.unionAll(docs.where("doc_id is null"))
