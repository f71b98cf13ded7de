"""Toxicity by compression distance.

Two dictionaries, both trained by zstandard: one on windows of ordinary text, and one on what
toxic rows say that ordinary rows don't. The second lies ahead of a copy of the first, furthest
from the window, so that what both hold costs the same. A window of words that compresses
shorter with it says something only toxic documents say. Statistics of a document's window
gains go through boosted trees that calibrate them to a probability.

Training picks what is frequent, which in toxic rows is mostly what ordinary rows have too. So
the toxic rows are trained on in extracts: the runs of words and pairs of words that mark toxic
documents by likelihood ratio; an ordinary document that quotes one, or is mislabelled, only
weakens it. All is learned from a bounded, labelled sample (``max_rows`` rows, and of an
ordinary row ``WINDOWS_EACH`` windows spread over all of it). To calibrate, each half of the
sample is judged by dictionaries of the other half, which haven't seen it; the dictionaries that
score are of the whole sample. Settings were compared between halves of the training rows.

Null and empty texts have no windows and score as the trees say of no gain. Labels that
are null, or without a document, are left out; of several for an id the largest counts.
Without both labels in the sample all scores are the share of toxic rows, or 0.5 without
rows. Very long texts are whole: every window counts. Repeated rows score alike; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import label_sample, map_batches, remainder_of_id, schema_of, staged, unstage, words_of
from .quality_gbt import fit_forest

WINDOW, LEVEL = 16, 12
#: Bytes of the trained dictionaries; windows taken from each sampled ordinary document, where no other number is asked for.
ORDINARY, TOXIC, WINDOWS_EACH = 250_000, 2_000, 12
#: The share of toxic rows with a toxic word or pair is this many times the share of ordinary ones, at least.
RATIO = 5
GAINS = "top1 double, top2 double, top3 double, top_mean double, share double, over2 double, over4 double, over6 double, mean double, length double"


def windows(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]


def spread(found: list[bytes], most: int | None = WINDOWS_EACH) -> list[bytes]:
    """``most`` of the windows, evenly over the whole text; all where there are fewer, or where it is None."""
    return [found[i * len(found) // most] for i in range(most)] if most is not None and len(found) > most else found


class Distance:
    """Gain in bytes of each window by the toxic dictionary over the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.toxic = self._with(ordinary), self._with(toxic + b" " + ordinary)

    @staticmethod
    def _with(content: bytes) -> zstandard.ZstdCompressor:
        content = content if len(content) >= 8 else content.ljust(8)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def gains(self, text: str | None) -> list[float]:
        plain, toxic = self.plain.compress, self.toxic.compress
        v = np.sort(np.array([len(plain(w)) - len(toxic(w)) for w in windows(words_of(text))], dtype=np.float64))[::-1]
        if not len(v):
            return [0.0] * 10
        top = [float(v[i]) if i < len(v) else 0.0 for i in range(3)]
        return [*top, float(v[:3].mean()), float((v >= 3).mean()), *(float((v >= k).sum()) for k in (2, 4, 6)), float(v.mean()), float(np.log1p(len(v)))]


_distances: dict[tuple[bytes, bytes], Distance] = {}


def distance(ordinary: bytes, toxic: bytes) -> Distance:
    """One for each worker and pair of dictionaries."""
    if (ordinary, toxic) not in _distances:
        _distances.clear()
        _distances[ordinary, toxic] = Distance(ordinary, toxic)
    return _distances[ordinary, toxic]


def toxic_units(rows: DataFrame) -> list[bytes]:
    """Words, then pairs of neighbouring words without such a word, that mark the toxic rows by likelihood ratio, the strongest of each first."""
    totals = rows.agg(F.count(F.when(F.col("_label") > 0, 1)).alias("toxic"), F.count("*").alias("n")).first()
    toxic, n = totals["toxic"], totals["n"]
    if not 0 < toxic < n:
        return []
    words = marks(rows, 1, frozenset(), toxic, n)
    return words + marks(rows, 2, frozenset(words), toxic, n)


def toxic_text(rows: DataFrame) -> bytes:
    """The units as one text, the strongest words last."""
    return b" ".join(reversed(toxic_units(rows)))


def extract(words: list[bytes], units: frozenset[bytes]) -> bytes:
    """The runs of a text's words that are units or lie in a pair that is one."""
    keep = [w in units for w in words]
    for i in range(len(words) - 1):
        if b" ".join(words[i : i + 2]) in units:
            keep[i] = keep[i + 1] = True
    return b"".join(w + b" " for w, k in zip(words, keep, strict=True) if k)


def toxic_dictionary(rows: DataFrame) -> bytes:
    """A dictionary that zstandard trains on extracts of the toxic rows, after the units that training left out, the strongest last; empty where no unit marks them.

    Training takes whole stretches of its samples, by how often they recur, so that it cuts or misses rare words.
    """
    units = toxic_units(rows)
    known = frozenset(units)
    if not units:
        return b""

    def each(batch: pa.RecordBatch) -> dict:
        return {"x": [x for t in batch.column("text") if (x := extract(words_of(t.as_py()), known))]}

    found = sorted(bytes(r["x"]) for r in map_batches(rows.where("_label > 0").select("text"), each, "x binary").collect())
    try:
        trained = zstandard.train_dictionary(TOXIC, found, k=16, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the units are the dictionary themselves
        return b" ".join(reversed(units))
    left_out = [u for u in reversed(units) if u not in trained]
    return b" ".join([*left_out, trained])


def around(words: list[bytes], width: int, known: frozenset[bytes], wanted: frozenset[bytes] | None) -> dict[bytes, tuple[int, int]]:
    """Units of ``width`` words, of the ``wanted`` ones and without ``known`` words, each with hashes of the two words before and of the two after it, the least of its places. An end of the text has those of the other side."""
    out: dict[bytes, tuple[int, int]] = {}
    for i in range(len(words) - width + 1):
        unit = words[i] if width == 1 else b" ".join(words[i : i + width])
        if (wanted is None or unit in wanted) and (not known or known.isdisjoint(words[i : i + width])):
            before, after = words[max(0, i - 2) : i], words[i + width : i + width + 2]
            at = zlib.crc32(b" ".join(before or after)), zlib.crc32(b" ".join(after or before))
            out[unit] = min(at, out.get(unit, at))
    return out


def marks(rows: DataFrame, width: int, known: frozenset[bytes], toxic: int, n: int) -> list[bytes]:
    """Units of ``width`` words whose share of toxic rows is ``RATIO`` times that of ordinary ones, and not by chance, strongest first.

    Twice the log-likelihood ratio exceeds twice the logarithm of the number of units tried, so
    that about one passes by chance. A unit counts as often as the words before it and those
    after it differ, as copies of a text are no further evidence. Only units frequent enough are counted in
    ordinary rows.
    """

    def counted(part: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
        def each(batch: pa.RecordBatch) -> dict:
            found = {x for text in batch.column("text") for x in around(words_of(text.as_py()), width, known, wanted).items()}
            return {"unit": [u for u, _ in found], "before": [p for _, (p, _) in found], "after": [q for _, (_, q) in found]}

        places = map_batches(part.select("text"), each, "unit binary, before long, after long")
        return places.groupBy("unit").agg(F.least(F.count_distinct("before"), F.count_distinct("after")).alias("n"))

    in_toxic = staged(counted(rows.where("_label > 0"), None), "toxic-units")
    least = 2 * math.log(max(2, in_toxic.count()))
    hits = {bytes(r["unit"]): r["n"] for r in in_toxic.where(F.col("n") * (2 * math.log(n / toxic)) > least).collect()}
    unstage(in_toxic)
    if not hits:
        return []
    plain = {bytes(r["unit"]): r["n"] for r in counted(rows.where("_label <= 0"), frozenset(hits)).collect()}
    found = []
    for unit, k in hits.items():
        p = plain.get(unit, 0)
        ratio = 2 * (k * math.log(k * n / ((k + p) * toxic)) + (p * math.log(p * n / ((k + p) * (n - toxic))) if p else 0))
        if ratio > least and k * (n - toxic) >= RATIO * p * toxic:
            found.append((-ratio, unit))
    return [unit for _, unit in sorted(found)]


def ordinary_text(rows: DataFrame, most: int | None = WINDOWS_EACH) -> bytes:
    """A dictionary that zstandard trains on windows spread over the ordinary rows, ``most`` of each."""

    def each(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column("text"):
            out += spread(windows(words_of(text.as_py())), most)
        return {"w": out}

    found = [bytes(r["w"]) for r in map_batches(rows.where("_label = 0").select("text"), each, "w binary").collect()]
    try:
        return zstandard.train_dictionary(ORDINARY, sorted(found), k=48, d=8).as_bytes()[-ORDINARY:]
    except zstandard.ZstdError:  # too few windows to train on: they are the dictionary themselves
        return b" ".join(sorted(found))[-ORDINARY:]


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_fold: int = 1, threshold: float = 0.7, max_rows: int = 20_000, windows_each: int | None = WINDOWS_EACH) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of each document.

    At most ``max_rows`` labelled ids are learned from (of rows that repeat one, that whose text has the least hash), and
    ``windows_each`` windows of each ordinary text, all with None: then the driver holds all of their texts.
    """
    held = remainder_of_id("doc_id", folds) == held_fold
    sample = label_sample(labels, "toxic", ~held, max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_label").alias("_label"))
    rows = staged(rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))), "toxicity-sample")
    halves = [rows.where("half = 0"), rows.where("half = 1")]
    learned = lambda r: (ordinary_text(r, windows_each), toxic_dictionary(r))

    def gains(batch: pa.RecordBatch, held: tuple[bytes, bytes]) -> np.ndarray:
        d = distance(*held)
        return np.array([d.gains(t.as_py()) for t in batch.column("text")]).reshape(-1, 10)

    def judged(half: DataFrame, other: DataFrame) -> np.ndarray:
        held = learned(other)

        def fitted(batch: pa.RecordBatch) -> dict:
            return {"_label": batch.column("_label")} | {f.split()[0]: g for f, g in zip(GAINS.split(", "), gains(batch, held).T, strict=True)}

        return map_batches(half.select("text", F.col("_label").cast("double").alias("_label")), fitted, f"_label double, {GAINS}").toPandas().to_numpy(dtype=float).reshape(-1, 11)

    seen = np.concatenate([judged(*halves), judged(*reversed(halves))])
    forest = fit_forest(seen[:, 1:], (seen[:, 0] > 0).astype(float), trees=60, depth=3, rate=0.1, least_rows=5)
    whole = learned(rows)

    def scored(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": forest.score(gains(batch, whole))}

    out = map_batches(docs.select("doc_id", "text"), scored, schema_of(docs, ("doc_id",), "score double"))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
