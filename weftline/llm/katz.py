"""Language-model scores by Katz backoff over word bigrams.

Counts are discounted by Good-Turing up to ``K``; what that frees is given to unseen
words in proportion to their unigram probability, with weights that make each history's
distribution sum to one exactly. Unigrams back off to one unknown word in the same way.

Texts are cut into blocks of a few megabytes. A block asks once for each of its distinct
words, then once for each distinct bigram; requests meet in buckets by hash, where counts
are summed over all blocks and sent back, aligned with the request. So what is moved
follows the distinct pairs of block and n-gram, packed, and no word makes a hot key: a
history with more than a fair share of tokens is spread over all buckets by its next
words, and only its sums meet. Nothing but totals, counts of counts and those sums (of
``SPREAD`` histories a bucket at most) reaches the driver.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; each text ends with an end token,
which counts, and starts after a start mark, which doesn't. Words are known by 64-bit
hashes. Very long texts are whole, a block by themselves if need be. Null texts count as empty: one end token. Null ids are never held out. Rows that
repeat count each time. Without training rows every word is unknown: N and V are 0. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, mixed, remainder_of_id, staged, word_hashes, words_of

K, BLOCK_BYTES, BUCKET_TOKENS, SPREAD = 5, 8_000_000, 1_500_000, 4
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
#: Ids of the start mark and of unknown words; ids of words are smaller.
START, UNKNOWN = 1 << 62, (1 << 62) + 1
MADE = "block long, bucket long, payload binary, more binary, totals array<long>"
_MADE = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary()), ("more", pa.binary()), ("totals", pa.list_(pa.int64()))])
Key = tuple[pa.Scalar, ...]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, one byte position after the other, so that unused high bytes cost nothing."""
    out = zstandard.ZstdCompressor(level=1)
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return len(columns).to_bytes(2, "little") + out.compress(planes)


def unpack(data: bytes, dtype=np.int64) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), dtype=np.uint8)
    n = int.from_bytes(data[:2], "little")
    return [np.ascontiguousarray(c.reshape(8, -1).T).view(dtype).ravel() for c in planes.reshape(n, -1)] if len(planes) else [np.zeros(0, dtype)] * n


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _MADE, strict=True)] if rows else [pa.array([], type=f.type) for f in _MADE], schema=_MADE)


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of whole documents: ids, training flags, tokens of each, and all tokens by their place among the block's sorted word hashes."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("flags", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary()), ("n", pa.int64())])

    def run(batches):
        number, ids, train, hashes, size = 0, [], [], [], 0
        part = TaskContext.get().partitionId()

        def done() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            flags = pack(np.array(train, dtype=np.int64), np.array([len(h) for h in hashes], dtype=np.int64))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(([part << 32 | number], [ids], [flags], [pack(words)], [pack(tokens.astype(np.int64))], [len(tokens)]), schema, strict=True)], schema=schema)

        for b in batches:
            for i, t, held in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("held_out").to_pylist(), strict=True):
                text = t.as_py()
                ids.append(i), train.append(int(not held)), hashes.append(np.append(word_hashes(words_of(text)), END))
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield done()
                    number, ids, train, hashes, size = number + 1, [], [], [], 0
        if ids:
            yield done()

    return docs.mapInArrow(run, "block long, ids array<long>, flags binary, words binary, tokens binary, n long")


def _word_requests(bits: int):
    """Each block's distinct words and their training counts, cut by the top bits of the hash."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                (words,), (tokens,), (train, sizes) = unpack(row["words"], np.uint64), unpack(row["tokens"]), unpack(row["flags"])
                counts = np.bincount(tokens[np.repeat(train, sizes) == 1], minlength=len(words)).astype(np.int64)
                bucket = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = [(row["block"], int(bucket[a]), pack(words[a:z]), pack(counts[a:z]), None) for a, z in zip(cuts, [*cuts[1:], len(words)], strict=True)]
                yield from _rows(rows).to_batches()

    return run


def _count_words(key: Key, rows: pa.Table) -> pa.Table:
    """Sums counts of a bucket's words over all blocks; sends each block the ids and counts of its words."""
    rows = rows.sort_by("block").to_pylist()
    words = [unpack(r["payload"], np.uint64)[0] for r in rows]
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([unpack(r["more"])[0] for r in rows]), minlength=len(distinct)).astype(np.int64)
    bucket = key[0].as_py()
    ids = np.where(counts > 0, bucket << 32 | np.arange(len(distinct)), UNKNOWN)
    out, at = [], 0
    for r, w in zip(rows, words, strict=True):
        mine = place[at : at + len(w)]
        at += len(w)
        out.append((r["block"], bucket, pack(ids[mine], counts[mine]), None, None))
    totals = [int(counts.sum()), int((counts > 0).sum()), *(int((counts == r).sum()) for r in range(1, K + 2))]
    return _rows([*out, (-1, bucket, None, None, totals)])


def discounts(of_count: list[int]) -> np.ndarray:
    """Good-Turing factor of each count from 0 to K, from the numbers of n-grams met 1 to K+1 times. Where these don't give a factor between 0 and 1, a share of one count is taken off instead."""
    n = [0.0, *map(float, of_count)]
    taken = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    out = np.ones(K + 1)
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - taken) / r
    return out


class Unigrams:
    """Probabilities of words by count, and the share of unknown ones."""

    def __init__(self, totals: list[int]):
        self.n, self.v = totals[0], totals[1]
        self.factors = discounts(totals[2:])
        kept = self.n - sum((1 - self.factors[r]) * r * totals[1 + r] for r in range(1, K + 1))
        #: Without rare words nothing is freed: unknown words then count as one token.
        self.whole = self.n if self.n and kept < self.n else self.n + 1
        self.unknown = 1 - kept / self.whole

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, counts * self.factors[np.where(counts <= K, counts, 0)] / self.whole, self.unknown)


class Opened:
    """A block with the ids and counts of its words, its tokens, their histories, and its distinct bigrams."""

    def __init__(self, row: dict, answers: list[dict], docs: int, buckets: int, hot: int):
        (self.tokens,), (self.train, self.sizes) = unpack(row["tokens"]), unpack(row["flags"])
        found = [unpack(a["payload"]) for a in sorted(answers, key=lambda a: a["bucket"])]
        ids, counts = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        n = len(ids)
        self.ids, self.counts = np.append(ids, [START, UNKNOWN]), np.append(counts, [docs, 0])
        words = np.where(self.counts[self.tokens] > 0, self.tokens, n + 1)
        before = np.roll(words, 1)
        before[np.cumsum(self.sizes) - self.sizes] = n
        self.words, self.before = words, before
        known = self.counts[before] > 0
        pairs, place = np.unique(np.where(known, before * (n + 2) + words, -1), return_inverse=True)
        h, w = pairs // (n + 2), pairs % (n + 2)
        spread = mixed((self.ids[h] * 31 + self.ids[w]).astype(np.uint64)) % np.uint64(buckets)
        own = mixed(self.ids[h].astype(np.uint64)) % np.uint64(buckets)
        bucket = np.where(pairs < 0, -1, np.where(self.counts[h] > hot, spread, own).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        self.h, self.w, self.bucket = h[order], w[order], bucket[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        #: For each token, its bigram's place in order of bucket, history and word.
        self.place = rank[place]
        #: The bucket -1 holds histories that were never seen; these aren't asked for.
        self.unasked = int((self.bucket < 0).sum())


def _opened_by_block(left: pa.Table, right: pa.Table, model: dict) -> Opened | None:
    answers = [r for r in right.to_pylist() if r["payload"] is not None]
    return Opened(left.to_pylist()[0], answers, model["docs"], model["buckets"], model["hot"]) if left.num_rows else None


def _bigram_requests(model: dict):
    def run(key: Key, left: pa.Table, right: pa.Table) -> pa.Table:
        b = _opened_by_block(left, right, model)
        if b is None:
            return _rows([])
        seen = np.bincount(b.place[np.repeat(b.train, b.sizes) == 1], minlength=len(b.h)).astype(np.int64)
        rows, start = [], b.unasked
        cuts = start + np.flatnonzero(np.diff(b.bucket[start:], prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(b.h)], strict=True):
            h, w = b.h[a:z], b.w[a:z]
            rows.append((key[0].as_py(), int(b.bucket[a]), pack(np.diff(b.ids[h], prepend=0), b.ids[w], b.counts[w], seen[a:z], (b.counts[h] > model["hot"]).astype(np.int64)), None, None))
        return _rows(rows)

    return run


def _count_bigrams(unigrams: Unigrams):
    """Sums a bucket's bigrams over all blocks. A block gets each bigram's count, and for its histories the sums that backoff weights are made of."""

    def run(key: Key, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block").to_pylist()
        asked = [unpack(r["payload"]) for r in rows]
        histories, h = np.unique(np.concatenate([np.cumsum(a[0]) for a in asked]), return_inverse=True)
        words, w = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
        pairs, first, place = np.unique(h * len(words) + w, return_index=True, return_inverse=True)
        met = np.bincount(place, weights=np.concatenate([a[3] for a in asked]), minlength=len(pairs)).astype(np.int64)
        hot = np.zeros(len(histories), bool)
        hot[h] = np.concatenate([a[4] for a in asked]) > 0
        seen = met > 0
        of, r = h[first][seen], met[seen]
        p = unigrams.probability(np.concatenate([a[2] for a in asked])[first][seen])
        total = lambda x: np.bincount(of, weights=x, minlength=len(histories))
        sums = [*(total(r == k).astype(np.int64) for k in range(1, K + 1)), total(np.where(r > K, r, 0)).astype(np.int64), total(p).view(np.int64)]
        out, at = [], 0
        for row, a in zip(rows, asked, strict=True):
            mine = slice(at, at + len(a[0]))
            at += len(a[0])
            # Sums go with the histories in order, those that are spread left out.
            own = np.unique(h[mine])
            own = own[~hot[own]]
            out.append((row["block"], key[0].as_py(), pack(met[place[mine]]), pack(histories[own], *(s[own] for s in sums)), None))
        if hot.any():
            out.append((-1, key[0].as_py(), None, pack(histories[hot], *(s[hot] for s in sums)), None))
        totals = [int((met == k).sum()) for k in range(1, K + 2)]
        return _rows([*out, (-2, key[0].as_py(), None, None, totals)])

    return run


def backoff(history: np.ndarray, sums: list[np.ndarray], factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per history: the total its counts are divided by, and its backoff weight. A history without rare followers frees nothing, and divides by one more."""
    freed = sum((1 - factors[k]) * k * sums[k - 1] for k in range(1, K + 1))
    whole = history + (freed <= 0)
    left = np.where(freed > 0, freed, 1.0) / whole
    return whole.astype(np.float64), left / np.maximum(1 - sums[K + 1].view(np.float64), 1e-300)


def _scores(model: dict, unigrams: Unigrams, factors: np.ndarray, spread: dict[int, tuple]):
    def run(key: Key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        # Answers on words have no second part, those on bigrams do.
        about_words, about_pairs = [r for r in rows if r["more"] is None and r["payload"]], sorted((r for r in rows if r["more"] is not None), key=lambda r: r["bucket"])
        row = left.to_pylist()[0]
        b = Opened(row, about_words, model["docs"], model["buckets"], model["hot"])
        met = np.concatenate([np.zeros(b.unasked, np.int64), *(unpack(r["payload"])[0] for r in about_pairs)])
        sums = [np.concatenate(c) for c in zip(*(unpack(r["more"]) for r in about_pairs), strict=True)] if about_pairs else []
        n = len(b.ids)
        whole, weight = np.ones(n), np.ones(n)
        if sums:
            order = np.argsort(b.ids, kind="stable")
            at = order[np.searchsorted(b.ids[order], sums[0])]
            whole[at], weight[at] = backoff(b.counts[at], sums[1:], factors)
        for i in np.flatnonzero(b.counts > model["hot"]):
            if (found := spread.get(int(b.ids[i]))) is not None:
                whole[i], weight[i] = (float(x[0]) for x in backoff(b.counts[i : i + 1], [np.array([v]) for v in found], factors))
        r, c = met[b.place], b.counts[b.words]
        lower = unigrams.probability(c)
        factor = factors[np.where(r <= K, r, 0)]
        with np.errstate(divide="ignore"):
            p = np.where(r > 0, np.log10(factor * r / whole[b.before]), np.log10(weight[b.before]) + np.log10(lower))
        starts = np.cumsum(b.sizes) - b.sizes
        out = {
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(b.train == 0), "n_tokens": pa.array(b.sizes), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(starts), unigrams.n, np.int64)), "base_score": pa.array(np.add.reduceat(np.log10((c + 1) / (unigrams.n + unigrams.v + 1)), starts)), "score": pa.array(np.add.reduceat(p, starts)),
        }
        return pa.table(out)

    return run


def _totals(made: DataFrame, block: int, n: int) -> list[int]:
    found = made.where(F.col("block") == block).select(F.posexplode("totals").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    return [next((int(r["n"]) for r in found if r["i"] == i), 0) for i in range(n)]


def _spread_sums(made: DataFrame) -> dict[int, tuple]:
    """Sums of the histories that are spread over buckets; there are ``SPREAD`` to a bucket at most."""
    schema = "h long, " + ", ".join(f"s{i} long" for i in range(K + 1)) + ", p double"

    def run(batches):
        for b in batches:
            for x in b.column("more").to_pylist():
                h, *s, p = unpack(x)
                yield pa.RecordBatch.from_arrays([pa.array(h), *map(pa.array, s), pa.array(p.view(np.float64))], names=["h", *(f"s{i}" for i in range(K + 1)), "p"])

    rows = made.where("block = -1 and more is not null").select("more").mapInArrow(run, schema)
    found = rows.groupBy("h").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(K + 1)), F.sum("p").alias("p")).collect()
    return {r["h"]: (*(int(r[f"s{i}"]) for i in range(K + 1)), r["p"]) for r in found}


def katz_scores(docs: DataFrame, *, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one unigrams) and ``score`` (Katz), log10."""
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", remainder_of_id("doc_id", folds) == held_fold)
    blocks = staged(_blocks(rows), "blocks")
    tokens = blocks.agg(F.sum("n")).first()[0]
    if not tokens:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    bits = max(0, int(tokens // BUCKET_TOKENS).bit_length())
    asked = blocks.mapInArrow(_word_requests(bits), MADE)
    answers = staged(asked.groupBy("bucket").applyInArrow(_count_words, MADE), "word-counts")
    unigrams = Unigrams(_totals(answers, -1, K + 3))
    docs_trained = rows.where("not held_out").count()
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    model = {"docs": docs_trained, "buckets": buckets, "hot": max(unigrams.n // (SPREAD * buckets), 1000)}
    words = answers.where("block >= 0")
    asked = blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_bigram_requests(model), MADE)
    pairs = staged(asked.groupBy("bucket").applyInArrow(_count_bigrams(unigrams), MADE), "bigram-counts")
    factors = discounts(_totals(pairs, -2, K + 1))
    spread = {h: (*s[:-1], np.float64(s[-1])) for h, s in _spread_sums(pairs).items()}
    both = words.unionAll(pairs.where("block >= 0"))
    out = blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_scores(model, unigrams, factors, spread), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out
