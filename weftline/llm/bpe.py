"""Byte-level BPE, encoding and decoding as the tokenizers library does.

A short word's parts and the ranks of adjacent parts are two contiguous arrays: scan for
the least rank, delete that boundary, refresh the two ranks beside it. The words that a
slice of texts has anew are rows of two tables, and all take a step at once. Long words, where
repeated scans would cost the square of the length, take the same merges from a heap: both
ways give the library's ids.

A slice of texts stays in Arrow columns. It is cut before spaces, where a word always begins
unless white space follows, and each distinct unit between is met once: a word, or some words
without a space between, as of a word and a comma. Units recur, so each Python worker remembers
the ids of those it has met, as flat arrays within a bound.

Null texts count as empty and have no tokens; their decoded text is empty. Special tokens
in a text get their own ids, as in the library. Rows are independent: repeated rows and
null ids pass through, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import holds, map_batches, schema_of

#: Words this long in bytes take the heap.
LONG_WORD = 200
#: Units remembered by a worker, about 60 bytes each; beyond them the half goes that the fewest slices had.
MOST_UNITS = 200_000
#: The published split of byte-level BPE into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII text, where the standard library's engine serves.
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\x0b\x0c\rA-Za-z0-9]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+"
#: A unit that is one word, and one that doesn't begin with a word (white space as Unicode has it, and some more). Both as RE2 has them.
ONE_WORD, NO_WORD = r"\A ?(?:\p{L}+|\p{N}+)\z", r"\A(?:\z|[\x09-\x0d\x1c-\x20\x{85}\p{Z}])"
NEVER = 1 << 30


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of an array, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - ends + sizes, sizes) + np.arange(sizes.sum())]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in plain]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary and merges of a tokenizer file, and remembered units: their ids, where those begin, how many they are, and how many slices had the unit."""

    def __init__(self, path: str):
        self.units, self.ids = pa.array([], type=pa.string()), np.zeros(0, dtype="<u4")
        self.begins, self.sizes, self.met = (np.zeros(0, dtype=np.int64) for _ in range(3))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in special} | {i: t.encode() for t, i in special.items()}
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank, self.merged = {}, []
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault(vocab[a] << 32 | vocab[b], k)
            self.merged.append(vocab[a + b])
        self.first_ids, self.merged_ids = np.array(self.first, dtype=np.int32), np.array(self.merged, dtype=np.int32)
        self.pairs = np.array(sorted(self.rank), dtype=np.int64)
        self.pair_ranks = np.array([self.rank[int(k)] for k in self.pairs], dtype=np.int32)
        #: Ranks of two bytes, side by side, as parts.
        self.byte_ranks = self._ranks(np.repeat(self.first_ids, 256), np.tile(self.first_ids, 256))
        self.special, self.special_texts = special, pa.array(list(special), type=pa.string())
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split, self.split_ascii = regex.compile(SPLIT), re.compile(SPLIT_ASCII)

    def merged_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that aren't remembered, one after another, and how many each has. All of about one length go together."""
        offsets, data = (np.frombuffer(b or b"", dtype=t) for b, t in zip(words.buffers()[1:], (np.int32, np.uint8), strict=True))
        offsets = offsets[words.offset : words.offset + len(words) + 1].astype(np.int64)
        widths = np.diff(offsets)
        widths[special := pc.is_in(words, value_set=self.special_texts).to_numpy(zero_copy_only=False)] = NEVER
        order, at = np.argsort(widths, kind="stable"), 0
        flats, counts = [], np.zeros(len(words), dtype=np.int64)
        while at < len(order):
            width = int(widths[order[at]])
            if width >= LONG_WORD:
                for i in order[at:].tolist():
                    ids = [self.special[words[i].as_py()]] if special[i] else self._long(self.first_ids[data[offsets[i] : offsets[i + 1]]].tolist())
                    flats.append(np.array(ids, dtype="<u4"))
                    counts[i] = len(flats[-1])
                break
            # Lengths within a quarter of each other share a table; none grows beyond some megabytes.
            most, stop = width + max(2, width // 4), at + 1
            while stop < len(order) and widths[order[stop]] <= most and (stop - at) * most < 1_000_000:
                stop += 1
            flat, counts[order[at:stop]] = self._short(data, offsets[order[at:stop]], widths[order[at:stop]])
            flats.append(flat)
            at = stop
        ends = np.cumsum(counts[order])
        begins = np.empty_like(ends)
        begins[order] = ends - counts[order]
        return gathered(np.concatenate([np.zeros(0, dtype="<u4"), *flats]), begins, counts), counts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER where there is none; -1 stands for no part."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], np.int32(NEVER))

    def _short(self, data: np.ndarray, begins: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, none empty, and how many each has: for each word a row of parts, closed by -1, and a row of the ranks of neighbouring parts."""
        place = np.arange(int(widths.max()) + 1)
        inside = place < widths[:, None]
        letters = data[np.where(inside, begins[:, None] + place, 0)]
        ids = np.where(inside, self.first_ids[letters], np.int32(-1))
        ranks = np.where(inside[:, 1:], self.byte_ranks[letters[:, :-1].astype(np.int32) << 8 | letters[:, 1:]], np.int32(NEVER))
        out, mine = np.full_like(ids, -1), np.arange(len(widths))
        while len(mine):
            least = ranks.argmin(1)
            found = ranks[np.arange(len(ranks)), least]
            if (done := found == NEVER).any():
                out[mine[done], : ids.shape[1]] = ids[done]
                mine, ids, ranks, least, found = mine[~done], ids[~done], ranks[~done], least[~done], found[~done]
            # The boundary at the least rank goes, and with it a part and a rank; the ranks beside it are looked up anew.
            rows, cut, column = np.arange(len(mine)), least[:, None], np.arange(ids.shape[1] - 1)
            ids[rows, least] = self.merged_ids[found]
            ids = np.where(column > cut, ids[:, 1:], ids[:, :-1])
            ranks = np.where(column[:-1] >= cut, ranks[:, 1:], ranks[:, :-1])
            own = ids[rows, least]
            ranks[rows, least] = self._ranks(own, ids[rows, least + 1])
            inner = least > 0
            ranks[rows[inner], least[inner] - 1] = self._ranks(ids[rows[inner], least[inner] - 1], own[inner])
        return out[out >= 0].astype("<u4"), (out >= 0).sum(1)

    def _long(self, ids: list[int]) -> list[int]:
        get, merged, n = self.rank.get, self.merged, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a << 32 | b)) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = merged[r], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split).findall(text)

    def pieces(self, text: str | None) -> list[str]:
        """Words of a text, and special tokens."""
        if not text:
            return []
        if not self.at_special or not any(map(text.__contains__, self.special)):
            return self.words(text)
        return [w for x in self.at_special.split(text) if x for w in ([x] if x in self.special else self.words(x))]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's end."""
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        cut = pc.split_pattern(texts, " ")
        coded, sizes = cut.flatten().dictionary_encode(), pc.list_value_length(cut).to_numpy().astype(np.int64)
        # What opens a text has no space before it.
        later, codes, starts = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
        doubtful = pc.match_substring_regex(later, NO_WORD).to_numpy(zero_copy_only=False)[codes]
        doubtful[starts] = False
        whole = np.logical_or.reduceat(doubtful, starts)
        for t in self.special:
            whole |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        opening, others = later.take(pa.array(codes[starts])), []
        codes[starts] = len(later) + np.arange(len(texts))
        if whole.any():
            runs, at = np.split(codes, starts[1:]), len(later) + len(texts)
            for i in np.flatnonzero(whole).tolist():
                others.append(pa.array(self.pieces(texts[i].as_py()), type=pa.string()))
                runs[i] = at + np.arange(len(others[-1]))
                at += len(others[-1])
            codes, sizes = np.concatenate(runs), np.array([len(x) for x in runs])
        units = pa.concat_arrays([pc.binary_join_element_wise(" ", later, ""), opening, *others])
        used = np.bincount(codes, minlength=len(units)) > 0
        flat, begins, counts = self.ids_of(units.filter(pa.array(used)))
        codes = (np.cumsum(used) - 1)[codes]
        return gathered(flat, begins[codes], counts[codes]), np.append(0, np.cumsum(counts[codes]))[np.cumsum(sizes)]

    def ids_of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of whole words, or special tokens: an array of ids, where in it those of each unit begin, and how many they are. What is new is remembered."""
        coded = units.dictionary_encode()
        begins, counts, new = self.remembered(coded.dictionary)
        fresh = coded.dictionary.filter(pa.array(new))
        one = pc.or_(pc.match_substring_regex(fresh, ONE_WORD), pc.is_in(fresh, value_set=self.special_texts))
        many = fresh.filter(pc.invert(one))
        split = [self.words(u) for u in many.to_numpy(zero_copy_only=False)]
        words = pa.concat_arrays([fresh.filter(one), pa.array([w for ws in split for w in ws], type=pa.string())]).dictionary_encode()
        # Ids of words, then of the new units: those of one word first.
        at, n, unknown = self.remembered(words.dictionary)
        missing = words.dictionary.filter(pa.array(unknown))
        ids, n[unknown] = self.merged_words(missing)
        at[unknown] = len(self.ids) + np.cumsum(n[unknown]) - n[unknown]
        index, parts = words.indices.to_numpy(), np.array([1] * (len(fresh) - len(many)) + [len(ws) for ws in split], dtype=np.int64)
        more = gathered(np.concatenate([self.ids, ids]), at[index], n[index])
        ends = np.append(0, np.cumsum(n[index]))[np.cumsum(parts)]
        flat, sizes = np.concatenate([self.ids, more]), np.diff(ends, prepend=0)
        one = one.to_numpy(zero_copy_only=False)
        place = np.flatnonzero(new)[np.argsort(~one, kind="stable")]
        begins[place], counts[place] = len(self.ids) + ends - sizes, sizes
        singles = len(fresh) - len(many)
        self.remember(pa.concat_arrays([missing, many]), np.concatenate([ids, more[sizes[:singles].sum() :]]), np.concatenate([n[unknown], sizes[singles:]]))
        index = coded.indices.to_numpy()
        return flat, begins[index], counts[index]

    def remembered(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of distinct units begin, how many they are, and which units are unknown."""
        at = pc.index_in(units, value_set=self.units)
        known, place = at.is_valid().to_numpy(zero_copy_only=False), at.drop_null().to_numpy()
        begins, counts = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64)
        begins[known], counts[known] = self.begins[place], self.sizes[place]
        self.met[place] += 1
        return begins, counts, ~known

    def remember(self, units: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        short = pc.less(pc.binary_length(units), LONG_WORD)
        mask = short.to_numpy(zero_copy_only=False)
        units, begins, sizes = pa.concat_arrays([self.units, units.filter(short)]), np.append(self.begins, (len(self.ids) + ends - sizes)[mask]), np.append(self.sizes, sizes[mask])
        met, ids = np.append(self.met, np.ones(mask.sum(), dtype=np.int64)), np.append(self.ids, ids)
        if len(units) > MOST_UNITS:
            stay = np.sort(np.argsort(-met, kind="stable")[: MOST_UNITS // 2])
            units, begins, sizes, met = units.take(pa.array(stay)), begins[stay], sizes[stay], met[stay] // 2
        self.units, self.ids, self.sizes, self.met = units, gathered(ids, begins, sizes), sizes, met
        self.begins = np.cumsum(sizes) - sizes

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as bytes of little-endian 32-bit integers."""
        ids, ends = self.encode_column(texts)
        return [ids[a:z].tobytes() for a, z in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], type=pa.string()))[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def bpe(name: str) -> Bpe:
    """The tokenizer of a vocabulary file of ``public_tokenizers``, or at a path; one for each worker."""
    if name not in _loaded:
        import public_tokenizers

        _loaded[name] = Bpe(name if "/" in name else public_tokenizers.path(name))
    holds("bpe", _loaded.clear)
    return _loaded[name]


def round_trips(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """``doc_id``, ``n_tokens``, and SHA-256 digests of the ids (32-bit, little-endian) and of the text decoded from them."""

    def each(batch: pa.RecordBatch) -> dict:
        coder = bpe(vocabulary)
        ids = coder.encode_all(batch.column("text"))
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(coder.decode(x).encode("utf-8")).hexdigest() for x in ids],
        }

    return map_batches(docs.select("doc_id", "text"), each, schema_of(docs, ("doc_id",), "n_tokens long, ids_sha256 string, decoded_sha256 string"), keeps="bpe")
