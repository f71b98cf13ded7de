"""Fill-in-middle by rank and select over packed boundary bits.

A text is cut between tokens, runs of ASCII letters and single other code points. The starts of all
tokens of a batch of texts are bits over the bytes of its UTF-8, packed 64 to a word, with the number
of ones before each block of words. The difference of two ranks is a text's number of tokens; a
select on the rank of a cut gives its byte. A second vector, of the starts of code points, turns
byte cuts into lengths. The vectors are built a mebibyte at a time, so that a very long text needs
a quarter of its size besides itself.

Null texts count as empty, and empty ones are plain. A null ``doc_id`` counts as an empty
one in the draw. Repeated rows get equal results, an empty table none, and other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, schema_of

#: 64-bit words of a block; bytes whose bits are set at once, a multiple of a block's.
WORDS, STRIDE = 8, 1 << 20
BLOCK = WORDS * 64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Bits:
    """Bits packed into words, and the number of ones before each block of them."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words.reshape(-1, WORDS)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, rest = np.divmod(at, BLOCK)
        whole, bit = np.divmod(rest, 64)
        row = self.words[np.minimum(block, len(self.words) - 1)]
        column = np.arange(WORDS)
        mask = np.where(column < whole[:, None], ~np.uint64(0), np.where(column == whole[:, None], (np.uint64(1) << bit.astype(np.uint64)[:, None]) - np.uint64(1), np.uint64(0)))
        return self.before[block] + np.bitwise_count(row & mask).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the one that has ``k`` ones before it."""
        block = np.searchsorted(self.before, k, side="right") - 1
        rest, row = k - self.before[block], self.words[block]
        upto = np.cumsum(np.bitwise_count(row), axis=1, dtype=np.int64)
        word = (upto <= rest[:, None]).sum(axis=1)
        i = np.arange(len(k))
        rest = rest - np.where(word > 0, upto[i, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(row[i, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * BLOCK + word * 64 + np.argmax(np.cumsum(bits, axis=1) > rest[:, None], axis=1)


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[Bits, Bits]:
    """Starts of tokens and of code points in the UTF-8 of texts that begin at ``starts``. One more bit stands at the end."""
    blocks = len(data) // BLOCK + 1
    tokens, points = np.zeros(blocks * WORDS, dtype=np.uint64), np.zeros(blocks * WORDS, dtype=np.uint64)
    for low in range(0, len(data) + 1, STRIDE):
        part = data[low : low + STRIDE]
        letter = _LETTER[part]
        follows = np.concatenate([[low > 0 and _LETTER[data[low - 1]]], letter[:-1]])[: len(part)]
        point = (part & 0xC0) != 0x80
        for words, bits in ((tokens, point & ~(letter & follows)), (points, point)):
            whole = np.zeros(min(STRIDE, blocks * BLOCK - low), dtype=bool)
            whole[: len(bits)] = bits
            if len(part) < STRIDE:
                whole[len(part)] = True
            if words is tokens:
                whole[starts[(starts >= low) & (starts < low + len(whole))] - low] = True
            words[low // 64 : (low + len(whole)) // 64] = np.packbits(whole, bitorder="little").view(np.uint64)
    return Bits(tokens), Bits(points)


def draws(doc_id: int | None, seed: str) -> list[int]:
    """The first four 8-digit groups of the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def filled_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """``doc_id``, the number ``n`` of tokens, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``, the training text.

    Texts that hold one of ``marks`` stay plain, so that a text can be rebuilt from its output by :func:`restored`.
    """
    before, after, middle = (m.encode() for m in marks)

    def each(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").fill_null("").cast(pa.binary())
        starts = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[starts[0] : starts[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        starts = starts - starts[0]
        tokens, points = boundaries(data, starts[:-1])
        first = tokens.rank(starts)
        n = np.diff(first)
        h = np.array([draws(i, seed) for i in batch.column("doc_id").to_pylist()], dtype=np.int64).reshape(-1, 4)
        a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        # The bit after a text's last is the next text's first one or the one at the end.
        one, two = (tokens.select(first[:-1] + k) for k in (np.minimum(a, b), np.maximum(a, b)))
        chars = points.rank(np.concatenate([starts[:-1], one, two])).reshape(3, -1)
        forms, outputs = [], []
        for i in range(len(texts)):
            text = data[starts[i] : starts[i + 1]].tobytes()
            if not text or h[i, 2] % 100 >= 100 - plain_percent or before in text or after in text or middle in text:
                forms.append("plain")
                outputs.append(text)
                continue
            x, y = one[i] - starts[i], two[i] - starts[i]
            spm = h[i, 3] % 100 < spm_percent
            forms.append("spm" if spm else "psm")
            outputs.append(b"".join((after, text[y:], before, text[:x], middle, text[x:y]) if spm else (before, text[:x], after, text[y:], middle, text[x:y])))
        plain = np.array([f == "plain" for f in forms], dtype=bool)
        binary = pa.array(outputs, type=pa.binary())
        # Spark's strings are bytes: they go back as they came.
        output = pa.Array.from_buffers(pa.string(), len(binary), binary.buffers(), offset=binary.offset)
        lengths = {c: pa.array(x, type=pa.int64(), mask=plain) for c, x in (("prefix_chars", chars[1] - chars[0]), ("middle_chars", chars[2] - chars[1]))}
        return {"doc_id": batch.column("doc_id"), "n": n, "form": forms, **lengths, "output": output}

    columns = "n long, form string, prefix_chars long, middle_chars long, output string"
    return map_batches(docs.select("doc_id", "text"), each, schema_of(docs, ("doc_id",), columns))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output of this form was made from."""
    one, two, three = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        head = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(head) + len(second) + 1)
        tail = F.substring_index(rest, three, 1)
        return head, tail, F.substr(rest, F.length(tail) + len(three) + 1)

    prefix, suffix, middle = parts(one, two)
    suffix2, prefix2, middle2 = parts(two, one)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def fim_digests(docs: DataFrame) -> DataFrame:
    """One row per document: tokens, form, lengths, and digests of the output and of the text rebuilt from it."""
    made = filled_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
