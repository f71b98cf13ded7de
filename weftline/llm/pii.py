"""Personal data by a semi-Markov conditional random field over base patterns.

The base patterns of four kinds are matched first, in time linear in the text. They fail where
entities touch: a phone number followed by a card number is one match with too many digits. So
every region, a run of words with digits or ``@`` parted by single spaces, is also cut into segments
by a model that scores whole spans: number and grouping of digits, check digit, ranges of parts, shape, and what
stands beside the span. An entity has at most ``MOST_TOKENS`` tokens, and dynamic programming over
ends of segments and kinds chooses all boundaries and types of a region together. Decoded spans
that touch no base span are added; base spans stay.

The model is a log-linear one over segmentations, trained here with forward and backward sums. Its examples
are regions whose base spans are beyond doubt, from the texts of least hash (at most ``max_rows``
documents and ``max_regions`` regions: a bounded sample; matching and decoding cover all texts), and rows of such entities
and of numbers that are none, joined in a fixed random order.

Positions are code points, ends exclusive. Null texts count as empty; texts without digits
and ``@`` have no spans. Very long texts are searched whole. Rows that repeat, or lack an id, are each
searched by themselves; an empty table gives an empty result. Other columns are ignored or carried on, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, schema_of

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity: nineteen digits, each after a space or hyphen, and some more.
MOST_TOKENS = 40
#: Digits of a number worth a look.
LEAST_DIGITS = 7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_REGION = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_MAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")

Span = tuple[int, int, str]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts double."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match starts where the run of local characters before an ``@`` does, or where the last match ends."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in address.split("."))


def base_matches(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """Leftmost matches of each kind that don't overlap, and whether they pass."""
    if "@" in text:
        for s, e in _emails(text):
            yield s, e, "email", True
    for m in _IP.finditer(text):
        yield m.start(), m.end(), "ip", _small_parts(m[0])
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = digits_of(m[0])
            yield m.start(), m.end(), "card", 12 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield m.start(), m.end(), "phone", 9 <= len(digits_of(m[0])) <= 15


def base_spans(text: str) -> list[Span]:
    return [(s, e, k) for s, e, k, passes in base_matches(text) if passes]


def _beside(c: str) -> str:
    return "edge" if not c or c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in ".,@+-()" else "mark"


def span_features(text: str, start: int, end: int) -> list[str]:
    """What a span looks like as a whole, and what stands beside it."""
    span = text[start:end]
    out = ["left " + _beside(text[start - 1 : start]), "right " + _beside(text[end : end + 1])]
    if "@" in span:
        return [*out, "mail", f"mail shape {bool(_MAIL.fullmatch(span))}", f"mail dots {min(span.count('.'), 4)}"]
    d = digits_of(span)
    groups = [len(x) for x in re.findall("[0-9]+", span)]
    parts = span.split(".")
    return [
        *out,
        f"digits {len(d)}",
        f"check {12 <= len(d) <= 19 and luhn(d)}",
        f"parts {len(parts) == 4 and all(p.isdigit() for p in parts) and _small_parts(span)}",
        f"first {span[0] if span[0] in '+(' else 'digit'}",
        f"round {'(' in span} {span.count('(') == span.count(')')}",
        "between " + "".join(sorted(set(span) & set(" .-"))),
        f"groups {min(len(groups), 6)}",
        f"spread {min(groups) == max(groups)} {max(groups) > 4}",
    ]


def cut(region: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(region)]


def candidates(region: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """Spans of tokens that may be entities, and the kinds they may be of."""
    for i, (start, _) in enumerate(tokens):
        c = region[start]
        number, mail = c in "+(" or "0" <= c <= "9", c.isalnum() and c.isascii()
        digits = ats = 0
        for j in range(i, min(i + MOST_TOKENS, len(tokens))):
            s, e = tokens[j]
            c = region[s]
            digit = "0" <= c <= "9"
            digits += (e - s) * digit
            ats += c == "@"
            number = number and (digit or c in "+(). -") and digits <= 19 and not (c == "+" and j > i)
            mail = mail and (c in _LOCAL or c == "@") and ats <= 1
            if not number and not mail:
                break
            if number and digit and digits >= LEAST_DIGITS:
                yield i, j + 1, ("ip", "card", "phone")
            if mail and ats == 1 and c != "@" and c.isalnum():
                yield i, j + 1, ("email",)


def outside_features(region: str, start: int, end: int) -> list[str]:
    c = region[start]
    return ["out", f"out digits {min(end - start, 20)}" if "0" <= c <= "9" else "out letters" if c.isalpha() else f"out {c if c in '@+.-() ' else 'mark'}"]


#: A segment: first token, token after the last, label (0: outside, else the kind's number from 1), features.
Segment = tuple[int, int, int, list]
LABELS = 1 + len(KINDS)


def segments_of(region: str) -> tuple[int, list[Segment]]:
    tokens = cut(region)
    out = [(i, i + 1, 0, outside_features(region, s, e)) for i, (s, e) in enumerate(tokens)]
    for i, j, kinds in candidates(region, tokens):
        seen = span_features(region, tokens[i][0], tokens[j - 1][1])
        out += [(i, j, 1 + KINDS.index(k), [f"{k} {x}" for x in ("entity", *seen)]) for k in kinds]
    return len(tokens), out


@dataclass
class Model:
    """Weights by feature, and of each label after each (the last row: at the start)."""

    weights: dict[str, float]
    after: np.ndarray

    def best(self, region: str) -> list[tuple[int, int, str]]:
        """Spans of the segmentation of largest score; of equal ones that with more outside."""
        n, segments = segments_of(region)
        tokens = cut(region)
        top = np.full((n + 1, LABELS), -np.inf)
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for i, j, label, names in sorted(segments, key=lambda s: (s[1], s[2])):
            own = sum(self.weights.get(x, 0.0) for x in names)
            before = self.after[LABELS, label] if i == 0 else top[i] + self.after[:LABELS, label]
            previous = int(np.argmax(before)) if i else LABELS
            score = own + (before if i == 0 else before[previous])
            if score > top[j, label]:
                top[j, label] = score
                back[j, label] = (i, previous)
        out, at, label = [], n, int(np.argmax(top[n]))
        while at:
            i, previous = back[at, label]
            if label:
                out.append((tokens[i][0], tokens[at - 1][1], KINDS[label - 1]))
            at, label = i, previous
        return out[::-1]


def _added(x: np.ndarray, axis=None) -> np.ndarray:
    """Logarithm of the sum of exponentials."""
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis=axis) + np.log(np.sum(np.exp(x - top), axis=axis))


def likelihood(n: int, segments: list[tuple[int, int, int, np.ndarray]], gold: set[tuple[int, int, int]], w: np.ndarray, after: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the gold segmentation among all; what to add along features of each segment and along ``after`` to raise it."""
    own = np.array([w[f].sum() for *_, f in segments])
    ahead, behind = np.full((n + 1, LABELS), -np.inf), np.full((n + 1, LABELS), -np.inf)
    order = sorted(range(len(segments)), key=lambda s: segments[s][1])
    entry = np.full(len(segments), -np.inf)
    for s in order:
        i, j, label, _ = segments[s]
        entry[s] = after[LABELS, label] if i == 0 else _added(ahead[i] + after[:LABELS, label])
        ahead[j, label] = np.logaddexp(ahead[j, label], entry[s] + own[s])
    behind[n] = 0.0
    for s in sorted(range(len(segments)), key=lambda s: -segments[s][0]):
        i, j, label, _ = segments[s]
        if i:
            behind[i] = np.logaddexp(behind[i], after[:LABELS, label] + own[s] + behind[j, label])
    total = _added(ahead[n])
    push, steps = np.empty(len(segments)), np.zeros_like(after)
    taken = {j: label for _, j, label in gold}
    score = 0.0
    for s, (i, j, label, _) in enumerate(segments):
        held = (i, j, label) in gold
        push[s] = held - np.exp(entry[s] + own[s] + behind[j, label] - total)
        tail = own[s] + behind[j, label] - total
        if i:
            steps[:LABELS, label] -= np.exp(ahead[i] + after[:LABELS, label] + tail)
        else:
            steps[LABELS, label] -= np.exp(after[LABELS, label] + tail)
        if held:
            previous = taken[i] if i else LABELS
            steps[previous, label] += 1
            score += own[s] + after[previous, label]
    return score - total, push, steps


def gold_segments(region: str, spans: list[Span]) -> set[tuple[int, int, int]] | None:
    """Segments that the spans make of a region; None where they overlap or cut through a token."""
    tokens = cut(region)
    starts, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
    out, at = set(), 0
    for s, e, kind in sorted(spans):
        i, j = starts.get(s, -1), ends.get(e, -1)
        if i < at or j <= i or j - i > MOST_TOKENS:
            return None
        out |= {(x, x + 1, 0) for x in range(at, i)} | {(i, j, 1 + KINDS.index(kind))}
        at = j
    return out | {(x, x + 1, 0) for x in range(at, len(tokens))}


def clear_regions(text: str) -> Iterator[tuple[str, list[Span]]]:
    """Regions in which no match failed for want or excess of digits, with their base spans."""
    found = list(base_matches(text))
    for m in _REGION.finditer(text):
        inside = [(s, e, k, ok) for s, e, k, ok in found if s < m.end() and e > m.start()]
        doubtful = any(not ok and (k == "phone" or k == "card" and len(digits_of(text[s:e])) > 19) or s < m.start() or e > m.end() for s, e, k, ok in inside)
        if not doubtful and (inside or len(digits_of(m[0])) >= LEAST_DIGITS):
            yield m[0], [(s - m.start(), e - m.start(), k) for s, e, k, ok in inside if ok]


def _number(rng: np.random.Generator, digits: int) -> str:
    return "".join(map(str, rng.integers(0, 10, digits)))


def _made(rng: np.random.Generator, kind: str) -> str:
    """An entity of the kind, or with kind "" a number that is none."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    if kind == "email":
        return word(int(rng.integers(2, 9))) + pick("", "." + _number(rng, 2), "_" + word(4)) + "@" + word(5) + pick("", _number(rng, 1)) + "." + pick("com", "org", "example.com", "co.uk")
    if kind == "ip":
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
    if kind == "card":
        body = pick("4", "5", "3") + _number(rng, pick(14, 14, 14, 13, 12, 17))
        full = body + next(c for c in "0123456789" if luhn(body + c))
        sep = pick("", "", " ", "-")
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4)) if sep else full
    if kind == "phone":
        a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        return pick(f"+{pick('1', '44', '49')} ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+49 {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}")
    n = int(rng.integers(1, 21))
    number = _number(rng, n)
    if 12 <= n <= 19 and luhn(number):
        number = number[:-1] + str((int(number[-1]) + 1) % 10)
    return pick(number, number, ".".join((_number(rng, 1), _number(rng, 2))), "-".join(("20" + _number(rng, 2), _number(rng, 2), _number(rng, 2))), word(3) + _number(rng, 2), word(3) + "@" + word(3), "@" + word(5))


def _joined(rng: np.random.Generator, known: dict[str, list[str]]) -> tuple[str, list[Span]]:
    """One to three entities or numbers with single spaces between, and the entities' spans."""
    text, spans = "", []
    for _ in range(int(rng.integers(1, 4))):
        kind = ("", "", *KINDS)[int(rng.integers(6))]
        pool = known.get(kind, [])
        piece = pool[int(rng.integers(len(pool)))] if pool and rng.random() < 0.5 else _made(rng, kind)
        text += " " if text else ""
        if kind:
            spans.append((len(text), len(text) + len(piece), kind))
        text += piece
    return text, spans


def fitted(regions: list[tuple[str, list[Span]]], joined: int = 900, rounds: int = 4, rate: float = 0.3, pull: float = 1e-4, seed: int = 1) -> Model:
    """The model of largest likelihood, by adaptive gradient steps, of the regions and of ``joined`` rows of entities and numbers."""
    rng = np.random.default_rng(seed)
    known: dict[str, list[str]] = {}
    for text, spans in regions:
        for s, e, k in spans:
            known.setdefault(k, []).append(text[s:e])
    number: dict[str, int] = {}
    examples = []
    for text, spans in [*regions, *(_joined(rng, known) for _ in range(joined))]:
        n, segments = segments_of(text)
        gold = gold_segments(text, spans)
        if gold and gold <= {(i, j, label) for i, j, label, _ in segments}:
            examples.append((n, [(i, j, label, np.array([number.setdefault(x, len(number)) for x in f])) for i, j, label, f in segments], gold))
    w, after = np.zeros(len(number)), np.zeros((LABELS + 1, LABELS))
    seen, seen_after = np.full(len(w), 1e-2), np.full(after.shape, 1e-2)
    for _ in range(rounds):
        for x in rng.permutation(len(examples)):
            n, segments, gold = examples[x]
            _, push, steps = likelihood(n, segments, gold, w, after)
            moved = np.concatenate([f for *_, f in segments])
            g = np.zeros(len(w))
            np.add.at(g, moved, np.repeat(push, [len(f) for *_, f in segments]))
            g -= pull * w
            seen += g * g
            w += rate * g / np.sqrt(seen)
            seen_after += steps * steps
            after += rate * steps / np.sqrt(seen_after)
    return Model({x: float(w[i]) for x, i in number.items()}, after)


def trained(docs: DataFrame, max_rows: int = 20_000, max_regions: int = 900) -> Model:
    """A model from at most ``max_rows`` documents (give or take their square root) and ``max_regions`` regions of them, those of least hash."""
    key = F.xxhash64("text")
    n, scale = docs.count(), 1 << 30
    sample = docs.select("text").where(F.col("text").rlike("[0-9@]"))
    if n > max_rows:
        sample = sample.where(F.pmod(key, F.lit(scale)) < int(scale * max_rows / n))

    def each(b: pa.RecordBatch) -> dict:
        rows = [(r, [{"start": s, "end": e, "kind": k} for s, e, k in spans]) for t in b.column("text").to_pylist() for r, spans in clear_regions(t) if len(r) <= 400]
        return {"region": [r for r, _ in rows], "spans": [s for _, s in rows]}

    found = map_batches(sample, each, "region string, spans array<struct<start:int,end:int,kind:string>>").distinct()
    rows = found.orderBy(F.xxhash64("region"), "region").limit(max_regions).collect()
    return fitted([(r.region, [(s.start, s.end, s.kind) for s in r.spans]) for r in rows])


def spans_in(text: str, model: Model) -> list[tuple[int, int, str, bool]]:
    """All spans of a text: those of the base, and the model's that touch none of them."""
    base = base_spans(text)
    out = [(s, e, k, True) for s, e, k in base]
    base.sort()
    at = 0
    for m in _REGION.finditer(text):
        if "@" not in m[0] and len(digits_of(m[0])) < LEAST_DIGITS:
            continue
        while at < len(base) and base[at][0] < m.start() and all(e <= m.start() for _, e, _ in base[at : at + 4]):
            at += 1
        near = [(s, e) for s, e, _ in _until(base, max(0, at - 4), m.end())]
        for s, e, k in model.best(m[0]):
            s, e = s + m.start(), e + m.start()
            if not any(s < y and x < e for x, y in near):
                out.append((s, e, k, False))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _until(base: list[Span], first: int, end: int) -> Iterator[Span]:
    for i in range(first, len(base)):
        if base[i][0] >= end:
            return
        yield base[i]


def _mapped(docs: DataFrame, columns: tuple[str, ...], more: str, each_text: Callable[[str], object], name: str) -> DataFrame:
    def each(b: pa.RecordBatch) -> dict:
        return {c: b.column(c) for c in columns} | {name: [each_text(t or "") for t in b.column("text").to_pylist()]}

    return map_batches(docs.select("text", *columns), each, schema_of(docs, columns, more))


def personal_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id`` and ``pii_spans``: structs of start, end, kind and whether a base pattern matched, by start and kind."""
    model = model or trained(docs)
    found = lambda t: [{"start": s, "end": e, "kind": k, "base": b} for s, e, k, b in spans_in(t, model)]
    return _mapped(docs, ("doc_id",), "pii_spans array<struct<start:int,end:int,kind:string,base:boolean>>", found, "pii_spans")


def masked(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id`` and ``text`` with each span replaced by ``[kind]``; what overlaps becomes one."""
    model = model or trained(docs)

    def each_text(text: str) -> str:
        out, at = [], 0
        for s, e, k, _ in spans_in(text, model):
            if s >= at:
                out += [text[at:s], f"[{k}]"]
            at = max(at, e)
        return "".join((*out, text[at:]))

    return _mapped(docs, ("doc_id",), "masked string", each_text, "masked").withColumnRenamed("masked", "text")


def pii_digests(docs: DataFrame) -> DataFrame:
    """One row per document: base matches of each kind, a digest of the base spans, and all spans."""
    rows = personal_spans(docs)
    base = F.filter("pii_spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *(number(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
