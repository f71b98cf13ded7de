"""Personal data, prefix tries and fill-in-middle against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import SMALL, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from weftline.llm import fim, pii, prefix_trie, queries

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# Fill-in-middle


def cut_brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest, n = sha(f"1:{'' if doc_id is None else doc_id}"), len(units)
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_cuts_are_brute_force(spark):
    odd = [(900 + i, t) for i, t in enumerate([None, "", "a", "<P>x", "<", "<<P", "é" * 700, "ab" * 600_000, "x<\nS>", "日本語 12", "\0a"])] + [(None, "abc def")] * 2 + [(1000 + i, "ab<" * i) for i in range(150)]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = sorted(map(tuple, fim.fim_digests(docs).collect()), key=str)
    assert got == sorted((cut_brute(*r) for r in docs.collect()), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_cuts_of_odd_tables(spark):
    docs = odd_docs(spark)
    got = sorted(map(tuple, fim.fim_digests(docs).collect()), key=str)
    assert got == sorted((cut_brute(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert fim.fim_digests(docs.limit(0)).collect() == []


@given(st.lists(st.integers(0, 40), min_size=1, max_size=200), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_rank_and_select(gaps, scale):
    ones = np.cumsum(np.array(gaps) * scale + 1)
    flags = np.zeros((ones[-1] // fim.BLOCK + 1) * fim.BLOCK, dtype=bool)
    flags[ones] = True
    bits = fim.Bits(np.packbits(flags, bitorder="little").view(np.uint64))
    assert (bits.select(np.arange(len(ones))) == ones).all()
    at = np.arange(len(flags))
    assert (bits.rank(at) == np.concatenate([[0], np.cumsum(flags)[:-1]])).all()


def test_bits_over_strides(monkeypatch):
    monkeypatch.setattr(fim, "STRIDE", 2 * fim.BLOCK)
    texts = ["ab é" * 301, "", "x" * 2047, "日 b", "q" * 1025]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    tokens, points = fim.boundaries(data, starts[:-1])
    assert np.diff(tokens.rank(starts)).tolist() == [len(re.findall("[A-Za-z]+|[^A-Za-z]", t)) for t in texts]
    assert np.diff(points.rank(starts)).tolist() == [len(t) for t in texts]


# Prefix trie


def trie_brute(rows, shared=True):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 if shared else 0 for c in own}
    paths = {c: tuple((own.get(c - int(math.fmod(c, 20)), [])[: h[c]] + own[c][h[c] :]) if shared else own[c]) for c in own}
    nodes, children = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below[p] = (int(not children[p]) + sum(below[q][0] for q in children[p]), saved + sum(below[q][1] for q in children[p]))
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children[p]), *below[p], sha(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p)))))) for p, m in nodes.items()), key=str)


def nodes_of(spark, rows, **how):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("depth", "part", "k", "f1", "my col")})
    return sorted(map(tuple, prefix_trie.conversation_trie(table, **how).collect()), key=str)


def test_trie_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, queries.op12_prefix_trie(spark, SMALL).collect()), key=str)
    assert got == trie_brute(rows)
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    assert sorted(db.sql(queries.ORACLES["op12_prefix_trie"]).fetchall(), key=str) == got


def test_trie_of_odd_turns(spark):
    """Nulls everywhere, repeated and tied rows, negative ids, absent hosts and conversations without a turn of their own."""
    rng = np.random.default_rng(4)
    pick = lambda options: options[rng.integers(len(options))]
    rows = [(pick([None, 0, 1, 2, 3, 20, 21, 22, 40, 61, -3, -25, 7]), pick([None, 1, 2, 3, 4, 5]), pick(["u", None, "a"]), pick(["x", "x y", None, "", "\xa0 b"])) for _ in range(200)]
    assert nodes_of(spark, rows, members_of=prefix_trie.with_shared_heads) == trie_brute(rows)
    assert nodes_of(spark, rows) == trie_brute(rows, shared=False)
    assert nodes_of(spark, []) == []


def test_collisions_are_split(spark):
    """A hash that takes all turns of one length for equal: verification must part what differs, at every depth."""
    rng = np.random.default_rng(9)
    rows = [(c, t, "ua"[rng.integers(2)], "xyz"[rng.integers(3)]) for c in range(50) for t in range(rng.integers(0, 6))]
    assert nodes_of(spark, rows, members_of=prefix_trie.with_shared_heads, hashed=lambda role, text: len(text)) == trie_brute(rows)


def test_long_conversations_reach_over_parts(spark, monkeypatch):
    """One conversation has most turns: its turns lie in several parts and chunks."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = [(5, i, "u", f"w {i % 7}") for i in range(700)] + [(6, i, "u", f"w {i % 7}") for i in range(300)] + [(c, i, "a", "z") for c in range(7, 12) for i in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.fingerprinted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert turns.where("conv_id = 5").select("part").distinct().count() > 1
        got = nodes_of(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 701 + 3
    assert {(r[1], r[3], r[5], r[6]) for r in got if r[0] == 5 and r[1] in (1, 300, 301, 700)} == {(1, 2, 1, 600), (300, 2, 1, 2), (301, 1, 1, 0), (700, 1, 1, 0)}


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checksum(digits):
    return sum(int(x) for i, c in enumerate(reversed(digits)) for x in str(int(c) * (1 + i % 2))) % 10 == 0


def base_brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and checksum(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


@given(st.lists(st.sampled_from(["1", "22", "255", "4", ".", ".", "@", "a", "b.c", "+", "+1", "(", ")", " ", "-", "é", "\n", "4111111111111111", "a@b.c", "12 34", "%", "٣"]), max_size=18).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_matches_are_the_patterns(text):
    assert sorted(pii.base_spans(text), key=lambda x: (x[0], pii.KINDS.index(x[2]))) == base_brute(text)


@pytest.fixture(scope="module")
def model():
    return pii.fitted([])


@pytest.mark.parametrize("region", ["4 1@a.b", "+1 2345678", "12.3.4.5678", "a@b.c@d"])
def test_decoding_and_sums_are_brute_force(region):
    """Best segmentation and likelihood against all segmentations of a small region, under random weights."""
    rng = np.random.default_rng(3)
    n, segments = pii.segments_of(region)
    names = {x: i for i, x in enumerate(sorted({x for *_, f in segments for x in f}))}
    w, after = rng.normal(size=len(names)), rng.normal(size=(pii.LABELS + 1, pii.LABELS))
    own = {(i, j, k): sum(w[names[x]] for x in f) for i, j, k, f in segments}

    def ways(at):
        if at == n:
            yield ()
        for s in own:
            if s[0] == at:
                yield from ((s, *rest) for rest in ways(s[1]))

    def score(way):
        return sum(own[s] for s in way) + sum(after[a, b] for a, b in itertools.pairwise([pii.LABELS, *(s[2] for s in way)]))

    scores = {way: score(way) for way in ways(0)}
    best = max(scores, key=scores.get)
    tokens = pii.cut(region)
    assert pii.Model({x: w[i] for x, i in names.items()}, after).best(region) == [(tokens[i][0], tokens[j - 1][1], pii.KINDS[k - 1]) for i, j, k in best if k]
    total = math.log(sum(math.exp(x) for x in scores.values()))
    for way in list(scores)[:5]:
        value, push, steps = pii.likelihood(n, [(i, j, k, np.array([names[x] for x in f])) for i, j, k, f in segments], set(way), w, after)
        assert abs(value - (scores[way] - total)) < 1e-9
        share = Counter()
        for other, x in scores.items():
            for s in other:
                share[s] += math.exp(x - total)
        assert np.allclose(push, [(s[:3] in way) - share[s[:3]] for s in segments])
        assert abs(steps.sum() - (len(way) - sum(len(o) * math.exp(x - total) for o, x in scores.items()))) < 1e-9


def test_touching_entities_are_parted(model):
    card = "4111 1111 1111 1111"
    text = f"call +1 (376) 555-1700 {card} or 10.0.0.1 4111111111111111 99 today"
    found = {(text[s:e], k) for s, e, k, _ in pii.spans_in(text, model)}
    assert {("+1 (376) 555-1700", "phone"), (card, "card"), ("10.0.0.1", "ip")} <= found


@pytest.mark.parametrize("text", ["In 2023 we sold 1234567 of them at 12.50 each, 2023-04-05.", "x@y and @name", "4111111111111112", "999.1.1.1", "version 1.2.3", ""])
def test_clean_texts_stay_clean(model, text):
    assert pii.spans_in(text, model) == []


def test_base_spans_stay_and_others_touch_none(spark):
    docs = odd_docs(spark).unionByName(odd_docs(spark).limit(1).withColumn("text", F.lit("a@b.org +1 (376) 555-1700 4111111111111111 10.2.3.4")))
    made = pii.pii_digests(docs.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet"), allowMissingColumns=True)).collect()
    texts = Counter(r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()) + Counter(r.text for r in docs.collect())
    want = Counter()
    for t, n in texts.items():
        base = base_brute(t)
        want[(*(sum(k == x for *_, k in base) for x in pii.KINDS), sha(",".join(f"{k}:{s}:{e}" for s, e, k in base)))] += n
    assert Counter((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in made) == want
    added = sum(len(r.spans.split(",")) - r.n_email - r.n_ip - r.n_card - r.n_phone for r in made if r.spans)
    assert added >= 2
    assert pii.pii_digests(docs.limit(0)).collect() == []
    hidden = pii.masked(docs.where("doc_id = 1")).first().text
    assert hidden.startswith("The river") or "[email] [phone] [card] [ip]" in hidden
