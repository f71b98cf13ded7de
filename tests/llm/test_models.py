"""Fitted operators: Katz against brute force, classifiers by held-out accuracy, neighbours by recall, and the pipeline stage by stage."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import MIDDLE, SMALL, classes, remainder, shingles, words
from pyspark.sql import functions as F
from weftline.llm import katz, neighbours, quality_gbt, quality_rules, queries, toxicity


def katz_by_hand(texts):
    """A dict-based model: (log10 score by doc, probability of a word after a history, vocabulary)."""
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    train = [i for i in texts if remainder(i, 7) != 2]
    c1 = Counter(w for i in train for w in tokens[i])
    c2 = Counter(p for i in train for p in zip(["<s>", *tokens[i][:-1]], tokens[i]))
    n, v = sum(c1.values()), len(c1)
    f1, f2 = (katz.discounts([sum(x == r for x in c.values()) for r in range(1, 7)]) for c in (c1, c2))
    factor = lambda f, r: f[r] if r <= 5 else 1.0
    kept = sum(factor(f1, r) * r for r in c1.values())
    whole = n if kept < n else n + 1
    p1 = lambda w: factor(f1, c1[w]) * c1[w] / whole if w in c1 else 1 - kept / whole
    after = defaultdict(dict)
    for (h, w), r in c2.items():
        after[h][w] = r

    def p2(w, h):
        if h not in after:
            return p1(w)
        seen = after[h]
        total = sum(seen.values())
        freed = total - sum(factor(f2, r) * r for r in seen.values())
        free = freed > 1e-12
        whole = total + (not free)
        if w in seen:
            return factor(f2, seen[w]) * seen[w] / whole
        return (freed if free else 1) / whole / (1 - sum(map(p1, seen))) * p1(w)

    scores = {i: sum(math.log10(p2(w, h)) for h, w in zip(["<s>", *t[:-1]], t)) for i, t in tokens.items()}
    base = {i: sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t) for i, t in tokens.items()}
    known = {i: sum(w in c1 for w in t) for i, t in tokens.items()}
    return scores, base, known, n, p2, list(c1), list(after)


@pytest.mark.parametrize("small", [False, True])
def test_katz_is_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and buckets, histories spread over them
        monkeypatch.setattr(katz, "BLOCK_BYTES", 20_000)
        monkeypatch.setattr(katz, "BUCKET_TOKENS", 5_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    scores, base, known, n, p2, vocabulary, histories = katz_by_hand(texts)
    got = {r.doc_id: r for r in katz.katz_scores(docs).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i, 7) == 2, len(words(texts[i])) + 1, known[i], n)
        assert r.base_score == pytest.approx(base[i], rel=1e-9) and r.score == pytest.approx(scores[i], rel=1e-6)
    for h in histories[:: max(1, len(histories) // 25)]:
        assert sum(p2(w, h) for w in vocabulary) + p2("no such word", h) == pytest.approx(1, abs=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def accuracy(spark, name, label):
    rows = queries.QUERIES[name](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", label), "doc_id").where("held_out").select("predicted", label, "score").collect()
    assert len(rows) > 30
    good, bad = [r.score for r in rows if r[label] == 1], [r.score for r in rows if r[label] == 0]
    auc = float(np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]))
    return auc, sum(r.predicted == r[label] for r in rows) / len(rows)


# The small table has 51 toxic rows, three without any toxic word: their order tells little more than the verdicts.
@pytest.mark.parametrize(("name", "label", "least_auc"), [("op3_quality_gbt", "quality", 0.95), ("op10_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least_auc):
    auc, right = accuracy(spark, name, label)
    assert auc >= least_auc and right >= 0.9


def test_toxic_text_survives_noisy_labels_and_has_rare_words_and_phrases(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i:02d}" for i in range(40)]
    texts = [(list(rng.choice(words, 30)), int(i < 600)) for i in range(4000)]
    for i in range(180):
        texts[i][0].append("zorblat")
    for i in range(190, 202):
        texts[i][0].append("frimp")  # 2% of the toxic rows
    for i in range(300, 500):
        texts[i][0].extend(["qua", "bex"])
    for i in range(600, 4000):  # both words are as common in ordinary rows, but never side by side
        texts[i][0][:0], texts[i][0][15:15] = (["qua"], ["bex"]) if i % 3 == 0 else ([], [])
    for i in range(600, 605):
        texts[i][0].append("zorblat")  # quoted, or labelled wrongly
    rows = spark.createDataFrame([(" ".join(ws), y) for ws, y in texts], "text string, _label int")
    found = toxicity.toxic_text(rows)
    assert {b"zorblat", b"frimp"} <= set(found.split()) and b"qua bex" in found


def test_copies_of_a_toxic_text_are_one_piece_of_evidence(spark):
    rng = np.random.default_rng(6)
    plain = [(" ".join(rng.choice([f"w{i}" for i in range(40)], 30)), int(i < 100)) for i in range(800)]
    copied = " ".join(f"rare{i}" for i in range(30))
    rows = spark.createDataFrame(plain + [(copied, 1)] * 40, "text string, _label int")
    assert b"rare" not in toxicity.toxic_text(rows)


def test_sampled_windows_reach_the_end_of_a_text(spark):
    text = " ".join(f"a{i:03d}" for i in range(toxicity.WINDOW * (2 * toxicity.WINDOWS_EACH - 1)))
    taken = toxicity.spread(toxicity.windows(toxicity.words_of(text)))
    assert len(taken) == toxicity.WINDOWS_EACH and taken[-1] in toxicity.windows(toxicity.words_of(text))[-2:]


def test_forest_splits_and_is_flat():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] < -0.3)).astype(float)
    forest = quality_gbt.fit_forest(x[:400], y[:400])
    assert ((forest.score(x[400:]) > 0.5) == y[400:]).mean() > 0.93
    one = forest.score(x[400:401])[0]
    total = forest.start
    for root in forest.roots:
        at = root
        while forest.left[at] != at:
            at = forest.left[at] + (x[400, forest.column[at]] > forest.cut[at])
        total += forest.value[at]
    assert one == pytest.approx(1 / (1 + math.exp(-total)))


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    votes = np.where(rng.random((20_000, 4)) < 0.85, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None]) * (rng.random((20_000, 4)) < 0.7)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    odds, prior = quality_rules.fit(patterns.astype(float), counts.astype(float))
    verdict = quality_rules.posterior(votes.astype(float), odds, prior) >= 0.5
    assert (verdict == truth).mean() > 0.9


def test_verdicts_are_a_plain_expectation_maximisation(spark):
    """One document at a time, with three-valued votes by class."""
    from weftline.llm.textstats import with_stats

    voted = quality_rules.votes_of(with_stats(spark.read.parquet(f"{SMALL}/documents.parquet"))).collect()
    names = list(quality_rules.rules())
    votes = {r.doc_id: [r[f"vote_{n}"] for n in names] for r in voted}
    good = {i: 0.15 if -1 in v else 0.85 for i, v in votes.items()}
    for _ in range(300):
        odds = []
        for k in range(len(names)):
            of = {}
            for value in (-1, 0, 1):
                hit = [i for i, v in votes.items() if v[k] == value]
                sure = (sum(good[i] for i in hit) + 0.5) / (sum(good.values()) + 1.5)
                bad = (sum(1 - good[i] for i in hit) + 0.5) / (sum(1 - g for g in good.values()) + 1.5)
                of[value] = math.log(sure / bad)
            odds.append({-1: min(of[-1], 0), 0: of[0], 1: max(of[1], 0)})
        share = min(max(sum(good.values()) / len(good), 0.05), 0.99)
        after = {i: 1 / (1 + math.exp(-math.log(share / (1 - share)) - sum(o[x] for o, x in zip(odds, v, strict=True)))) for i, v in votes.items()}
        moved, good = max(abs(after[i] - good[i]) for i in good), after
        if moved < 1e-10:
            break
    for r in quality_rules.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet")).collect():
        assert r.p_good == pytest.approx(good[r.doc_id], abs=1e-6) and r.kept == (not r.base_failed and good[r.doc_id] >= 0.5)


def test_scores_are_a_walk_of_each_tree(spark):
    from weftline.llm.textstats import with_stats

    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    stats = with_stats(docs)
    held = quality_gbt.remainder_of_id("doc_id", 5) == 0
    forest = quality_gbt.trained(stats, labels, "quality", held, 20_000)
    got = {r.doc_id: r.score for r in quality_gbt.quality_scores(docs, labels).collect()}
    for r in stats.collect():
        x = quality_gbt.features(np.array([[r[c] for c in quality_gbt.INPUTS]]))[0]
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] + int(x[forest.column[node]] > forest.cut[node])
            total += forest.value[node]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)))


def test_neighbour_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in queries.op2_neighbours(spark, MIDDLE).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[k]
        best = [int(j) for j in np.lexsort((ids, -s)) if j != k][:5]
        found = got[int(ids[k])]
        hits, total = hits + len({ids[j] for j in best} & {i for i, _ in found}), total + 5
        assert all(score == pytest.approx(s[np.flatnonzero(ids == i)[0]], abs=1e-12) for i, score in found)
    assert hits / total >= 0.95


def test_recall_of_shards(spark, monkeypatch):
    """Several shards of many vectors; brute force knows the nearest."""
    monkeypatch.setattr(neighbours, "SHARD", 700)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 24)) + 2 * rng.normal(size=(20, 24))[rng.integers(0, 20, 2000)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest_neighbours(table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {(q, int(j)) for q in range(0, 2000, 50) for j in np.argsort(-np.where(np.arange(2000) == q, -9, unit @ unit[q]))[:5]}
    assert len(got) == 200 and len(got & best) / len(best) >= 0.95


@pytest.mark.parametrize(("n", "centres", "noise"), [(8192, 0, 1.0), (4096, 40, 0.02), (8192, 200, 0.05)])
def test_recall_of_full_and_clustered_graphs(n, centres, noise):
    rng = np.random.default_rng(n + centres)
    v = noise * rng.normal(size=(n, 64))
    if centres:
        c = rng.normal(size=(centres, 64))
        v += (c / np.linalg.norm(c, axis=1, keepdims=True))[rng.integers(0, centres, n)]
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    levels = neighbours.build(v)
    assert neighbours._reached(levels[0]).all()
    asked = v[:: n // 200]
    found = neighbours.search(v, levels, asked)
    exact = np.argsort(-(asked @ v.T), axis=1)[:, :6]
    assert np.mean([len(set(f[:6]) & set(e)) / 6 for f, e in zip(found, exact, strict=True)]) >= 0.97


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "near_dedup", "secret_scan", "packing"]
    kept = docs.orderBy("doc_id")
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        rows = stage(spark, kept, SMALL).collect()
        after = {r.doc_id: r for r in rows}
        assert len(rows) == len(after) and after.keys() <= before.keys() and rows[0].__fields__ == docs.columns
        if name == "quality_rules":
            keeps = {r.doc_id for r in quality_rules.quality_rules(kept).where("kept").collect()}
        elif name == "quality_classifier":
            keeps = {r.doc_id for r in quality_gbt.quality_scores(kept, labels).where("predicted = 1").collect()}
        elif name == "near_dedup":
            keeps = {i for i, c in classes({i: shingles(r.text, 5) for i, r in before.items()}, 80).items() if i == c}
        else:
            keeps = before.keys()
            assert any(after[i].text != before[i].text for i in keeps)
        assert after.keys() == keeps
        kept = spark.createDataFrame([tuple(r) for r in rows], docs.schema)
    pieces = pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    total = pieces.agg(F.sum("length")).first()[0]
    assert total == pipeline.run(spark, SMALL).agg(F.sum("length")).first()[0]
