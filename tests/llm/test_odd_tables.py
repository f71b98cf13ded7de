"""Every operator over odd and empty tables: a row for each row, with the defined result."""

import pytest
from helpers import odd_docs
from pyspark.sql import functions as F
from weftline.llm import bpe, hilbert, katz, near_dedup, neighbours, packing, quality_gbt, quality_rules, secrets, toxicity


@pytest.fixture(scope="module")
def odd(spark):
    return odd_docs(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, 1), (2, 0, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("own"))


def per_row(labels):
    return {
        "rules": quality_rules.quality_rules,
        "gbt": lambda d: quality_gbt.quality_scores(d, labels),
        "toxicity": lambda d: toxicity.toxicity_scores(d, labels),
        "secrets": secrets.secret_digests,
        "hilbert": hilbert.hilbert_shards,
        "katz": katz.katz_scores,
        "bpe": bpe.round_trips,
        "dedup": near_dedup.near_duplicates,
    }


@pytest.mark.parametrize("name", ["rules", "gbt", "toxicity", "secrets", "hilbert", "katz", "bpe", "dedup"])
def test_a_row_for_each_row(spark, odd, labels, name):
    run = per_row(labels)[name]
    got = run(odd).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r.doc_id for r in odd.select("doc_id").collect()), key=str)
    assert run(odd.limit(0)).count() == 0
    of = {r.doc_id: r for r in got}
    if name == "rules":
        assert [of[i].n_words for i in (3, 4, 5, 7)] == [0, 0, 0, 1] and of[4].base_failed and of[6].base_failed and of[6].n_repeat_words == 60_000 and of[8].word_chars == 200_000
    if name in ("gbt", "toxicity"):
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.3 if name == "gbt" else 0.7)) and r.held_out is not None for r in got)
        assert of[3].score == of[4].score
    if name == "secrets":
        assert (of[9].n_assign, of[9].n_access, of[9].n_hex) == (1, 1, 1) and of[3].spans == of[4].spans == ""
        assert of[None].n_assign in (0, 1) and sum(r.n_assign for r in got) == 2
    if name == "katz":
        assert [of[i].n_tokens for i in (3, 4, 5, 6, 7)] == [1, 1, 1, 60_001, 2] and not of[None].held_out
    if name == "dedup":
        assert [of[i].component_id for i in (1, 2, 3, 4, 5)] == [1, 1, 3, 4, 5] and all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_packing_holds_every_token(spark, odd):
    got = packing.packed(odd).collect()
    ends = {r.doc_id: r for r in got}
    assert ends[3].length == ends[4].length == 1
    assert sum(r.length for r in got if r.doc_id == 6) == next(r.doc_tokens for r in got if r.doc_id == 6)
    assert packing.packed(odd.limit(0)).count() == 0


def test_stages_keep_columns(spark, odd, labels):
    whole = odd.count()
    for stage in (quality_rules.passed, lambda d: quality_gbt.accepted(d, labels), near_dedup.deduplicated, secrets.redacted):
        got = stage(odd)
        assert got.schema.names == odd.schema.names
        rows = got.collect()
        assert len(rows) <= whole and all(r.secret_spans == "own" and r["_place"] == "own" and r["_row"] == "own" for r in rows)
        assert stage(odd.limit(0)).count() == 0
    assert sorted((r.doc_id for r in near_dedup.deduplicated(odd).collect()), key=str) == [1, 3, 4, 5, 6, 7, 8, 9, None, None]
    assert {r.doc_id: r.text for r in secrets.redacted(odd).collect()}[9].endswith("\U0001f600 [assign] [access] [hex]")


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [1.0, 1.0, 1.0]), (100, [-1.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("own")).withColumn("score", F.lit("own"))
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest_neighbours(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 3), (0, 5, 100), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3), (50, 5, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 3), (100, 5, 50)]
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd, labels, tmp_path):
    """From stage to stage, over all odd rows and over none, as ``run`` reads them."""
    import corpus_pipeline as pipeline

    for name, docs in (("odd", odd.where("doc_id is not null or text is not null")), ("none", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        pieces = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert name == "odd" or not pieces
        assert {p.doc_id for p in pieces} <= {1, 2, 9, None} and all(0 < p.length <= 1024 for p in pieces)


def test_distinct_texts_of_one_id_stay(spark):
    """Only equal or near-equal texts are one document, whatever their ids."""
    from weftline.llm import near_dedup

    prose = "the river runs past the old mill and the children walk along it to the school every morning before the bell rings"
    other = "a market opens at dawn where farmers bring apples pears onions and cheese from the hills around our quiet town"
    rows = [(1, prose, "a"), (1, other, "a"), (1, other, "b"), (2, prose, "c"), (3, other + " again", "d"), (4, None, "e"), (4, "", "f"), (5, "x", "g"), (5, "x", "g")]
    kept = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    texts = sorted(str(r.text) for r in kept)
    assert texts == sorted([prose, next(t for t in texts if t.startswith("a market")), "None", "", "x"])
    assert sum(r.doc_id == 5 for r in kept) == 1
