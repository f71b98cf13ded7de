"""How many Python workers an executor needs, and what goes to them: both stay in its memory for the stages that follow."""

import json

from helpers import SMALL, odd_docs
from pyspark.sql import SparkSession
from weftline.llm import packing, quality_gbt, quality_rules


def python_steps(df):
    """Of the optimized plan: each step that sends rows to Python, with the columns that it sends."""
    nodes = json.loads(df._jdf.queryExecution().optimizedPlan().toJSON())
    return [nodes[i + 1].get("projectList", nodes[i + 1].get("output")) for i, n in enumerate(nodes) if n["class"].endswith("MapInArrow")]


def fields_named(tree, name):
    if isinstance(tree, dict):
        return (tree.get("class", "").endswith(".AttributeReference") and tree.get("name") == name) + sum(fields_named(x, name) for x in tree.values())
    return sum(fields_named(x, name) for x in tree) if isinstance(tree, list) else 0


def test_filters_send_each_text_once_to_one_worker(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    for kept in (quality_rules.passed(docs), quality_gbt.accepted(docs, labels)):
        (sent,) = python_steps(kept)
        assert fields_named(sent, "text") == 1


def test_filters_keep_rows_whole(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    good = [r.doc_id for r in quality_gbt.quality_scores(docs, labels).collect() if r.predicted]
    kept = quality_gbt.accepted(docs, labels)
    assert kept.columns == docs.columns and good
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.where(docs.doc_id.isin(good)).collect()))
    odd = odd_docs(spark)
    turned = odd.select(*(f"`{c}`" for c in reversed(odd.columns)))
    assert quality_rules.passed(turned).columns == quality_gbt.accepted(turned, labels).columns == turned.columns


def test_packing_starts_no_other_python_workers(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")

    def parallelized(*args, **more):
        raise AssertionError("rows went through a Python RDD")

    monkeypatch.setattr(SparkSession, "createDataFrame", parallelized)
    got = packing.packed(docs.where("doc_id < 20"), targets={'we"b \U0001f600': 0.5}).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.where("doc_id < 20").collect()}
