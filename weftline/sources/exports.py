"""What leaves the shop: tables of images and annotations, intervals, time series on a grid, and what readers check before they trust a package."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import natural_key
from ..operators.numbering import numbered


def categories(names: DataFrame, name: str, first: Sequence[str] = (), always: Sequence[str] = ()) -> DataFrame:
    """``category_id`` from 1 on: names in order, those of ``first`` before the others, and ``always`` at the end where they don't occur."""
    rank = F.when(F.col(name).isin(*first), 0).otherwise(1) if first else F.lit(1)
    rows = names.select(F.col(name).alias("name"), rank.alias("_rank")).where("name is not null").distinct()
    more = names.sparkSession.createDataFrame([(a, 2) for a in always], "name string, _rank int").join(rows.select("name"), "name", "left_anti")
    return rows.unionByName(more).select(F.row_number().over(W.Window.orderBy("_rank", "name")).alias("category_id"), "name")


def annotations(boxes: DataFrame, images: Sequence[str], kind: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images (``image_id`` by ``images``) and annotations (``annotation_id``, ``bbox``, ``area``, ``category_id``), numbered from 1 in order.

    Numbers come from counts of the rows before ranges of rows. Boxes
    without an area, and of kinds without a category, are left out; images without boxes stay.
    """
    pictures = numbered(boxes.select(*images).distinct(), images, "image_id").withColumn("image_id", F.col("image_id").cast("int"))
    kept = boxes.where("w > 0 and h > 0").join(ids.withColumnRenamed("name", kind), kind).join(pictures, list(images))
    rows = numbered(kept, ["image_id", "id"], "annotation_id").select("annotation_id", "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"))
    return pictures, rows


def intervals(labels: DataFrame, session: str, names: Mapping[str, Column]) -> DataFrame:
    """Labels as intervals in seconds, to three places, with the given columns."""
    seconds = lambda c: F.round(F.col(c) / 1000, 3)
    return labels.select(session, "kind", seconds("t_start_ms").alias("start_s"), seconds("t_end_ms").alias("end_s"), *(v.alias(k) for k, v in names.items()))


def channels(samples: DataFrame, prefixes: Sequence[str]) -> list[str]:
    """Columns that start with one of the prefixes, in natural order: ``p2`` before ``p10``."""
    import re

    found = [c for c in samples.columns if c.startswith(tuple(prefixes))]
    return sorted(found, key=lambda c: [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"\d+|\D+", c)])


def glove(spark: SparkSession, path: str, prefixes: Sequence[str] = ("pressure_",)) -> DataFrame:
    """A glove's samples: ``t_ms``, ``channels`` as an array in natural order of their names, and their ``total``; a file without channels, or without times, is an error."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)
    names = channels(df, prefixes)
    if "t_ms" not in df.columns or not names:
        raise ValueError(f"{path} needs t_ms and columns that start with {', '.join(prefixes)}")
    values = F.array(*(F.col(f"`{c}`").cast("double") for c in names))
    return df.select(F.col("t_ms").cast("double").alias("t_ms"), values.alias("channels")).withColumn("total", F.aggregate("channels", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))))


def frame_times(spark: SparkSession, path: str) -> DataFrame:
    """A video's frames from their index: ``frame`` from 0 in order of time, ``ms`` and whether it is a key frame; two frames at one time are an error."""
    df = spark.read.parquet(path)
    order = W.Window.orderBy("pts")
    rows = df.select(F.col("pts_ms").alias("ms"), "keyframe", "pts", (F.row_number().over(order) - 1).alias("frame"), F.lag("pts").over(order).alias("_before"))
    checked = F.when(F.col("pts") == F.col("_before"), F.raise_error(F.lit("two frames at one time"))).otherwise(F.col("ms"))
    return rows.select("frame", checked.alias("ms"), "keyframe")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Streams of session manifests (JSON, one object a file or line): one row a stream with its session's fields."""
    df = spark.read.option("multiLine", True).json(path)
    if "streams" not in df.columns or "session_id" not in df.columns:
        raise ValueError(f"{path} needs session_id and streams")
    return df.select("*", F.explode("streams").alias("_s")).drop("streams").select("*", "_s.*").drop("_s")


def package(tables: Mapping[str, DataFrame], folder: str, name: str) -> dict:
    """Write tables as one immutable package and give its manifest: rows and a digest of each table that doesn't depend on the order of its rows. A package that is there is an error."""
    out = {}
    for key, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}/{key}.parquet")
        back = df.sparkSession.read.parquet(f"{folder}/{name}/{key}.parquet")
        row = back.select(F.xxhash64(*back.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
        out[key] = {"rows": row["n"], "digest": str(row["s"])}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(name, json.dumps(out, sort_keys=True))], "name string, tables string").coalesce(1).write.mode("errorifexists").json(f"{folder}/{name}/manifest.json")
    return out


def broken(spark: SparkSession, folder: str, name: str) -> list[str]:
    """Tables of a package that aren't there, or whose rows or digest differ from its manifest's."""
    told = json.loads(spark.read.json(f"{folder}/{name}/manifest.json").first()["tables"])
    out = []
    for key, want in told.items():
        back = spark.read.parquet(f"{folder}/{name}/{key}.parquet")
        row = back.select(F.xxhash64(*back.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
        if (row["n"], str(row["s"])) != (want["rows"], want["digest"]):
            out.append(key)
    return out


def naturally(df: DataFrame, column: str) -> DataFrame:
    """Rows in natural order of a name."""
    return df.orderBy(natural_key(F.col(column)), column)
