"""Reading and writing tables: strict schemas, time series, manifests and JSON lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas as DDL.
LABELS = ("label_id string, session_id string, stream_id string, kind string, t_start_ms bigint, t_end_ms bigint, ontology_version string, source string, model_version string, sensor_id string, "
    "evidence string, confidence double, verification_state string, reviewer_id string, reviewed_at timestamp, parent_label_id string, retracted boolean, seeded_error boolean, measurement string, created_at timestamp, payload string"
)
SESSIONS = ("session_id string, domain string, worker_id string, site_id string, consent_version string, recorded_at timestamp, duration_ms bigint, privacy_state string, lifecycle_state string, ontology_version string, created_at timestamp")
STREAMS = ("session_id string, stream_id string, position int, kind string, uri string, sample_rate_hz double, pts_index_uri string, offset_ms double, clock_scale double, sync_method string, sync_confidence double, manual_adjustment_ms double")
IMU = ("t_ms double, ax double, ay double, az double, gx double, gy double, gz double")


def table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with a schema, columns must be there and are cast to it."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if schema is None:
        return df
    fields = T.StructType.fromDDL(schema)
    if missing := [f.name for f in fields if f.name not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))


def time_series(spark: SparkSession, path: str, schema: str = IMU, kind: str = "parquet") -> DataFrame:
    """Samples from Parquet or CSV with the source file as ``file``."""
    reader = spark.read.schema(schema)
    df = reader.csv(path, header=True) if kind == "csv" else reader.parquet(path)
    return df.withColumn("file", F.input_file_name())


def faults(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows that break a check, once a check, with its name; a check that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return df.withColumn("fault", F.explode(broken))


def label_checks() -> dict[str, Column]:
    return {
        "id": F.col("label_id").isNotNull() & (F.length("label_id") <= 128),
        "span": F.col("t_end_ms") >= F.col("t_start_ms"),
        "start": F.col("t_start_ms") >= 0,
        "source": F.col("source").isin("human", "model", "sensor"),
        "confidence": F.col("confidence").isNull() | F.col("confidence").between(0, 1),
        "model": (F.col("source") != "model") | F.col("model_version").isNotNull(),
        "parent": F.col("parent_label_id").isNull() | (F.col("parent_label_id") != F.col("label_id")),
    }


def write_once(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """An immutable version: fails if the path is there."""
    df.write.mode("errorifexists").partitionBy(*partitions).parquet(path)


def write_json_lines(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSON lines in a global order, split over files by ranges of it."""
    df.orderBy(*order).write.mode("errorifexists").json(path)


def append_missing(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Append the rows whose keys the table lacks; how many."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path).select(*keys)
        fresh = df.dropDuplicates(list(keys)).join(known, list(keys), "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df.dropDuplicates(list(keys))
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n
