"""Tables that end a plan: for operators that go round until nothing changes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder. Where both are unset and all runs on one machine, one of our own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="weftline-"))
    return f"file://{_own[0]}"


def settled(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read from there: computed once, and safe when executors are lost. The session is left as it is."""
    path = f"{shared_folder(df.sparkSession)}/weftline/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
