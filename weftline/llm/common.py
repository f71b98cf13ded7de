"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Bytes of text, or of sets, that a Python worker works on at once. Spark's own batches are bounded in bytes too
#: (``spark.sql.execution.arrow.maxBytesPerBatch``); no setting of the session is touched.
SLICE_BYTES = 4 << 20

#: Rows of an id and a number, some 40 bytes each, that are broadcast to spare texts a shuffle; more meet them by one.
MOST_SENT = 2_000_000

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's own checkpoint folder. On a single machine without either, as in tests, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="weftline-"))
    return f"file://{_own_dir[0]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Delete tables written by :func:`staged` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/weftline/" in path:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def importable(spark: SparkSession) -> None:
    """Python workers on this machine find the library wherever the driver was started; a cluster gets it by --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def schema_of(df: DataFrame, columns: tuple[str, ...], more: str) -> StructType:
    """Fields of ``columns``, whatever their names and types, and those of the DDL ``more``."""
    return StructType([*(StructField(c, df.schema[c].dataType) for c in columns), *StructType.fromDDL(more).fields])


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts and binaries add up to ``most`` bytes or less, or in single rows."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        past = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, past + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


#: What a worker holds for later tasks of an operator, by the operator's name, and how to drop it.
_held: dict[str, Callable[[], None]] = {}


def holds(name: str, drop: Callable[[], None]) -> None:
    _held[name] = drop


def let_go(keeps: str | None = None) -> None:
    """Drop what this worker, which may serve many operators in turn, holds for others than ``keeps``, and give the memory back."""
    others = [n for n in _held if n != keeps]
    for n in others:
        _held.pop(n)()
    if others:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], dict | None], schema: str | StructType, keeps: str | None = None) -> DataFrame:
    """Arrow batch in, dict of columns out; a batch is cut by :func:`slices` first. ``keeps`` names what :func:`holds` may hold."""
    importable(df.sparkSession)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        for whole in batches:
            for b in slices(whole):
                if (out := each(b)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=True) for f in arrow], schema=arrow)
            # A batch goes before the next one comes.
            whole = b = out = None
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of each word; forgets all when full, so that memory stays bounded."""

    #: About 150 bytes each, in every Python worker.
    LIMIT = 60_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. bytes.split() and bytes.lower() know ASCII only, which is just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than the width make one shingle."""
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), dtype=np.uint64)
    for i in range(min(width, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def remainder_of_id(column: str, modulus: int):
    """crc32 of the id as text, modulo; null ids give -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)), F.lit(-1))


def label_sample(labels: DataFrame, label: str, usable, max_rows: int) -> DataFrame:
    """``doc_id`` and ``_label`` of about ``max_rows`` labelled ids at most (give or take its square root), those of least hash; one row an id, small enough to broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(usable).groupBy("doc_id").agg(F.max(label).alias("_label"))
    n, scale = known.count(), 1 << 30
    return known if n <= max_rows else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * max_rows / n))
