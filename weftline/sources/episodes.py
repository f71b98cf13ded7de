"""Episodes for training: series put on a frame grid, and a sink of one file an episode that is there as a whole or not at all.

``spark.dataSource.register(EpisodeSink)``, then :func:`write_episodes`. A task writes its episodes' files and a list of them,
and hands back the list's name and its part of the statistics. The commit merges these and writes the
manifest, which names the lists. Only what a manifest names counts: files of failed, repeated or
aborted tasks are deleted where that is still possible, and are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import joins

MANIFEST = "manifest.json"


def frame_grid(sessions: DataFrame, episode: str, start: str, end: str, fps: float, second: float = 1000.0) -> DataFrame:
    """``episode``, ``frame`` from 0 and time ``t`` of every frame from ``start`` on, the last one before ``end``."""
    step = second / fps
    frames = F.ceil((F.col(end) - F.col(start)) / step - 1e-9).cast("long")
    rows = sessions.where(F.col(end) > F.col(start)).select(episode, start, F.explode(F.sequence(F.lit(0).cast("long"), frames - 1)).alias("frame"))
    return rows.select(episode, "frame", (F.col(start) + F.col("frame") * step).alias("t"))


def with_series(grid: DataFrame, episode: str, name: str, samples: DataFrame, sample_id: str, value: str, most_gap: float) -> DataFrame:
    """The grid with a series' value at each frame as ``name``, straight between samples (``episode``, ``t``) at most ``most_gap`` apart."""
    rows = samples.select(episode, F.col("t").cast("double").alias("t"), sample_id, F.col(value).cast("double").alias(name))
    return joins.interpolated(grid, rows, [episode], "t", "frame", sample_id, name, most_gap)


def with_interval(grid: DataFrame, episode: str, name: str, intervals: DataFrame, value: str, width: int) -> DataFrame:
    """The grid with the value of the interval (``start``, ``end``) that covers each frame as ``name``: the latest started, of equals the greater value; null where none does."""
    points = grid.select(episode, "frame", F.floor("t").cast("long").alias("_s"), (F.floor("t") + 1).cast("long").alias("_e"))
    spans = intervals.select(episode, F.col("start").alias("_from"), F.col("end").alias("_to"), F.col(value).alias(name))
    met = joins.overlaps(points, spans, [episode], ("_s", "_e"), ("_from", "_to"), width).groupBy(episode, "frame").agg(F.max(F.struct("_from", name)).getField(name).alias(name))
    return grid.join(met, [episode, "frame"], "left")


def episode_rows(grid: DataFrame, episode: str, state: Sequence[str], fill: float = 0.0) -> DataFrame:
    """``state`` columns as one array, ``valid`` by column (a null counts as ``fill``), and ``action``, the state of the next frame; the last repeats its own."""
    values, there = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(fill)) for c in state)), F.array(*(F.col(c).isNotNull() for c in state))
    rows = grid.select(episode, "frame", "t", values.alias("state"), there.alias("valid"))
    line = W.Window.partitionBy(episode).orderBy("frame")
    return rows.withColumn("action", F.coalesce(F.lead("state").over(line), "state"))


@dataclass
class Moments:
    """Number, mean, sum of squared distances from it, least and greatest value of each column of an array."""

    n: int
    mean: np.ndarray
    spread: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        return cls(len(x), mean, ((x - mean) ** 2).sum(axis=0), x.min(axis=0), x.max(axis=0))

    def merged(self, other: Moments | None) -> Moments:
        if other is None:
            return self
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * other.n / n, self.spread + other.spread + apart**2 * self.n * other.n / n, np.minimum(self.low, other.low), np.maximum(self.high, other.high))

    def plain(self) -> dict[str, list[float] | int]:
        return {"count": self.n, "mean": self.mean.tolist(), "std": np.sqrt(self.spread / self.n).tolist(), "min": self.low.tolist(), "max": self.high.tolist()}


@dataclass
class _Part(WriterCommitMessage):
    listed: str | None
    episodes: int
    frames: int
    moments: dict[str, Moments]


def _rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str], overwrite: bool) -> None:
        self.path, self.episode, self.fps = options["path"], options["episode"], float(options["fps"])
        self.columns = [c for c in options.get("statistics", "state,action").split(",") if c]
        self.run, self.overwrite = uuid.uuid4().hex, overwrite

    def _system(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        """Episodes come one after another, each in order of its frames; one of them is held at a time."""
        system, root = self._system()
        attempt = uuid.uuid4().hex
        folder = f"{root}/data/{self.run}"
        system.create_dir(folder, recursive=True)
        made, lines, moments, held, current = [], [], {}, [], None
        frames = 0

        def close() -> None:
            nonlocal frames
            table = pa.Table.from_batches(held)
            name = f"{folder}/episode-{current}-{attempt}.parquet"
            with system.open_output_stream(name) as out:
                pq.write_table(table, out)
            made.append(name)
            lines.append({"episode": current, "frames": table.num_rows, "file": name.removeprefix(f"{root}/")})
            frames += table.num_rows
            for c in self.columns:
                moments[c] = Moments.of(_rows_of(table.column(c))).merged(moments.get(c))
            held.clear()

        try:
            for batch in iterator:
                ids = np.array(batch.column(self.episode).to_pylist(), dtype=object)
                cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1 if len(ids) else []
                for low, high in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                    if high > low:
                        if held and ids[low] != current:
                            close()
                        current = ids[low]
                        held.append(batch.slice(low, high - low))
            if held:
                close()
            if not lines:
                return _Part(None, 0, 0, {})
            listed = f"meta/{self.run}-{attempt}.jsonl"
            system.create_dir(f"{root}/meta", recursive=True)
            with system.open_output_stream(f"{root}/{listed}") as out:
                out.write("".join(json.dumps(x) + "\n" for x in lines).encode())
            return _Part(listed, len(lines), frames, moments)
        except BaseException:
            for name in made:
                system.delete_file(name)
            raise

    def commit(self, messages: list[_Part | None]) -> None:
        system, root = self._system()
        moments: dict[str, Moments] = {}
        parts = [m for m in messages if m is not None and m.listed]
        for part in parts:
            for c, m in part.moments.items():
                moments[c] = m.merged(moments.get(c))
        whole = {"fps": self.fps, "episodes": sum(p.episodes for p in parts), "frames": sum(p.frames for p in parts), "lists": sorted(p.listed for p in parts), "statistics": {c: m.plain() for c, m in sorted(moments.items())}}
        if system.get_file_info(f"{root}/{MANIFEST}").is_file and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.path} has a manifest")
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}.{self.run}") as out:
            out.write(json.dumps(whole, indent=1).encode())
        system.move(f"{root}/{MANIFEST}.{self.run}", f"{root}/{MANIFEST}")

    def abort(self, messages: list[_Part | None]) -> None:
        system, root = self._system()
        if system.get_file_info(f"{root}/data/{self.run}").type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(f"{root}/data/{self.run}")
        for m in messages:
            if m is not None and m.listed and system.get_file_info(f"{root}/{m.listed}").is_file:
                system.delete_file(f"{root}/{m.listed}")


class EpisodeSink(DataSource):
    """Writes rows of episodes; options: path, episode (the column), fps, and statistics (array columns)."""

    @classmethod
    def name(cls) -> str:
        return "episodes"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def write_episodes(rows: DataFrame, path: str, episode: str, fps: float, mode: str = "append", statistics: Sequence[str] = ("state", "action")) -> None:
    """Write a package; with mode ``append`` there must be none at the path yet."""
    rows.sparkSession.dataSource.register(EpisodeSink)
    dealt = rows.repartition(episode).sortWithinPartitions(episode, "frame")
    dealt.write.format("episodes").option("episode", episode).option("fps", str(fps)).option("statistics", ",".join(statistics)).mode(mode).save(path)


def manifest(path: str) -> dict:
    system, root = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with system.open_input_stream(f"{root}/{MANIFEST}") as source:
        return json.loads(source.read())


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """The frames of the files that the manifest's lists name, and of no others."""
    whole = manifest(path)
    if not whole["lists"]:
        raise FileNotFoundError(f"{path} has no episodes")
    listed = spark.read.schema("episode string, frames long, file string").json([f"{path}/{x}" for x in whole["lists"]]).select(F.element_at(F.split("file", "/"), -1).alias("_file"))
    folders = sorted({x.split("/")[-1].split("-")[0] for x in whole["lists"]})
    rows = spark.read.parquet(*(f"{path}/data/{x}" for x in folders)).select("*", F.col("_metadata.file_name").alias("_file"))
    return rows.join(listed, "_file", "left_semi").drop("_file")
