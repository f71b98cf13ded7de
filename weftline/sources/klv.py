"""Sensor streams embedded as key-length-value items: a Python data source over binary files, and decoding of packets.

An item is a key of four characters, a type, the size of a sample, the number of samples (two bytes, big-endian), and the data, padded to four
bytes; items of type zero hold items. A device (``DEVC``) holds streams (``STRM``), and a stream one sensor's numbers with their
scale (``SCAL``) and the order and sign of their axes (``ORIN``).

``spark.dataSource.register(KlvFiles)``, then ``spark.read.format("klv").load(folder)`` gives a row for each
outermost item of each file. Files are read where tasks run, through pyarrow's file systems, large ones item by item; a broken
file gives what could be read of it and a row that names the fault.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators import joins

HEADER = struct.Struct(">4sBBH")
#: Fixed values of the format: numpy types (big-endian) by letter, and what fixed-point numbers are divided by.
TYPES = {"b": "i1", "B": "u1", "s": ">i2", "S": ">u2", "l": ">i4", "L": ">u4", "j": ">i8", "J": ">u8", "f": ">f4", "d": ">f8", "q": ">i4", "Q": ">i8"}
FIXED_POINT = {"q": 1 << 16, "Q": 1 << 32}
#: Items lie in items in items; files that go deeper are broken.
DEEPEST = 16


class Broken(ValueError):
    """Data that isn't what its headers say."""


@dataclass(frozen=True)
class Item:
    key: str
    kind: str
    size: int
    repeat: int
    data: bytes
    inner: tuple[Item, ...] = field(default=())

    def first(self, key: str) -> Item | None:
        return next((x for x in self.inner if x.key == key), None)


def padded(n: int) -> int:
    return (n + 3) // 4 * 4


def items(data: bytes, depth: int = 0) -> list[Item]:
    """The items of a packet; fewer than eight bytes at an end are no item."""
    if depth > DEEPEST:
        raise Broken(f"items deeper than {DEEPEST}")
    out, at = [], 0
    while at + HEADER.size <= len(data):
        name, kind, size, repeat = HEADER.unpack_from(data, at)
        key, length = name.decode("latin-1"), size * repeat
        body = data[at + HEADER.size : at + HEADER.size + length]
        if len(body) < length:
            raise Broken(f"{key}: {len(body)} of {length} bytes")
        out.append(Item(key, chr(kind), size, repeat, body, tuple(items(body, depth + 1)) if not kind else ()))
        at += HEADER.size + padded(length)
    return out


def numbers(item: Item) -> np.ndarray:
    """Samples by rows; fixed-point numbers as they are meant."""
    kind = TYPES.get(item.kind)
    if kind is None:
        raise Broken(f"{item.key}: type {item.kind!r} is no number")
    each = item.size // np.dtype(kind).itemsize
    values = np.frombuffer(item.data, dtype=kind, count=each * item.repeat).astype(np.float64)
    return values.reshape(item.repeat, each) / FIXED_POINT.get(item.kind, 1)


def axes(packet: bytes, sensor: str) -> np.ndarray:
    """x, y, z of each sample of the first stream that holds the sensor, scaled, axes put in order and small letters turned round; no rows without one."""
    for device in items(packet):
        for stream in device.inner:
            found = stream.first(sensor) if stream.key == "STRM" else None
            if found is None:
                continue
            raw = numbers(found)
            if scale := stream.first("SCAL"):
                raw = raw / numbers(scale).reshape(-1)
            order = stream.first("ORIN")
            names = order.data.split(b"\0")[0].decode("latin-1") if order else "ZXY"
            out = np.zeros((len(raw), 3))
            for column, axis in enumerate(names[: raw.shape[1]]):
                if axis.upper() not in "XYZ":
                    raise Broken(f"ORIN: axis {axis!r}")
                out[:, "XYZ".index(axis.upper())] = raw[:, column] * (-1 if axis.islower() else 1)
            return out
    return np.zeros((0, 3))


def item(key: str, kind: str, size: int, repeat: int, data: bytes) -> bytes:
    """The bytes of an item; what a writer of such streams, or a test, needs."""
    return HEADER.pack(key.encode("latin-1"), ord(kind) if kind else 0, size, repeat) + data.ljust(padded(len(data)), b"\0")


def nested(key: str, inner: bytes) -> bytes:
    """An item that holds items. Its length is in units of one byte, or of four where it is longer than two bytes can count."""
    return item(key, "", 1, len(inner), inner) if len(inner) < 1 << 16 else item(key, "", 4, len(inner) // 4, inner)


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("klv needs a path")
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.most = int(options.get("partitionBytes", 128 << 20))

    def partitions(self) -> list[InputPartition]:
        """Files dealt to partitions of about ``partitionBytes``; the driver sees names and sizes only."""
        system, root = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        about = system.get_file_info(root)
        found = [about] if about.is_file else system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        out: list[list[str]] = []
        held = self.most
        for f in sorted((f for f in found if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            if held + f.size > self.most:
                out.append([])
                held = 0
            out[-1].append(f.path)
            held += f.size
        return [_Files(paths) for paths in out]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        for path in partition.paths:
            with system.open_input_stream(path) as source:
                packet, at = 0, 0
                while len(head := source.read(HEADER.size)) == HEADER.size:
                    name, _, size, repeat = HEADER.unpack(head)
                    length = size * repeat
                    body = source.read(padded(length))
                    if len(body) < length:
                        yield path, packet, at, None, f"{name.decode('latin-1')}: {len(body)} of {length} bytes"
                        break
                    yield path, packet, at, head + body, None
                    packet, at = packet + 1, at + HEADER.size + padded(length)


class KlvFiles(DataSource):
    """Packets of key-length-value files: ``file``, ``packet``, ``place`` (byte), ``payload``, and ``fault`` where a file breaks off."""

    @classmethod
    def name(cls) -> str:
        return "klv"

    def schema(self) -> str:
        return "file string, packet int, place long, payload binary, fault string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def with_durations(packets: DataFrame, stream: str, start: str, duration: str) -> DataFrame:
    """Packets whose missing ``duration`` (null, 0 or less) is the time to the next packet of the stream, for the last one the median of the stream's others. Streams where that gives none for some packet go."""
    line = W.Window.partitionBy(stream).orderBy(start)
    whole = W.Window.partitionBy(stream)
    known = F.when(F.col(duration) > 0, F.col(duration).cast("double"))
    rows = packets.withColumn("_d", F.coalesce(known, F.lead(start).over(line) - F.col(start))).withColumn("_last", F.lead(start).over(line).isNull())
    rows = rows.withColumn("_d", F.when(F.col("_last") & F.col("_d").isNull(), F.percentile("_d", F.lit(0.5)).over(whole)).otherwise(F.col("_d")))
    rows = rows.withColumn("_bad", F.max(F.coalesce(F.col("_d") <= 0, F.lit(True))).over(whole))
    return rows.where("not _bad").withColumn(duration, F.col("_d")).drop("_d", "_last", "_bad")


def sensor_samples(packets: DataFrame, stream: str, start: str, duration: str, payload: str, sensor: str) -> DataFrame:
    """``stream``, ``t``, ``i`` (in its packet), ``x``, ``y``, ``z`` of every sample, evenly placed within its packet; a packet that can't be read gives one row with its ``fault`` and no values."""
    schema = StructType([packets.schema[stream], *StructType.fromDDL("t double, i int, x double, y double, z double, fault string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, s, d, data in zip(*(batch.column(c) for c in (stream, start, duration, payload)), strict=True):
                try:
                    v, fault = axes(data.as_py() or b"", sensor), None
                except Broken as e:
                    v, fault = np.full((1, 3), np.nan), str(e)
                n = len(v)
                t = s.as_py() + np.arange(n) * (d.as_py() / max(n, 1))
                columns = [pa.array([name.as_py()] * n, type=arrow.field(0).type), pa.array(t, type=pa.float64()), pa.array(range(n), type=pa.int32()), *(pa.array(c, type=pa.float64(), from_pandas=True) for c in v.T), pa.array([fault] * n, type=pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return packets.select(stream, F.col(start).cast("double").alias(start), F.col(duration).cast("double").alias(duration), payload).mapInArrow(run, schema)


def embedded_imu(packets: DataFrame, stream: str, start: str, duration: str, payload: str) -> DataFrame:
    """Acceleration ``ax`` to ``az`` at its own times, and turn rates ``gx`` to ``gz`` between the samples around these times, at the ends held; null where a stream has none. Streams of fewer than two samples go."""
    timed = with_durations(packets, stream, start, duration)
    read = lambda sensor: sensor_samples(timed, stream, start, duration, payload, sensor).where("fault is null").withColumn("id", F.struct("t", "i"))
    acc = read("ACCL").withColumn("_n", F.count(F.lit(1)).over(W.Window.partitionBy(stream))).where("_n > 1").select(stream, "t", "id", *(F.col(c).alias(f"a{c}") for c in "xyz"))
    gyro = read("GYRO").select(stream, "t", "id", F.struct("x", "y", "z").alias("g"))
    place = lambda df: df.withColumn("id", F.format_string("%030.6f %08d", "id.t", "id.i"))
    before = joins.asof(place(acc), place(gyro), [stream], "t", "id", "id", ["g"]).withColumnsRenamed({"g": "_g0", "match_time": "_t0"}).drop("match_id")
    both = joins.asof(before, place(gyro), [stream], "t", "id", "id", ["g"], "forward").withColumnsRenamed({"g": "_g1", "match_time": "_t1"}).drop("match_id")
    share = F.coalesce((F.col("t") - F.col("_t0")) / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0.0)), F.lit(0.0))
    line = lambda c: F.coalesce(F.col(f"_g0.{c}") + (F.col(f"_g1.{c}") - F.col(f"_g0.{c}")) * share, F.col(f"_g0.{c}"), F.col(f"_g1.{c}"))
    return both.select(stream, "t", *(f"a{c}" for c in "xyz"), *(line(c).alias(f"g{c}") for c in "xyz"))
