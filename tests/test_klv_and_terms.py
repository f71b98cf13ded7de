"""Key-length-value files as a data source, and terms that a user adds."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import terms
from weftline.sources import klv


def stream(sensor, rows, scale=100, order="ZXY", kind="s"):
    body = b"".join(struct.pack(f">{len(r)}{'h' if kind == 's' else 'i'}", *r) for r in rows)
    size = (2 if kind == "s" else 4) * 3
    return klv.nested("STRM", klv.item("SCAL", "s", 2, 1, struct.pack(">h", scale)) + klv.item("ORIN", "c", 1, 3, order.encode()) + klv.item(sensor, kind, size, len(rows), body))


def packet(acc, gyro=(), **how):
    return klv.nested("DEVC", klv.item("DVNM", "c", 1, 5, b"thing") + stream("ACCL", acc, **how) + (stream("GYRO", gyro) if gyro else b""))


def test_items_numbers_and_axes():
    data = packet([(100, 200, 300), (1, 2, 3)], order="zXY")
    (device,) = klv.items(data)
    assert [x.key for x in device.inner] == ["DVNM", "STRM"] and device.inner[0].data == b"thing"
    assert klv.axes(data, "ACCL").tolist() == [[2.0, 3.0, -1.0], [0.02, 0.03, -0.01]]
    assert klv.axes(data, "GYRO").shape == (0, 3)
    assert klv.numbers(klv.Item("A", "q", 4, 1, struct.pack(">i", 3 << 15))).tolist() == [[1.5]]
    assert klv.numbers(klv.Item("A", "Q", 8, 1, struct.pack(">q", 3 << 31))).tolist() == [[1.5]]
    with pytest.raises(klv.Broken):
        klv.numbers(klv.Item("A", "c", 1, 1, b"x"))
    with pytest.raises(klv.Broken):
        klv.items(data[:-4])
    with pytest.raises(klv.Broken):
        deep = b""
        for _ in range(klv.DEEPEST + 3):
            deep = klv.nested("DEVC", deep)
        klv.items(deep)
    assert klv.items(b"abc") == [] and klv.items(b"") == []


def test_files_are_a_data_source(spark, tmp_path):
    one, two = packet([(1, 2, 3)] * 5), packet([(4, 5, 6)] * 700, [(7, 8, 9)])
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.klv").write_bytes(one + two)
    (tmp_path / "sub" / "b.klv").write_bytes(two + one[:-9])
    (tmp_path / "empty.klv").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no")
    spark.dataSource.register(klv.KlvFiles)
    rows = spark.read.format("klv").option("suffix", ".klv").option("partitionBytes", 10).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3
    got = {(r.file.rsplit("/", 1)[1], r.packet): r for r in rows.collect()}
    assert bytes(got["a.klv", 0].payload) == one and bytes(got["a.klv", 1].payload) == two and got["a.klv", 1].place == len(one)
    assert bytes(got["b.klv", 0].payload) == two and got["b.klv", 1].payload is None and got["b.klv", 1].fault.startswith("DEVC: ")
    assert len(got) == 4
    with pytest.raises(Exception, match="path"):
        spark.read.format("klv").load().collect()


def test_samples_durations_and_turn_rates(spark):
    rng = np.random.default_rng(1)
    whole = [(0.0, 100.0, 4, 3), (100.0, 0.0, 5, 3), (220.0, 0.0, 6, 2)]
    packets, acc, gyro = [], [], []
    for s, d, n, m in whole:
        a, g = rng.integers(-500, 500, (n, 3)), rng.integers(-500, 500, (m, 3))
        packets.append(("cam", s, d, packet([tuple(map(int, r)) for r in a], [tuple(map(int, r)) for r in g])))
        d = d or (120.0 if s == 100 else 110.0)
        acc += [(s + i * d / n, *(a[i, [1, 2, 0]] / 100)) for i in range(n)]
        gyro += [(s + i * d / m, *(g[i, [1, 2, 0]] / 100)) for i in range(m)]
    packets += [("alone", 0.0, 0.0, packet([(1, 2, 3)] * 4)), ("mute", 0.0, 10.0, packet([(1, 2, 3)] * 2)), ("bad", 0.0, 10.0, packet([(1, 2, 3)] * 2)[:-5])]
    df = spark.createDataFrame(packets, "s string, t0 double, d double, p binary").repartition(3)
    got = sorted(tuple(r) for r in klv.embedded_imu(df, "s", "t0", "d", "p").collect() if r.s == "cam")
    times = np.array([r[0] for r in gyro])
    want = [("cam", *a, *(float(np.interp(a[0], times, [g[1 + i] for g in gyro])) for i in range(3))) for a in acc]
    assert len(got) == len(want) and all(np.allclose(x[1:], y[1:]) for x, y in zip(got, sorted(want), strict=True))
    rest = [r for r in klv.embedded_imu(df, "s", "t0", "d", "p").collect() if r.s != "cam"]
    assert {r.s for r in rest} == {"mute"} and all(r.gx is None for r in rest)
    faults = klv.sensor_samples(df.where("s = 'bad'"), "s", "t0", "d", "p", "ACCL").collect()
    assert len(faults) == 1 and faults[0].fault and faults[0].x is None


LABELS = [("s1", 1, "cup", 0.9), ("s1", 2, "cup", None), ("s1", 3, "jug", 0.5), ("s2", 1, "cup", 0.2), ("s2", 2, "odd", 1.0)]


def test_a_user_adds_terms(spark):
    labels = spark.createDataFrame(LABELS, "session string, t int, class string, confidence double")
    rates = spark.createDataFrame([("cup", 0.5), ("jug", 0.25)], "class string, rate double")

    @terms.register_term("jugs")
    def jugs(policy):
        return F.when(F.col("class") == "jug", float(policy["jug"])).otherwise(0.0)

    @terms.register_row_term("late")
    class Late:
        def __init__(self, policy):
            self.n = 0

        def add(self, row):
            self.n += 1
            return float(self.n > 1 and row["t"] == self.n)

    try:
        weights = {"correction_rate": 2.0, "uncertainty": 1.0, "jugs": 1.0, "novelty": 1.0, "late": 10.0}
        parts = terms.contributions(labels, rates, "session", ["t"], weights, {"jug": 3, "default_rate": 0.1})
        got = {r.session: r for r in terms.session_scores(parts, "session", weights).collect()}
        assert abs(got["s1"].score - (2 * 1.25 + 0.6 + 3 + 2.5 + 20)) < 1e-9 and got["s1"].novelty == 2.5 and got["s1"].late == 2
        assert abs(got["s2"].score - (2 * 0.6 + 0.8 + 0 + 2 + 10)) < 1e-9
        sizes = spark.createDataFrame([("s1", 2.0), ("s2", 0.0)], "session string, minutes double")
        halves = {r.session: r.score for r in terms.session_scores(parts, "session", weights, sizes).collect()}
        assert abs(halves["s1"] - got["s1"].score / 2) < 1e-9 and halves["s2"] is None
        top = {(r.session, r.place): r["class"] for r in terms.explained(parts, "session", weights, 1).collect()}
        assert top == {("s1", 1): "jug", ("s2", 1): "odd"}
        with pytest.raises(ValueError, match="already"):
            terms.register_term("late")(jugs)
        with pytest.raises(ValueError, match="nothing"):
            terms.build_terms({"nothing": 1.0}, {})
    finally:
        terms.COLUMN_TERMS.pop("jugs")
        terms.ROW_TERMS.pop("late")
