"""Packages tell when they were changed; readers refuse files they can't trust."""

import json

import pytest
from pyspark.sql import functions as F
from weftline.sources import exports


def test_package_and_its_digest(spark, tmp_path):
    rows = spark.range(20).withColumn("v", F.col("id") * 2)
    told = exports.package({"a": rows, "b": rows.where("id < 3")}, str(tmp_path), "p1")
    assert told["a"]["rows"] == 20 and exports.broken(spark, str(tmp_path), "p1") == []
    with pytest.raises(Exception, match="already exists"):
        exports.package({"a": rows}, str(tmp_path), "p1")
    rows.where("id <> 7").write.mode("overwrite").parquet(f"{tmp_path}/p1/a.parquet")
    assert exports.broken(spark, str(tmp_path), "p1") == ["a"]
    again = exports.package({"a": rows.repartition(5)}, str(tmp_path), "p2")
    assert again["a"] == told["a"]


def test_glove_and_frames_and_manifests(spark, tmp_path):
    glove = spark.createDataFrame([(0.0, 1.0, 2.0, None, 9)], "t_ms double, pressure_0 double, pressure_10 double, pressure_2 double, other int")
    glove.write.parquet(f"{tmp_path}/g.parquet")
    row = exports.glove(spark, f"{tmp_path}/g.parquet").first()
    assert row.channels == [1.0, None, 2.0] and row.total == 3.0
    with pytest.raises(ValueError):
        exports.glove(spark, f"{tmp_path}/g.parquet", ("force_",))
    spark.createDataFrame([(20, 20.0, False), (0, 0.0, True)], "pts long, pts_ms double, keyframe boolean").write.parquet(f"{tmp_path}/f.parquet")
    assert [(r.frame, r.ms) for r in exports.frame_times(spark, f"{tmp_path}/f.parquet").orderBy("frame").collect()] == [(0, 0.0), (1, 20.0)]
    (tmp_path / "m.json").write_text(json.dumps({"session_id": "s1", "domain": "cleaning", "streams": [{"stream_id": "a", "kind": "bodycam"}, {"stream_id": "b", "kind": "imu"}]}))
    assert sorted((r.session_id, r.stream_id, r.kind) for r in exports.manifest(spark, f"{tmp_path}/m.json").collect()) == [("s1", "a", "bodycam"), ("s1", "b", "imu")]
