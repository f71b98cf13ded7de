"""Frame grids and the sink of episodes."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.sources import episodes


def frames(spark, n=7):
    rng = np.random.default_rng(3)
    rows = [(e, i, i * 100.0, [float(x) for x in rng.normal(e, 2, 3)]) for e in range(n) for i in range(int(rng.integers(1, 40)))]
    return episodes.episode_rows(spark.createDataFrame(rows, "e long, frame long, t double, v array<double>").select("e", "frame", "t", *(F.col("v")[i].alias(f"c{i}") for i in range(3))), "e", ["c0", "c1", "c2"])


def test_grid_series_and_next_state(spark):
    sessions = spark.createDataFrame([(1, 0, 1000), (2, 50, 55), (3, 9, 9)], "e long, s long, z long")
    grid = episodes.frame_grid(sessions, "e", "s", "z", 3)
    assert sorted((r.e, r.frame, round(r.t, 3)) for r in grid.collect()) == [(1, 0, 0), (1, 1, 333.333), (1, 2, 666.667), (2, 0, 50)]
    samples = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 500.0, 2.0), (1, 2, 2000.0, 9.0)], "e long, id long, t double, v double")
    held = spark.createDataFrame([(1, 300, 400, 7), (1, 0, 2000, 5)], "e long, start long, end long, code int")
    rows = episodes.with_interval(episodes.with_series(grid, "e", "v", samples, "id", "v", 600), "e", "code", held, "code", 500)
    got = {(r.e, r.frame): r for r in episodes.episode_rows(rows, "e", ["v", "code"], -1.0).collect()}
    assert [round(x, 3) for x in got[1, 0].state] == [1.0, 5.0] and [round(x, 3) for x in got[1, 1].state] == [1.667, 7.0]
    assert got[1, 2].state == [-1.0, 5.0] and got[1, 2].valid == [False, True] and got[1, 2].action == got[1, 2].state
    assert got[1, 0].action == got[1, 1].state and got[2, 0].valid == [False, False]


def test_packages_are_whole(spark, tmp_path):
    rows, path = frames(spark).cache(), str(tmp_path / "package")
    episodes.write_episodes(rows, path, "e", 10)
    whole = episodes.manifest(path)
    back = episodes.read_episodes(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select(*back.columns).collect()))
    state = np.array([r.state for r in rows.collect()])
    kept = whole["statistics"]["state"]
    assert (kept["count"], whole["episodes"], whole["frames"]) == (len(state), 7, len(state))
    assert np.allclose([kept[k] for k in ("mean", "std", "min", "max")], [state.mean(0), state.std(0), state.min(0), state.max(0)])
    listed = [json.loads(x) for name in whole["lists"] for x in (tmp_path / "package" / name).read_text().splitlines()]
    assert sorted(x["episode"] for x in listed) == list(range(7)) and len({x["file"] for x in listed}) == 7
    with pytest.raises(Exception, match="has a manifest"):
        episodes.write_episodes(rows, path, "e", 10)
    assert episodes.manifest(path) == whole and len(list((tmp_path / "package" / "data").iterdir())) == 1
    episodes.write_episodes(rows.where("e < 2"), path, "e", 10, "overwrite")
    assert episodes.manifest(path)["episodes"] == 2 and episodes.read_episodes(spark, path).select("e").distinct().count() == 2


def test_failed_tasks_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "broken")

    def fails(batches):
        for b in batches:
            if 5 in b.column("e").to_pylist():
                raise RuntimeError("lost")
            yield b

    rows = frames(spark)
    broken = rows.repartition("e").sortWithinPartitions("e", "frame").mapInArrow(fails, rows.schema)
    spark.dataSource.register(episodes.EpisodeSink)
    with pytest.raises(Exception, match="lost"):
        broken.write.format("episodes").option("episode", "e").option("fps", "10").mode("append").save(path)
    left = [p for p in (tmp_path / "broken").rglob("*") if p.is_file()] if (tmp_path / "broken").exists() else []
    assert left == []


def test_a_task_that_breaks_deletes_its_files(tmp_path):
    writer = episodes._Writer({"path": str(tmp_path), "episode": "e", "fps": "10"}, False)
    batch = pa.RecordBatch.from_pylist([{"e": i, "frame": 0, "state": [1.0], "action": [1.0]} for i in range(3)])

    def batches():
        yield batch
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(batches())
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_moments_merge_to_a_whole_pass():
    x = np.random.default_rng(0).normal(5, 3, (100, 2))
    whole, merged = episodes.Moments.of(x).plain(), None
    for part in np.array_split(x, [1, 30, 31]):
        merged = episodes.Moments.of(part).merged(merged)
    assert all(np.allclose(whole[k], merged.plain()[k]) for k in whole)
