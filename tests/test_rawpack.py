"""Raw packs against numpy: bytes on disk, songs back, names pushed down, appends, and writes that fail."""

import os

import numpy as np
import pytest

from corpusmill.sources import rawpack

SCHEMA = "name string, codes array<array<int>>"


def songs(spark, names, books=3):
    rng = np.random.default_rng(len(names))
    made = {n: rng.integers(-32768, 32768, (books, k % 5)).tolist() for k, n in enumerate(names)}
    return made, spark.createDataFrame(list(made.items()), SCHEMA).repartition(3)


def back(df):
    return {r["name"]: r["codes"] for r in df.collect()}


def test_pack_is_byte_equal_to_numpy(spark, tmp_path):
    path = str(tmp_path / "pack")
    made, df = songs(spark, [f"s{k:02d}" for k in range(23)])
    rawpack.write(df, path, 10)
    assert back(rawpack.read(spark, path)) == made
    for shard, names in enumerate([sorted(made)[a : a + 10] for a in (0, 10, 20)]):
        blob = np.concatenate([np.array(made[n], "<i2").reshape(3, -1) for n in names], axis=1)
        with open(f"{path}/shard_{shard}.codes", "rb") as f:
            assert f.read() == blob.tobytes()
    rows = sorted(tuple(r) for r in rawpack.read(spark, path).select("shard_id", "local_idx", "name", "offset", "n_frames").collect())
    ends = 0
    for shard, place, name, offset, frames in rows:
        ends = 0 if place == 0 else ends
        assert (place, offset, frames) == (sorted(made).index(name) % 10, ends, len(made[name][0]))
        ends += frames


def test_appends_number_on_and_keep_what_is_there(spark, tmp_path):
    path = str(tmp_path / "pack")
    first, df = songs(spark, [f"b{k}" for k in range(5)])
    more, other = songs(spark, [f"a{k}" for k in range(4)])
    rawpack.write(df, path, 2)
    before = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path) if f.startswith("shard_")}
    rawpack.write(other, path, 3, append=True)
    assert back(rawpack.read(spark, path)) == first | more
    assert {f: os.stat(f"{path}/{f}").st_mtime_ns for f in before} == before
    assert [s["shard_id"] for s in rawpack.shards(path)] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        rawpack.write(df, path, 2)


def test_names_open_only_their_shards(spark, tmp_path):
    path = str(tmp_path / "pack")
    made, df = songs(spark, [f"s{k:03d}" for k in range(100)])
    rawpack.write(df, path, 10)
    wanted = ["s005", "s007", "s055", "none"]
    found = rawpack.read(spark, path, wanted)
    assert found.rdd.getNumPartitions() == 2
    assert back(found) == {n: made[n] for n in wanted if n in made}
    one = rawpack.read(spark, path).where("name = 's099'")
    assert one.rdd.getNumPartitions() == 1 and back(one) == {"s099": made["s099"]}
    os.remove(f"{path}/shard_3.codes")  # a shard that is not asked for is not opened
    assert back(rawpack.read(spark, path, wanted)) == back(found)


@pytest.mark.parametrize("bad", [("x", [[1, 2], [3], [4, 5]]), ("x", [[40_000], [1], [1]]), ("x", None), (None, [[1], [1], [1]]), ("x", [[1], [1]])])
def test_what_cannot_be_packed_is_refused_and_leaves_the_pack(spark, tmp_path, bad):
    path = str(tmp_path / "pack")
    made, df = songs(spark, ["a", "b", "c"])
    rawpack.write(df, path, 2)
    rows = spark.createDataFrame([bad, ("y", [[1], [2], [3]]), ("z", [[1], [2], [3]])], SCHEMA)
    with pytest.raises(Exception):  # noqa: B017
        rawpack.write(rows, path, 1, append=True)
    assert back(rawpack.read(spark, path)) == made
    assert not [f for f in os.listdir(path) if f.startswith("_staging")]


def test_repeated_names_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("a", [[1]]), ("a", [[2]])], SCHEMA)
    with pytest.raises(Exception):  # noqa: B017
        rawpack.write(df, str(tmp_path / "pack"), 5)


def test_torn_shards_are_told(spark, tmp_path):
    path = str(tmp_path / "pack")
    _, df = songs(spark, ["a", "b", "c"])
    rawpack.write(df, path, 2)
    with open(f"{path}/shard_0.codes", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="bytes"):
        rawpack.read(spark, path).collect()


def test_empty_writes_and_packs(spark, tmp_path):
    path = str(tmp_path / "pack")
    rawpack.write(spark.createDataFrame([], SCHEMA), path, 2)
    assert rawpack.read(spark, path).count() == 0 and rawpack.shards(path) == []
    rawpack.write(songs(spark, ["a"])[1], path, 2, append=True)
    assert rawpack.read(spark, path).count() == 1


def test_small_shards_share_a_task(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "pack")
    made, df = songs(spark, [f"s{k:03d}" for k in range(60)])
    rawpack.write(df, path, 2)
    assert rawpack.read(spark, path).rdd.getNumPartitions() == 1 and back(rawpack.read(spark, path)) == made
    monkeypatch.setattr(rawpack, "TASK_SONGS", 20)
    found = rawpack.Reader(path).partitions()
    assert [len(p.shards) for p in found] == [10, 10, 10] and sum(([s["shard_id"] for s in p.shards] for p in found), []) == list(range(30))
    monkeypatch.setattr(rawpack, "TASK_BYTES", 1)
    assert len(rawpack.Reader(path).partitions()) >= 24  # a shard without frames joins its neighbour
