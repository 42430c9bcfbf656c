"""Running streams against tables, versioned stores against failing writes, ranges on hot keys, centres, sketches and folds."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import folds
from corpusmill.operators import crops, joins, similarity, sketches, windows
from corpusmill.sources import scratch, stores
from corpusmill.streaming import matching

EVENTS = "key string, id long, at timestamp_ntz, batch int"


def hours(*rows):
    return [(k, i, np.datetime64("2024-01-01").astype("datetime64[us]").astype(object).__class__(2024, 1, 1 + int(h // 24), int(h % 24)), b) for k, i, h, b in rows]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    rows = hours(("a", 1, 1, 0), ("a", 2, 30, 0), ("a", 1, 2, 0), ("b", 3, 10, 1), ("b", 4, 20, 1), ("a", 2, 31, 1), ("b", 5, 60, 1), ("c", 6, 40, 2), ("c", 7, 50, 2))
    df = spark.createDataFrame(rows, EVENTS)
    kept, runs = matching.replay(spark, df, "batch", str(tmp_path), lambda s: matching.distinct_within(s, "at", ["id"], "12 hours"))
    # After the first batch the watermark is at hour 18, after the second at hour 48.
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4, 5, 7]
    assert [r.dropped for r in runs] == [0, 1, 1] and [r.rows for r in runs] == [3, 4, 2]
    assert runs[-1].held <= 2  # what the watermark has passed is forgotten


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_interval_joins_of_streams_and_tables_agree(spark, tmp_path, how):
    rng = np.random.default_rng(3)
    rows = hours(*[(f"k{rng.integers(3)}", k, int(rng.integers(0, 30)) + 24 * (k // 40), k // 40) for k in range(160)])
    df = spark.createDataFrame(rows, EVENTS)

    def build(a, b):
        left = a.where("id % 2 = 0").select("key", F.col("id").alias("l"), F.col("at").alias("lt"))
        right = b.where("id % 2 = 1").select("key", F.col("id").alias("r"), F.col("at").alias("rt"))
        return matching.interval_join(left, right, "key", "lt", "rt", before="1 hour", after="3 hours", late="48 hours", how=how).select("l", "r")

    want = sorted((tuple(r) for r in build(df, df).collect()), key=str)
    closing = spark.createDataFrame(hours(("z", 1000, 24 * 30, 9), ("z", 1001, 24 * 30, 9)), EVENTS)  # lets the watermark pass all others
    out, runs = matching.replay(spark, df.union(closing), "batch", str(tmp_path), build, sources=2)
    got = sorted((tuple(r) for r in out.where("l < 1000").collect()), key=str)
    assert got == want and sum(r.dropped for r in runs) == 0
    assert runs[-1].held < runs[-1].most


def test_times_without_a_zone_need_utc(spark):
    df = spark.createDataFrame(hours(("a", 1, 1, 0)), EVENTS)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError):
            matching.timed(df, "at", "1 hour")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def store(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


def test_versions_keep_untouched_shards_and_survive_failed_writes(spark, tmp_path):
    path = str(tmp_path / "store")
    assert stores.current(spark, path).count() == 0
    stores.put(store(spark, [(f"k{i}", "old") for i in range(60)]), path, shards=8)
    first = {d: os.stat(f"{path}/{d}").st_mtime_ns for d in os.listdir(path)}
    stores.put(store(spark, [("k1", "new"), ("k2", None), ("k99", "more")]), path, shards=8)
    assert {d: os.stat(f"{path}/{d}").st_mtime_ns for d in first} == first
    want = {f"k{i}": "old" for i in range(60)} | {"k1": "new", "k2": None, "k99": "more"}
    assert {r["key"]: r["value"] for r in stores.current(spark, path).collect()} == want
    bad = store(spark, [("k3", "bad"), ("k4", "bad")]).withColumn("value", F.when(F.col("key") == "k4", F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        stores.put(bad, path, shards=8)
    assert {r["key"]: r["value"] for r in stores.current(spark, path).collect()} == want
    held = stores.current(spark, path)
    stores.put(store(spark, [("k5", "later")]), path, shards=8)
    assert {r["key"]: r["value"] for r in held.collect()} == want  # a reader keeps what it has read of
    assert stores.vacuum(spark, path) > 0
    assert {r["key"]: r["value"] for r in stores.current(spark, path).collect()} == want | {"k5": "later"}
    assert stores.vacuum(spark, path) == 0


def test_json_shards_are_read_back(spark, tmp_path):
    from corpusmill.sources import tables

    rows = [("a\"b", 1), ("é", None), ("c", 3), ("d", 4)]
    df = spark.createDataFrame(rows, "k string, n int").withColumn("v", F.when(F.col("n").isNotNull(), F.struct("n")))
    stores.write_keyed_json(df, str(tmp_path / "json"), "k", "v", 2)
    got = tables.keyed_json(spark, str(tmp_path / "json" / "*"), df.schema["v"].dataType, torn="fail").collect()
    assert {r["key"]: r["value"] and r["value"]["n"] for r in got} == dict(rows)


def plain_as_of(points, events, forward, inclusive):
    out = []
    for k, p in points:
        own = [e for j, e in events if j == k and ((e >= p if inclusive else e > p) if forward else (e <= p if inclusive else e < p))]
        out.append((k, p, (min(own) if forward else max(own)) if own else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_as_of_equals_a_scan(spark, forward, inclusive):
    rng = np.random.default_rng(5)
    key = lambda: [None, "hot", "hot", "hot", "b"][rng.integers(5)]
    points, events = [(key(), int(rng.integers(60))) for _ in range(300)], [(key(), int(rng.integers(60))) for _ in range(60)]
    p, e = spark.createDataFrame(points, "k string, t int"), spark.createDataFrame(events, "k string, u int")
    got = joins.as_of(p, e, ["k"], "t", "u", [], forward=forward, inclusive=inclusive)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_as_of(points, events, forward, inclusive)
    assert joins.as_of(p.limit(0), e, ["k"], "t", "u", []).count() == 0


def test_a_million_rows_on_one_key(spark):
    points = spark.range(500_000).selectExpr("'hot' as k", "id * 2 as t")
    events = spark.range(500_000).selectExpr("'hot' as k", "id * 2 + 1 as u")
    began = time.time()
    got = joins.as_of(points, events, ["k"], "t", "u", [], forward=True).selectExpr("sum(u - t) as s", "count(u) as n").first()
    assert tuple(got) == (500_000, 500_000) and time.time() - began < 60
    words = points.select("k", "t", F.lit("w").alias("w"))
    began = time.time()
    assert crops.injected(words, events.select("k", "u", F.lit("s").alias("l")), "k", "t", "w", "u", "l").count() == 999_999
    assert time.time() - began < 60


def test_range_overlaps(spark):
    a = spark.createDataFrame([("x", 0, 5), ("y", 5, 6), ("z", 9, 20)], "g string, lo long, hi long")
    b = spark.createDataFrame([("p", 0, 2), ("q", 2, 12), ("r", 15, 30)], "h string, lo long, hi long")
    got = {(r["a_g"], r["b_h"], r["n"]) for r in joins.range_overlaps(a, b).collect()}
    assert got == {("x", "p", 2), ("x", "q", 3), ("y", "q", 1), ("z", "q", 3), ("z", "r", 5)}


def test_folders_are_in_order_of_their_numbers(spark):
    sizes = spark.createDataFrame([("wave_10", 1), ("wave_2", 1), ("wave_1", 9), ("extra", 0)], "g string, n long")
    over, under = joins.allocate_spill(sizes, "g", "n", 4)
    assert [(r["g"], r["lo"], r["hi"]) for r in under.orderBy("lo").collect()] == [("wave_2", 0, 3), ("wave_10", 3, 6), ("extra", 6, 10)]


def test_scratch_is_deleted(spark):
    from corpusmill.operators import dedup

    at = scratch.mark()
    pairs = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    found = dedup.components(pairs)
    assert found.where("component = 0").count() == 41
    assert scratch.mark() == at + 1  # the result's own table
    kept = scratch.settled(windows.global_row_number(spark.range(50), ["id"], "n"), at)
    assert kept.count() == 50 and scratch.mark() == at + 1


@pytest.mark.parametrize("tile", [1, 3, 100])
def test_nearest_centers_in_tiles(spark, tile):
    rng = np.random.default_rng(2)
    vectors, centers = rng.normal(size=(30, 8)), rng.normal(size=(7, 8))
    centers[3] = centers[5]  # a tie
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(vectors)] + [(99, None), (98, [0.0] * 8)], "id long, v array<double>").repartition(3)
    c = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(centers)], "c long, v array<double>")
    got = {r["id"]: [(n["id"], n["sim"]) for n in r["nearest"]] for r in similarity.nearest(v, "id", "v", c, "c", "v", 3, tile=tile).collect()}
    sims = vectors @ centers.T / np.linalg.norm(vectors, axis=1)[:, None] / np.linalg.norm(centers, axis=1)[None]
    for k in range(30):
        order = sorted(range(7), key=lambda j: (-round(sims[k, j], 12), j))[:3]
        assert [j for j, _ in got[k]] == order and [s for _, s in got[k]] == pytest.approx([sims[k, j] for j in order])
    assert got[99] == [] and [j for j, _ in got[98]] == [0, 1, 2]


def test_sketches_of_parts_merge_to_those_of_the_whole(spark):
    docs = spark.createDataFrame([("g", f"p{k % 5}", " ".join(f"w{(k * j) % 3000}" for j in range(1 + k % 50))) for k in range(3000)] + [("g", "p0", None), ("g", "p1", "")], "g string, p string, text string")
    for r in sketches.held_against_exact(docs, "p", "g").collect():
        assert r["words_inside"] and r["median_inside"] and r["top_inside"] and r["words_error"] < sketches.DISTINCT_BOUND


def test_folds_are_called_from_sql(spark):
    folds.register(spark)
    rows = [("a", 1, 0.0, 2.0, None, None), ("a", 2, 1.0, 1.5, None, None), ("a", 3, None, None, 5.0, 6.0), ("a", 4, 4.0, 7.0, None, None), ("a", 5, None, None, None, None), ("b", 1, 1.0, 1.0, None, None)]
    spark.createDataFrame(rows, "song string, i int, start double, `end` double, own_start double, own_end double").createOrReplaceTempView("spans_in")
    got = spark.sql("SELECT song, i, a, b FROM clamp_spans(TABLE(spans_in) PARTITION BY song ORDER BY i)").collect()
    assert {(r["song"], r["i"]): (r["a"], r["b"]) for r in got} == {("a", 1): (0, 2), ("a", 2): (2, 2.001), ("a", 3): (5, 6), ("a", 4): (6, 7), ("a", 5): (None, None), ("b", 1): (1, 1.001)}
    labels = spark.createDataFrame([("s", float(k), x, 2, 100.0) for k, x in enumerate("aabaabbbab")], "s string, at double, label string, hold int, wait double")
    assert [r["run"] for r in sorted(folds.folded(labels, "debounce", ["s"], ["at"]).collect(), key=lambda r: r["at"])] == [1, 1, 1, 1, 1, 1, 2, 2, 2, 2]


def test_wordless_shares_equal_all_starts_and_draws_come_near(spark):
    rng = np.random.default_rng(8)
    songs = [(k, int(rng.integers(20, 400))) for k in range(12)]
    words = [(k, a, a + float(rng.integers(1, 20)) / 10) for k in range(10) for a in (rng.integers(0, 300, 3) / 10.0)]
    s, w = spark.createDataFrame(songs, "k long, frames long"), spark.createDataFrame([(k, float(a), float(b)) for k, a, b in words], "k long, a double, b double")
    exact = {r["k"]: (r["n_starts"], r["n_wordless"]) for r in crops.wordless_share(s, w, "k", "frames", "a", "b", 60, 10.0).collect()}
    for k, frames in songs:
        starts = range(max(frames - 60, 0) + 1)
        assert exact[k] == (len(starts), sum(not any(b > f / 10 and a < (f + 60) / 10 for j, a, b in words if j == k) for f in starts))
    drawn = {r["k"]: r["n_empty"] / r["n_draws"] for r in crops.drawn_wordless(s, w, "k", "frames", "a", "b", 60, 10.0, 400).collect()}
    assert all(abs(drawn[k] - n / m) < 0.1 for k, (m, n) in exact.items())
