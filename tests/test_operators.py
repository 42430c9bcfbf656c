"""Operators on literal fixtures, stores, streams."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, joins, quality, ranking, windows
from corpusmill.sources import stores, tables
from corpusmill.streaming import events, frames, progress, waves

SIGS = [("a", 0, 320000), ("b", 0b111, 128000), ("c", 0x00000000FFFFFFFF, 256000), ("d", 0x00000000FFFFFFFC, 320000), ("e", 0x0F0F0F0F0F0F0F0F, 320000)]


def test_near_duplicate_groups(spark):
    sigs = spark.createDataFrame(SIGS, "name string, sig long, bit_rate long")
    groups = dedup.components(dedup.near_pairs(sigs, "name", "sig"))
    assert {(r[0], r[1]) for r in groups.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
    verdict = dedup.near_duplicate_verdict(sigs, groups, "name", [F.coalesce("bit_rate", F.lit(0)).desc(), F.col("name")])
    assert {r["name"]: r["keeper"] for r in verdict.where("drop").collect()} == {"b": "a", "c": "d"}


def test_oversized_buckets_are_skipped(spark):
    zeros = spark.createDataFrame([(n, 0) for n in "abcde"], "name string, sig long")
    assert dedup.near_pairs(zeros, "name", "sig", cap=3).count() == 0
    assert dedup.oversized_buckets(zeros, "name", "sig", cap=3).count() == 4


def test_large_buckets_are_compared_exactly(spark):
    import random

    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(6)]
    sigs = [base[0]] * 25 + [base[1] & ~0xFFFF | k for k in range(40)]  # copies, and many signatures that share three bands
    for s in base:
        for _ in range(25):
            for _ in range(draw.randrange(5)):
                s ^= 1 << draw.randrange(64)
            sigs.append(s)
    rows = [(k, s - (1 << 64) if s >> 63 else s) for k, s in enumerate(sigs)]
    df = spark.createDataFrame([*rows, (999, None)], "name long, sig long")
    want = {(a, b) for a, x in enumerate(sigs) for b, y in enumerate(sigs) if a < b and bin(x ^ y).count("1") <= 3}
    root = list(range(len(sigs)))
    for a, b in sorted(want) * 10:
        root[a] = root[b] = min(root[a], root[b])
    linked = {v for p in want for v in p}
    for block in (4, 2000):
        pairs = [tuple(r) for r in dedup.near_pairs(df, "name", "sig", block=block).collect()]
        assert len(pairs) == len(want) and set(pairs) == want
        assert {tuple(r) for r in dedup.components(dedup.near_links(df, "name", "sig", block=block)).collect()} == {(v, root[v]) for v in linked}


def test_thousands_of_copies_have_one_keeper(spark):
    copies = spark.range(2500).select(F.col("id").alias("name"), F.lit(7).cast("long").alias("sig"))
    assert dedup.near_pairs(copies, "name", "sig").count() == 2500 * 2499 // 2
    groups = dedup.components(dedup.near_links(copies, "name", "sig"))
    assert groups.count() == 2500 and groups.where("component = 0").count() == 2500


def test_copies_have_one_keeper_in_the_queries(spark, tmp_path):
    from corpusmill.plans import CATALOG

    rows = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("the same few words in every row").alias("text"), F.lit(31).cast("long").alias("n_chars"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    assert CATALOG["near_dup_keeper"](spark, str(tmp_path)).where("drop and keeper = 0").count() == 2499


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_series_hold_no_unbounded_row(spark, sf_dir):
    from corpusmill.plans import CATALOG

    assert "collect_list" not in _plan(CATALOG["moving_average"](spark, sf_dir))
    assert "[shard" not in _plan(CATALOG["csr_offsets"](spark, sf_dir))
    assert "_place" in _plan(CATALOG["padded_rows"](spark, sf_dir))


def test_decayed_mean_and_running_sum_over_ranges(spark):
    values = [((k * 37) % 101) / 7 for k in range(3000)]
    rows = [("big", k, v) for k, v in enumerate(values)] + [("one", 5, 2.0), ("two", 1, 3.0), ("two", 2, 5.0), ("null", 1, 1.0), ("null", 2, None)]
    df = spark.createDataFrame(rows, "u string, k long, v double").repartition(5)
    want = values[0]
    for v in values[1:]:
        want = 0.9 * want + 0.1 * v
    got = {r["u"]: r["e"] for r in windows.decayed_mean(df, "u", ["k"], "v", 0.9, "e").collect()}
    assert abs(got["big"] - want) < 1e-9 and abs(got["two"] - 3.2) < 1e-9 and got["one"] == 2.0 and got["null"] is None
    sums = windows.running_sum(spark.range(1000).withColumn("n", F.col("id") % 7), ["id"], "n", "o").collect()
    assert {r["id"]: r["o"] for r in sums} == {k: sum(x % 7 for x in range(k)) for k in range(1000)}


def test_simhash_golden(spark):
    rows = [("x", v) for v in (1, 2, 3, 4, 5, 999, 123456)]
    from corpusmill.functions.hashing import unsigned_text

    got = dedup.simhash(spark.createDataFrame(rows, "k string, v long"), "k", "v").select(unsigned_text(F.col("sig"))).first()[0]
    assert got == "390233e4bb0192c8"


def test_chain_components(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = dict(dedup.components(pairs).collect())
    assert {got[k] for k in range(41)} == {0} and got[101] == 100


def test_overlap_is_strict(spark):
    spans = spark.createDataFrame([("k", 0, 10, 1), ("k", 10, 20, 2), ("k", 5, 60, 3)], "k string, a long, b long, id int")
    wins = spark.createDataFrame([("k", 10, 15, 7), ("k", 20, 30, 8)], "k string, lo long, hi long, w int")
    got = {(r["id"], r["w"]) for r in joins.overlapping(spans, wins, ["k"], "a", "b", "lo", "hi", 7).collect()}
    assert got == {(2, 7), (3, 7), (3, 8)}
    assert joins.overlapping(spans, wins, ["k"], "a", "b", "lo", "hi", 7).count() == 3


def test_full_queries_ask_about_every_row(spark, sf_dir, tmp_path):
    from corpusmill.plans import CATALOG

    assert CATALOG["interval_overlap_full"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    from oracle import assert_same

    rows = [(f"s{k}", lang) for k, n in enumerate((9, 1, 4, 7, 2)) for lang in ["fr"] * (n - 1) + ["en"]]
    spark.createDataFrame(rows, "source string, lang string").coalesce(1).write.parquet(str(tmp_path / "all"))
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    full = CATALOG["spill_allocation_full"]
    assert {tuple(r) for r in full(spark, str(tmp_path)).collect()} == {("s0", "s1", 3), ("s0", "s4", 2)}
    assert_same(spark, str(tmp_path), full, full.sql)


def test_active_segment_is_closed_open(spark):
    points = spark.createDataFrame([("k", t) for t in (0, 5, 9, 10, 12)], "k string, t long")
    segments = spark.createDataFrame([("k", 0, 5, "verse"), ("k", 10, 12, "chorus")], "k string, s long, e long, label string")
    got = {r["t"]: r["label"] for r in joins.active_segment(points, segments, ["k"], "t", "s", "e", "label", "no_section").collect()}
    assert got == {0: "verse", 5: "no_section", 9: "no_section", 10: "chorus", 12: "no_section"}


def test_null_wins_an_upsert(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda r: spark.createDataFrame(r, "key string, value string")
    stores.upsert(spark, path, rows([(f"song_{k:04d}", "x") for k in range(50)]), shards=8)
    before = {r["shard"]: r["m"] for r in spark.read.parquet(path).select("shard", F.col("_metadata.file_modification_time").alias("m")).distinct().collect()}
    stores.upsert(spark, path, rows([("song_0000", None)]), shards=8)
    back = spark.read.parquet(path)
    assert back.count() == 50 and back.where("value is null").count() == 1
    after = {r["shard"]: r["m"] for r in back.select("shard", F.col("_metadata.file_modification_time").alias("m")).distinct().collect()}
    assert sum(before[s] != after[s] for s in before) == 1


def test_keyed_json_shards(spark, tmp_path):
    (tmp_path / "lyrics_000.json").write_text(json.dumps({"a": {"words": [{"word": "x", "start": 0.0, "end": 1.0}, {"word": None, "start": 0, "end": 1}]}, "b": None}))
    (tmp_path / "lyrics_001.json").write_text("{torn")
    df = tables.keyed_json(spark, str(tmp_path), tables.LYRICS)
    got = {r["key"]: (r["vocals"], r["n_dropped"]) for r in tables.lyrics_state(df).collect()}
    assert got == {"a": ("vocals", 1), "b": ("instrumental", 0)}
    assert tables.torn_files(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="torn JSON"):
        tables.keyed_json(spark, str(tmp_path), tables.LYRICS, torn="fail").collect()


def test_packed_songs(spark):
    meta = spark.createDataFrame([(0, 2, 9, 30, [0, 10, 30], ["a", "b"], 540), (1, 1, 9, 5, [0, 6], ["c", "c"], 1)], "shard_id int, format_version int, n_codebooks int, total_T long, offsets array<long>, names array<string>, token_bytes long")
    assert [tuple(r)[2:4] for r in tables.packed_songs(meta.where("shard_id = 0")).orderBy("local_idx").collect()] == [("a", 10), ("b", 20)]
    bad = {(r["shard_id"], r["problem"]) for r in quality.pack_problems(meta).collect()}
    assert bad == {(1, p) for p in ("version", "offsets_size", "last_offset", "repeated_name", "bytes")}
    with pytest.raises(Exception, match="format_version"):
        tables.checked_version(meta).collect()


def test_append_leaves_earlier_shards(spark):
    songs = lambda n, k: spark.createDataFrame([(f"s{k + i:03d}", 10) for i in range(n)], "name string, frames long")
    first = stores.append_shards(songs(7, 0), "name", "frames", 3)
    more = stores.append_shards(songs(5, 7), "name", "frames", 3, first_shard=3)
    assert sorted({r["shard_id"] for r in first.collect()}) == [0, 1, 2] and sorted({r["shard_id"] for r in more.collect()}) == [3, 4]
    assert {r["offset"] for r in more.collect()} == {0, 10, 20}


def test_signal_quality(spark):
    import math

    rate = 2000
    sine = [0.25 * math.sin(2 * math.pi * 220 * i / rate) for i in range(rate)]
    rows = [("clean", sine), ("clipped", [max(-1.0, min(1.0, 16 * x)) for x in sine]), ("gap", sine[:200] + [0.0] * 1800), ("quiet", [x / 250 for x in sine])]
    df = spark.createDataFrame(rows, "name string, samples array<double>")
    f = quality.signal_figures(F.col("samples"), F.lit(rate))
    df = df.select("name", *[c.alias(k) for k, c in f.items()])
    got = {r["name"]: r["reasons"] for r in df.withColumn("reasons", quality.signal_reasons(F.col("clip_ratio"), F.col("silent_ratio"), F.col("rms_dbfs"), F.lit(0))).collect()}
    told = {name: [r.split("(")[0] for r in reasons] for name, reasons in got.items()}
    assert told["clean"] == [] and "clipped" in told["clipped"] and "silent" in told["gap"] and "dead" in told["quiet"]
    assert [one["c"] for one in spark.createDataFrame([(19.9,), (20.0,), (330.0,), (330.1,)], "s double").select(quality.duration_class(F.col("s")).alias("c")).collect()] == ["too_short", "ok", "ok", "too_long"]
    with pytest.raises(RuntimeError):
        quality.fail_if_nothing_worked(3, 0)


def test_only_full_settings_win(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "s string, v double")
    got = {r["s"]: (r["robust"], r["eligible"]) for r in ranking.ranked_settings(df, "s", "v").collect()}
    assert got == {"a": (1.5, True), "b": (9.0, False)}


def test_strings_are_numbered_in_order(spark):
    names = ["b", "a", "ab", "é", "z", "aa", None, "日本"]
    got = [r["name"] for r in windows.global_row_number(spark.createDataFrame([(n,) for n in names], "name string").repartition(3), ["name"], "rn").orderBy("rn").collect()]
    assert got == [None, "a", "aa", "ab", "b", "z", "é", "日本"]


def test_stream_of_frames_equals_table(spark, tmp_path):
    steps = spark.createDataFrame([("s", t, [10 * t, 10 * t + 1, 10 * t + 2]) for t in range(12)], "stream string, step long, codes array<int>")
    want = {(r["frame"], tuple(r["codes"])) for r in frames.aligned(steps, 3).collect()}
    assert want == {(f, (10 * f, 10 * f + 11, 10 * f + 22)) for f in range(10)}
    for k in range(4):
        steps.where(F.col("step").between(3 * k, 3 * k + 2)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:02d}"))
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = frames.aligned_stream(stream, 3).writeStream.format("memory").queryName("frames_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["frame"], tuple(r["codes"])) for r in spark.table("frames_out").collect()} == want
    assert frames.emission_chunks(10, 4, 3) == [(0, 4), (4, 7), (7, 10)]


def test_left_context(spark):
    chunks = spark.createDataFrame([("s", 0, [1, 2]), ("s", 1, [3]), ("s", 2, [4, 5])], "stream string, chunk int, frames array<int>")
    got = {r["chunk"]: (r["frames"], r["warm_up"]) for r in frames.with_left_context(chunks, 2).collect()}
    assert got == {0: ([1, 2], 0), 1: ([1, 2, 3], 2), 2: ([2, 3, 4, 5], 2)}


def test_windows_on_stream_equal_table(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = {tuple(r) for r in events.tumbling(table, "ts", ["event_type"]).select("start", "event_type", "n").collect()}
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream, "ts", ["event_type"]).writeStream.format("memory").queryName("windows_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("windows_out").select("start", "event_type", "n").collect()}
    assert want <= got
    assert sum(r["n"] for r in events.sessions(table, "ts", "user_id").collect()) == table.count()


def test_waves_resume_without_redoing(spark, tmp_path):
    ran = []
    stages = [(n, lambda s, d, n=n: ran.append(n)) for n in ("prepare", "dedup")]
    status = waves.StageStatus(spark, str(tmp_path / "status"))
    inventory = spark.range(3)
    status.mark("w1", "prepare")
    assert waves.run_wave(spark, "w1", inventory, stages, status) == ["dedup"]
    assert waves.run_wave(spark, "w1", inventory, stages, status) == [] and ran == ["dedup"]

    def fail(s, d):
        raise ValueError("no")

    with pytest.raises(ValueError):
        waves.run_waves(spark, {"a": inventory, "b": inventory, "c": inventory}, [("x", fail)], status)


def test_poisoned_results_are_not_redone(spark, tmp_path):
    """A stored value stays as it is: new files alone are worked on."""
    schema, src, store, cp = "key string, value string", str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")
    from pyspark.sql.types import StringType, StructType

    kind = StructType().add("key", StringType()).add("value", StringType())
    spark.createDataFrame([("a", "1"), ("b", "2")], schema).write.mode("append").parquet(src)
    assert waves.ingest_upserts(spark, src, kind, cp, store, shards=4) >= 1
    stores.upsert(spark, store, spark.createDataFrame([("a", "poison")], schema), shards=4)
    spark.createDataFrame([("c", "3")], schema).write.mode("append").parquet(src)
    waves.ingest_upserts(spark, src, kind, cp, store, shards=4)
    assert {(r["key"], r["value"]) for r in spark.read.parquet(store).collect()} == {("a", "poison"), ("b", "2"), ("c", "3")}


def test_sweep_stops_without_progress(spark):
    left = [5]

    def work(rows):
        left[0] -= min(2, rows.count()) if left[0] > 2 else 0

    assert waves.sweep(lambda: spark.range(left[0]).withColumnRenamed("id", "key"), work, 2) == 1


def test_heartbeat():
    now, said = [0.0], []
    beat = progress.Heartbeat(100, rows=10, seconds=5, say=said.append, clock=lambda: now[0])
    now[0] = 1.0
    beat.add(10)
    assert len(said) == 1 and "10 of 100" in said[0] and "9 s left" in said[0]
    assert not beat.stalled()
    now[0] = 7.0
    assert beat.stalled() and "no progress" in said[1]


def test_guards(spark):
    assert stores.guarded_count(spark.range(5), most=5) == 5
    with pytest.raises(ValueError):
        stores.guarded_count(spark.range(6), most=5)
    with pytest.raises(ValueError):
        stores.cleanup_plan(spark.range(3), spark.range(0))


def test_row_numbers_of_a_hot_value_are_spread(spark):
    from corpusmill.operators import windows

    df = spark.range(4000).selectExpr("if(id % 3 < 2, 'song_hot', concat('song_', id)) as name", "id")
    got = windows.global_row_number(df, ["name", "id"], "rn")
    rows = sorted((r["name"], r["id"], r["rn"]) for r in got.collect())
    assert [r[2] for r in rows] == list(range(1, 4001))
    parts = windows._ranged(df, ["name", "id"]).groupBy("_part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2000


def test_packs_refuse_other_columns(spark, tmp_path):
    from corpusmill.sources import packs

    songs = lambda names: spark.createDataFrame([(n, [[1, 2], [3, 4]]) for n in names], "name string, codes array<array<int>>")
    path = str(tmp_path / "pack")
    packs.write_pack(songs("abcdefg"), path, 3)
    packs.write_pack(songs("hijkl"), path, 3, append=True)
    index = {r["shard_id"]: r["n_songs"] for r in packs.pack_index(packs.read_pack(spark, path)).collect()}
    assert index == {0: 3, 1: 3, 2: 1, 3: 3, 4: 2}
    with pytest.raises(ValueError):
        packs.write_pack(songs("m").withColumn("chroma", F.lit(1)), path, 3, append=True)
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        spark.createDataFrame([([[40_000]],)], "codes array<array<int>>").select(packs.int16(F.col("codes"))).collect()


def test_files_of_a_pack_do_not_follow_its_shards(spark, tmp_path):
    from corpusmill.sources import packs

    songs = lambda a, b: spark.range(a, b).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("name"), F.array(F.array(F.col("id").cast("int")), F.array(F.lit(1))).alias("codes"))
    path = str(tmp_path / "pack")
    packs.write_pack(songs(0, 0), path, 3)  # shards are numbered from 0 after an empty write
    packs.write_pack(songs(0, 400), path, 3, append=True)
    packs.write_pack(songs(400, 1000), path, 3, append=True)
    assert len([f for f in (tmp_path / "pack").rglob("*.parquet")]) <= 12
    got = sorted((r["name"], r["shard_id"], r["local_idx"], r["offset"], r["codes"]) for r in packs.read_pack(spark, path).collect())
    place = lambda k: divmod(k, 3) if k < 400 else (134 + (k - 400) // 3, (k - 400) % 3)
    assert got == [(f"{k:06d}", place(k)[0], place(k)[1], place(k)[1], [[k], [1]]) for k in range(1000)]


def test_key_estimates(spark):
    from corpusmill.operators import keys

    chroma = lambda bins: [1.0 if k in bins else 0.0 for k in range(12)]
    rows = [(1, chroma((0, 4, 7))), (2, chroma((9, 0, 4))), (3, chroma((6, 10, 1))), (4, [0.0] * 12), (5, [0.5] * 12), (6, [float("nan")] * 12), (7, chroma((0, 4, 7)) + [0.0]), (8, None)]
    got = {r["k"]: r["key"] for r in keys.with_key(spark.createDataFrame(rows, "k int, c array<double>"), F.col("c"), "key").collect()}
    assert got == {1: "c_major", 2: "a_minor", 3: "f_sharp_major", 4: None, 5: None, 6: None, 7: None, 8: None}


def test_folders_of_odd_names_are_ordered_as_in_sql(spark, tmp_path):
    from oracle import assert_same

    from corpusmill.plans import CATALOG

    names = ["w10", "w2", "w02", None, "", "zz", "a", "x" + "1" * 19, "x" + "9" * 19, "y" + "1" * 25, "z" + "0" * 20 + "3", "v4\n", "w9223372036854775807", "-5"]
    rows = [(name, k * 100 + i) for k, name in enumerate(names) for i in range(1 + (7 * k) % 13)]
    spark.createDataFrame(rows, "source string, doc_id long").coalesce(1).write.parquet(str(tmp_path / "all"))
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    full = CATALOG["spill_allocation_full"]
    assert full(spark, str(tmp_path)).count() > 6
    assert_same(spark, str(tmp_path), full, full.sql)


def test_candidates_keep_links_between_texts_of_one_signature(spark, tmp_path):
    from oracle import assert_same

    from corpusmill.plans import CATALOG

    texts = ["one two three four", "four three two one", "one two three four", "four three two one", "One two  three four", "something else altogether here", None, ""]
    rows = [(k, x) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "all"))
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    query = CATALOG["band_candidates"]
    got = {tuple(r) for r in query(spark, str(tmp_path)).select("a", "b", "bits", "copy").collect()}
    assert got == {(0, 2, 0, True), (1, 3, 0, True), (0, 1, 0, False), (0, 4, 0, False), (1, 4, 0, False)}
    assert_same(spark, str(tmp_path), query, query.sql)


def test_simhashes_do_not_depend_on_what_is_laid_out_at_once(spark):
    from corpusmill.functions import kernels

    rows = [(k, [f"w{(k * 31 + i) % 997}" for i in range(1 + k * 7 % 90)]) for k in range(60)] + [(60, [])]
    df = spark.createDataFrame(rows, "k long, w array<string>").coalesce(1)
    features = df.select("k", F.explode("w").alias("_x")).select("k", F.conv(F.substring(F.sha1(F.col("_x").cast("binary")), 1, 8), 16, 10).cast("long").alias("h"))
    expected = {tuple(r) for r in dedup.simhash(features, "k", "h").collect()}
    for most, held in ((1, 1), (16, 40), (1 << 17, 200_000)):
        assert {tuple(r) for r in kernels.word_simhashes(df, "k", "w", held=held, most=most).collect()} == expected


def test_backends_work_on_bounded_slices(spark):
    from corpusmill.functions import kernels

    df = spark.createDataFrame([(k, None if k == 3 else "YQ==" * k if k != 5 else "%") for k in range(9)], "k long, v string").coalesce(1)
    expected = {(k, None if k in (3, 5) else "a" * k if k < 2 else None) for k in range(9)}
    for most in (1, 4 << 20):
        got = kernels.mapped(df, "k", "v", "base64", most=most).collect()
        assert {r["k"] for r in got if r["error"] is None} >= {k for k, v in expected if v is not None} and len(got) == 9
        assert all((r["result"] is None) != (r["error"] is None) for r in got)


def test_tiles_of_a_pass_share_one_worker(spark):
    from corpusmill.operators import similarity

    v = spark.createDataFrame([(k, [float(k % 7), float(k % 5) - 2, 1.0]) for k in range(50)], "id long, v array<double>")
    found = similarity.nearest(v, "id", "v", v, "id", "v", 3, tile=20)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    whole = similarity.nearest(v, "id", "v", v, "id", "v", 3, tile=1000)
    assert sorted(found.collect()) == sorted(whole.collect())


def test_most_frequent_counts_values_whatever_their_hashes(spark):
    rows = [("a", f"x{k}") for k in range(40) for _ in range(1 + k % 5)] + [(None, "y"), (None, "y"), (None, "z"), ("b", "q")]
    df = spark.createDataFrame(rows, "g string, v string")
    expected = {("a", "x14", 5), ("a", "x19", 5), ("a", "x24", 5), (None, "y", 2), (None, "z", 1), ("b", "q", 1)}
    for hashed in (None, F.pmod(F.xxhash64("v"), F.lit(5)), F.lit(0)):
        assert {tuple(r) for r in ranking.most_frequent(df, "g", "v", 3, hashed).collect()} == expected
    shuffled = ranking.most_frequent(df, "g", "v", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in shuffled  # what is left reads the few values that were counted


def test_sketches_are_not_kept_for_each_distinct_text(spark, sf_dir):
    from corpusmill.plans import CATALOG

    plan = CATALOG["approximate_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert all("approx_count_distinct" not in line or "_t" not in line.split("functions=")[0] for line in plan.splitlines())
    assert not any("approx_count_distinct" in line and "md5" in line for line in plan.splitlines())
