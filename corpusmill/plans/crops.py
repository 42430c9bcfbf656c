"""Queries on crops, signals and arrays: windows into songs, refined times, keys, frames and signal gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import arrays as A
from corpusmill.functions import folds
from corpusmill.operators import crops, keys, quality
from corpusmill.plans.catalog import Tables, query
from corpusmill.streaming import frames

_U = "(CAST('0x' || substr(md5('{salt}:' || conv_id), 1, 12) AS BIGINT) / 281474976710656.0)"
_SEG, _RATE = 60, 10.0


def _songs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Conversations as songs of 7 frames a turn, and their turns as words of 0.4 seconds."""
    songs = t.conversations.groupBy("conv_id").agg((F.count(F.lit(1)) * 7 + 40).alias("frames"))
    words = t.conversations.where("turn % 3 <> 2").select("conv_id", (F.col("turn") * 0.7).alias("start"), (F.col("turn") * 0.7 + 0.4).alias("end"), "role")
    return songs, words


_CROPS = f"""
    s AS (SELECT conv_id, count(*) * 7 + 40 AS frames FROM conversations GROUP BY 1),
    w AS (SELECT conv_id, turn * 0.7::DOUBLE AS a, turn * 0.7::DOUBLE + 0.4 AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE turn % 3 <> 2),
    p AS (SELECT s.conv_id, frames, greatest(frames - {_SEG}, 0) AS top, a, b FROM s LEFT JOIN w ON w.conv_id = s.conv_id AND w.i = floor({_U.format(salt='word').replace('conv_id', 's.conv_id')} * w.n) + 1),
    r AS (SELECT *, greatest(0.0, b - {_SEG / _RATE}) AS lo, least(top / {_RATE}, a) AS hi FROM p),
    c AS (SELECT conv_id, frames, CASE WHEN {_U.format(salt='coin')} < 0.9 AND coalesce(lo <= hi, false) AND top > 0
        THEN greatest(0, least(CAST(round((lo + {_U.format(salt='place')} * (hi - lo)) * {_RATE}) AS BIGINT), top)) ELSE CAST(floor({_U.format(salt='start')} * (top + 1)) AS BIGINT) END AS crop_start FROM r)"""


@query("WIN-17", f"WITH {_CROPS} SELECT conv_id, crop_start FROM c")
def crop_starts(t: Tables) -> DataFrame:
    songs, words = _songs(t)
    return crops.crop_starts(songs, words, "conv_id", "frames", "start", "end", _SEG, _RATE).select("conv_id", "crop_start")


@query("ARR-04 FLT-24", f"""
    WITH {_CROPS} SELECT conv_id, array_to_string(list_transform(range({_SEG}), lambda k: CASE WHEN crop_start + k < frames THEN CAST((crop_start + k) * 2 AS VARCHAR) ELSE '-1' END), ',') AS row
    FROM c WHERE frames >= {_SEG} AND conv_id IN (SELECT conv_id FROM conversations WHERE turn % 3 <> 2)""")
def aligned_crops(t: Tables) -> DataFrame:
    """The second codebook of each crop, by value twice its frame; of songs with words that fill a crop."""
    songs, words = _songs(t)
    pool = crops.eligible(songs, words, "conv_id", "frames", _SEG)
    rows = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.transform(F.sequence(F.lit(0), (F.col("frames") - 1).cast("int")), lambda f: f * k))
    starts = crops.crop_starts(pool, words, "conv_id", "frames", "start", "end", _SEG, _RATE).withColumn("codes", rows)
    return starts.select("conv_id", F.array_join(crops.crop(F.col("codes"), F.col("crop_start"), _SEG, 2, -1)[1], ",").alias("row"))


@query("AGG-30 JOIN-07", f"""
    WITH {_CROPS}, u AS (SELECT conv_id, frames, crop_start, CAST(floor({_U.format(salt='start')} * (greatest(frames - {_SEG}, 0) + 1)) AS BIGINT) AS plain FROM c),
    h AS (SELECT u.conv_id, count(w.conv_id) FILTER (w.b > plain / {_RATE} AND w.a < (plain + {_SEG}) / {_RATE}) AS n_plain, count(w.conv_id) FILTER (w.b > crop_start / {_RATE} AND w.a < (crop_start + {_SEG}) / {_RATE}) AS n_biased
        FROM u LEFT JOIN w USING (conv_id) GROUP BY u.conv_id)
    SELECT count(*) AS n, count(*) FILTER (n_plain = 0) AS zero_uniform, count(*) FILTER (n_biased = 0) AS zero_biased, quantile_cont(6 + 2 * n_biased, 0.5)::DOUBLE AS p50, quantile_cont(6 + 2 * n_biased, 0.95)::DOUBLE AS p95,
        CAST(max(6 + 2 * n_biased) AS BIGINT) AS most, count(*) FILTER (6 + 2 * n_biased > 256) AS over_256, count(*) FILTER (6 + 2 * n_biased > 512) AS over_512 FROM h""")
def crop_supervision(t: Tables) -> DataFrame:
    """Crops without a word under both ways to draw them, and lengths of their streams."""
    songs, words = _songs(t)
    biased = crops.crop_starts(songs, words, "conv_id", "frames", "start", "end", _SEG, _RATE)
    plain = crops.crop_starts(songs, words, "conv_id", "frames", "start", "end", _SEG, _RATE, bias=0.0)
    at = F.col("crop_start") / _RATE
    count = lambda s, name: crops.words_in(s, words, "conv_id", at, (F.col("crop_start") + _SEG) / _RATE, "start", "end").withColumnRenamed("n", name)
    both = count(plain, "a").join(count(biased, "b"), "conv_id").withColumn("size", 6 + 2 * F.col("b"))
    n = lambda c: F.count(F.when(c, 1))
    return both.agg(
        F.count(F.lit(1)).alias("n"), n(F.col("a") == 0).alias("zero_uniform"), n(F.col("b") == 0).alias("zero_biased"), F.percentile("size", F.lit(0.5)).alias("p50"),
        F.percentile("size", F.lit(0.95)).alias("p95"), F.max("size").alias("most"), n(F.col("size") > 256).alias("over_256"), n(F.col("size") > 512).alias("over_512"),
    )


_DRAWS = 32


@query("AGG-30", f"""
    WITH s AS (SELECT conv_id, greatest(count(*) * 7 + 40 - {_SEG}, 0) AS top FROM conversations GROUP BY 1), w AS (SELECT conv_id, turn * 0.7::DOUBLE AS a, turn * 0.7::DOUBLE + 0.4 AS b FROM conversations WHERE turn % 3 <> 2),
    x AS (SELECT s.conv_id, unnest(range(top + 1)) AS f FROM s),
    h AS (SELECT x.conv_id, f, EXISTS (SELECT 1 FROM w WHERE w.conv_id = x.conv_id AND b > f / {_RATE} AND a < (f + {_SEG}) / {_RATE}) AS word FROM x),
    g AS (SELECT conv_id, count(*) AS n_starts, count(*) FILTER (NOT word) AS n_wordless FROM h GROUP BY 1),
    d AS (SELECT conv_id, CAST(floor(CAST('0x' || substr(md5('draw:' || k || ':' || conv_id), 1, 12) AS BIGINT) / 281474976710656.0 * (top + 1)) AS BIGINT) AS f FROM s, range({_DRAWS}) r(k)),
    e AS (SELECT d.conv_id, count(*) AS n_draws, count(*) FILTER (NOT word) AS n_empty FROM d JOIN h ON h.conv_id = d.conv_id AND h.f = d.f GROUP BY 1)
    SELECT conv_id, n_starts, n_wordless, n_draws, n_empty FROM g JOIN e USING (conv_id)""")
def wordless_crops(t: Tables) -> DataFrame:
    """From how many frames of each song a crop holds no word, by a sweep over the words, beside seeded draws."""
    songs, words = _songs(t)
    exact = crops.wordless_share(songs, words, "conv_id", "frames", "start", "end", _SEG, _RATE)
    return exact.join(crops.drawn_wordless(songs, words, "conv_id", "frames", "start", "end", _SEG, _RATE, _DRAWS), "conv_id")


@query("JOIN-09", """
    WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
    x AS (SELECT user_id, pos, event_type IN ('view', 'click', 'error') AS word, event_type AS value FROM e),
    k AS (SELECT *, bool_or(word) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS follows FROM x)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS place, CASE WHEN word THEN 'word' ELSE 'section' END AS kind, value FROM k WHERE follows""")
def section_injection(t: Tables) -> DataFrame:
    """Signups and purchases as boundaries among other events: each before the next word, the last ones dropped."""
    e = t.events.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("double").alias("at"))
    word = F.col("event_type").isin("view", "click", "error")
    return crops.injected(e.where(word), e.where(~word), "user_id", "at", "event_type", "at", "event_type")


@query("WIN-06 UDF-06", """
    WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value / 10 AS v, event_id % 4 = 0 AS missing FROM events WHERE value IS NOT NULL),
    x AS (SELECT user_id, i, missing, i * 5.0 + v AS s, i * 5.0 + v + 4 AS t, i * 6.0 AS os, i * 6.0 + 3 AS oe FROM e),
    r(user_id, i, cur, a, b) AS (
        SELECT user_id, i, CASE WHEN missing THEN greatest(0.0, oe) ELSE greatest(t, greatest(s, 0.0) + 0.001) END, CASE WHEN missing THEN os ELSE greatest(s, 0.0) END, CASE WHEN missing THEN oe ELSE greatest(t, greatest(s, 0.0) + 0.001) END FROM x WHERE i = 1
        UNION ALL SELECT x.user_id, x.i, CASE WHEN missing THEN greatest(cur, oe) ELSE greatest(t, greatest(s, cur) + 0.001) END, CASE WHEN missing THEN os ELSE greatest(s, cur) END,
            CASE WHEN missing THEN oe ELSE greatest(t, greatest(s, cur) + 0.001) END FROM r JOIN x ON x.user_id = r.user_id AND x.i = r.i + 1)
    SELECT user_id, i, round(a, 3) AS a, round(b, 3) AS b FROM r""")
def monotone_clamp(t: Tables) -> DataFrame:
    """All events of a user as words with refined spans, of which every fourth is missing, streamed in order through a fold."""
    e = t.events.where("value is not null").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    v, refined = F.col("value") / 10, F.col("event_id") % 4 != 0
    spans = e.select(
        "user_id", "i", F.when(refined, F.col("i") * 5.0 + v).alias("start"), F.when(refined, F.col("i") * 5.0 + v + 4).alias("end"),
        (F.col("i") * 6.0).alias("own_start"), (F.col("i") * 6.0 + 3).alias("own_end"),
    )
    return folds.clamped(spans, ["user_id"], ["i"]).select("user_id", "i", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))


_KEY_VALUES = ", ".join(f"({k}, '{name}', [{', '.join(map(repr, shape))}])" for k, (name, shape) in enumerate(keys.profiles()))


@query("JOIN-18", f"""
    WITH e AS (SELECT vec_id, list_transform(range(12), lambda k: list_sum(list_transform(range(k + 1, 65, 12), lambda i: abs(embedding[i]::DOUBLE)))) AS c FROM embeddings),
    z AS (SELECT vec_id, list_transform(c, lambda x: (x - list_avg(c)) / list_stddev_pop(c)) AS z FROM e),
    k(k, name, p) AS (VALUES {_KEY_VALUES}), f AS (SELECT vec_id, k, name, list_dot_product(z, p::DOUBLE[]) AS fit FROM z, k)
    SELECT vec_id, name AS key FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY fit DESC, k) = 1""")
def key_estimate(t: Tables) -> DataFrame:
    """The key of each vector: its values, taken for semitones, folded into twelve pitch classes."""
    chroma = keys.folded_chroma(F.col("embedding"))
    return keys.with_key(t.embeddings.select("vec_id", chroma.alias("c")), F.col("c"), "key").select("vec_id", "key")


@query("AGG-29", """
    WITH x AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) SELECT label, i, round(m, 6) AS mean FROM x""")
def mean_chroma(t: Tables) -> DataFrame:
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    return cells.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean")).select("label", F.col("i").cast("long").alias("i"), "mean")


_FIG = """
    f AS (SELECT vec_id, label, list_transform(embedding, lambda x: greatest(-1.0, least(1.0, x::DOUBLE * 3))) AS x FROM embeddings),
    g AS (SELECT *, list_avg(list_transform(x, lambda v: CASE WHEN abs(v) >= 0.992 THEN 1.0 ELSE 0.0 END)) AS clip, 20 * log10(greatest(sqrt(list_avg(list_transform(x, lambda v: v * v))), 1e-10)) AS db,
        list_avg(list_transform(range(12), lambda k: CASE WHEN 20 * log10(greatest(sqrt(list_avg(list_transform(x[k * 5 + 1 : k * 5 + 5], lambda v: v * v))), 1e-10)) < -50 THEN 1.0 ELSE 0.0 END)) AS silent FROM f)"""


@query("FLT-06 WIN-09", f"WITH {_FIG} SELECT vec_id, round(clip, 6) AS clip, round(silent, 6) AS silent, round(db, 6) AS db, clip > 0.02 AS clipped, label % 4 = 1 AS low_rate FROM g")
def signal_gate(t: Tables) -> DataFrame:
    """Vectors as recordings at 100 samples a second: clipping, silent frames of 50 ms, level and bit rate."""
    x = F.transform("embedding", lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double") * 3)))
    made = t.embeddings.select("vec_id", "label", x.alias("x"))
    told = made.withColumns(quality.signal_figures(F.col("x"), F.lit(100)))
    reasons = quality.signal_reasons(F.col("clip_ratio"), F.col("silent_ratio"), F.col("rms_dbfs"), F.when(F.col("label") % 4 == 1, 64_000))
    has = lambda word: F.exists(reasons, lambda r: r.startswith(word))
    return told.select("vec_id", F.round("clip_ratio", 6).alias("clip"), F.round("silent_ratio", 6).alias("silent"), F.round("rms_dbfs", 6).alias("db"), has("clipped").alias("clipped"), has("lowbitrate").alias("low_rate"))


@query("FLT-07", """
    WITH f AS (SELECT vec_id, CASE WHEN label = 2 THEN list_transform(embedding, lambda x: x::DOUBLE * 1e-4) WHEN label = 5 THEN list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -0.2 END) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS x FROM embeddings)
    SELECT vec_id, CASE WHEN 20 * log10(sqrt(list_avg(list_transform(x, lambda v: v * v))) + 1e-12) < -50 THEN 'silent' WHEN list_avg(list_transform(x, lambda v: CASE WHEN abs(v) >= 0.9995 THEN 1.0 ELSE 0.0 END)) > 0.2 THEN 'clipped' END AS reason FROM f""")
def encode_reason(t: Tables) -> DataFrame:
    """Quiet and clipped vectors among others."""
    x = F.transform("embedding", lambda v: F.when(F.col("label") == 2, v.cast("double") * 1e-4).when(F.col("label") == 5, F.when(v > 0, 1.0).otherwise(-0.2)).otherwise(v.cast("double")))
    return t.embeddings.select("vec_id", quality.encode_reason(x).alias("reason"))


@query("FLT-08", "SELECT doc_id % 2 = 0 AS stereo, count(*) FILTER (n_chars / 20.0 > CASE WHEN doc_id % 2 = 0 THEN 360 ELSE 420 END) AS over FROM documents GROUP BY 1")
def length_ceiling(t: Tables) -> DataFrame:
    stereo = F.col("doc_id") % 2 == 0
    over = quality.over_ceiling(F.col("n_chars") / 20.0, F.when(stereo, 2).otherwise(1))
    return t.documents.groupBy(stereo.alias("stereo")).agg(F.count(F.when(over, 1)).alias("over"))


@query("FLT-23", """
    WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 1000) AS BIGINT)) AS c FROM embeddings),
    s AS (SELECT vec_id, CASE label WHEN 4 THEN c[1:60] WHEN 6 THEN list_transform(c, lambda x: 7::BIGINT) WHEN 8 THEN list_transform(c, lambda x: CASE WHEN x > 100 THEN 1024 ELSE x END) ELSE c END AS c FROM e)
    SELECT vec_id, list_max(c) > 1024 OR list_min(c) < 0 AS out_of_range, len(c) <> 64 AS misaligned, len(list_distinct(c)) = 1 AS dead, round(list_avg(list_transform(c, lambda x: CASE WHEN x = 1024 THEN 1.0 ELSE 0.0 END)), 6) AS pads FROM s""")
def stem_sidecars(t: Tables) -> DataFrame:
    """Content checks of stems, of which some are cut short, some constant and some padded: each is told from its array alone."""
    c = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000))
    label = F.col("label")
    padded = F.transform("c", lambda x: F.when(x > 100, F.lit(1024).cast("long")).otherwise(x))
    stem = F.when(label == 4, F.slice("c", 1, 60)).when(label == 6, F.transform("c", lambda x: F.lit(7).cast("long"))).when(label == 8, padded).otherwise(F.col("c"))
    made = t.embeddings.select("vec_id", "label", c.alias("c")).select("vec_id", stem.alias("codes"), F.lit(64).alias("frames"))
    told = quality.stem_content(F.col("codes"), F.col("frames"))
    return made.select("vec_id", told["out_of_range"].alias("out_of_range"), told["misaligned"].alias("misaligned"), told["dead"].alias("dead"), F.round(told["pads"], 6).alias("pads"))


@query("WIN-08 UDF-04", r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, k AS chunk, md5(array_to_string(w[k * 72 + 1 : k * 72 + 72], ' ')) AS digest FROM (SELECT doc_id, w, unnest(range(CAST(least(ceil(len(w) / 72.0), 16) AS BIGINT))) AS k FROM w)""")
def word_chunks(t: Tables) -> DataFrame:
    """Texts in chunks of 72 words, 16 at most."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    made = t.documents.select("doc_id", w.alias("w")).select("doc_id", F.posexplode(A.chunks_of(F.col("w"), 72, 16)).alias("k", "c"))
    return made.select("doc_id", F.col("k").cast("long").alias("chunk"), F.md5(F.array_join("c", " ").cast("binary")).alias("digest"))


@query("WIN-18 WIN-19", """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
    r AS (SELECT vec_id, list_transform(range(40), lambda i: x[1 + CAST(floor(i * 63 / 39.0) AS BIGINT)] + (i * 63 / 39.0 - floor(i * 63 / 39.0)) * (x[1 + least(CAST(floor(i * 63 / 39.0) AS BIGINT) + 1, 63)] - x[1 + CAST(floor(i * 63 / 39.0) AS BIGINT)])) AS y FROM e)
    SELECT vec_id, array_to_string(list_transform(y, lambda v: printf('%.4f', v / greatest(sqrt(list_sum(list_transform(y, lambda u: u * u))), 1e-9) + 0.00000001)), ',') AS y FROM r""")
def resampled(t: Tables) -> DataFrame:
    """64 values brought to 40 places by linear interpolation, then scaled to length one."""
    made = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    made = made.select("vec_id", A.resample(F.col("x"), 40).alias("y")).select("vec_id", A.l2_normalised(F.col("y")).alias("y"))  # each a column of its own, computed once
    return made.select("vec_id", F.array_join(F.transform("y", lambda v: F.format_string("%.4f", v + 0.00000001)), ",").alias("y"))


@query("WIN-20", """
    WITH e AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS a, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS b FROM embeddings)
    SELECT vec_id, round(list_sum(a[1:24]) + list_sum(b[9:32]) + list_sum(list_transform(range(8), lambda i: a[25 + i] * cos(i * pi() / 14) + b[1 + i] * sin(i * pi() / 14))), 6) AS total, 56 AS n FROM e""")
def crossfade(t: Tables) -> DataFrame:
    """Two halves of a vector joined by an equal-power fade over eight values."""
    half = lambda k: F.transform(F.slice("embedding", k, 32), lambda x: x.cast("double"))
    made = t.embeddings.select("vec_id", half(1).alias("a"), half(33).alias("b")).select("vec_id", A.crossfaded(F.col("a"), F.col("b"), 8).alias("x"))
    return made.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda t, x: t + x), 6).alias("total"), F.size("x").alias("n"))


@query("MTH-10", """
    WITH f AS (SELECT doc_id, n_chars AS n, (n_chars + 511) // 512 AS frames, ((n_chars + 511) // 512 + 7) // 8 * 8 AS grid FROM documents),
    g AS (SELECT *, CASE WHEN grid * 512 <= n OR grid * 512 > 20000 THEN n ELSE grid * 512 END AS padded FROM f)
    SELECT doc_id, frames, padded, CASE WHEN ceil(padded / 48000.0::DOUBLE * 93.75) <> (padded + 511) // 512 THEN padded + 256 ELSE padded END AS safe, round(frames * 0.01::DOUBLE, 6) AS start, round(greatest(frames * 0.01::DOUBLE + 0.001::DOUBLE, frames * 0.01::DOUBLE), 6) AS stop FROM g""")
def frame_arithmetic(t: Tables) -> DataFrame:
    """Samples to frames, frames up to a grid of eight under a ceiling, a guard against rounding up, frames to seconds."""
    made = t.documents.select("doc_id", A.frame_count(F.col("n_chars"), 512).alias("frames"), A.bucketed_samples(F.col("n_chars"), 512, 8, 20_000).alias("padded"))
    span = A.frames_to_seconds(F.col("frames"), F.col("frames"), F.lit(100), F.lit(1.0))
    return made.select("doc_id", "frames", "padded", A.frame_safe(F.col("padded"), 512, 48_000, 93.75).alias("safe"), F.round(span["start"], 6).alias("start"), F.round(span["end"], 6).alias("stop"))


@query("MTH-13 MTH-18", """
    WITH e AS (SELECT vec_id, list_transform(range(4), lambda k: list_sum(list_transform(embedding[16 * k + 1 : 16 * k + 16], lambda x: x::DOUBLE))) AS m, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS s,
        list_transform(embedding[33:64], lambda x: x::DOUBLE) AS o FROM embeddings)
    SELECT vec_id, round(m[1] + 2.0 * (m[2] - m[1]) + 3.0 * (m[3] - m[2]) + 0.5 * (m[4] - m[3]), 6) AS guided, round(list_dot_product(s, o) / greatest(sqrt(list_dot_product(s, s)) * sqrt(list_dot_product(o, o)), 1e-9), 6) AS cosine FROM e""")
def guidance(t: Tables) -> DataFrame:
    """Sums of the quarters of a vector blended as four conditions, and the cosine of its halves."""
    part = lambda k, n: F.transform(F.slice("embedding", k, n), lambda x: x.cast("double"))
    quarters = F.array(*[F.aggregate(part(16 * k + 1, 16), F.lit(0.0), lambda a, x: a + x) for k in range(4)])
    made = t.embeddings.select("vec_id", quarters.alias("m"), part(1, 32).alias("s"), part(33, 32).alias("o"))
    blend = A.guided(F.element_at("m", 1), F.col("m"), F.array(F.lit(2.0), F.lit(3.0), F.lit(0.5)))
    return made.select("vec_id", F.round(blend, 6).alias("guided"), F.round(A.cosine(F.col("s"), F.col("o")), 6).alias("cosine"))


@query("MTH-16", """
    WITH f AS (SELECT vec_id, list_filter(list_transform(embedding, lambda x: 160 + 100 * x::DOUBLE), lambda x: x > 60) AS f0, label FROM embeddings), g AS (SELECT vec_id, CASE WHEN label = 1 THEN f0[1:20] ELSE f0 END AS f0 FROM f)
    SELECT vec_id, CASE WHEN len(f0) < 50 THEN NULL WHEN list_median(f0) >= 165 THEN 'female' ELSE 'male' END AS gender FROM g""")
def vocal_gender(t: Tables) -> DataFrame:
    """From pitches of voiced frames: unknown below 50 of them, else by their median."""
    f0 = F.filter(F.transform("embedding", lambda x: 160 + 100 * x.cast("double")), lambda x: x > 60)
    made = t.embeddings.select("vec_id", F.when(F.col("label") == 1, F.slice(f0, 1, 20)).otherwise(f0).alias("f0"))
    return made.select("vec_id", A.gender_of_pitch(F.col("f0")).alias("gender"))


@query("MTH-19", """
    WITH d AS (SELECT doc_id, n_chars AS n, greatest(1, least(CAST(floor(doc_id % 50 * 25.0) AS BIGINT), n_chars)) AS cut FROM documents), b AS (SELECT *, n - cut AS rest, n // 2 + 10 AS budget FROM d)
    SELECT doc_id, cut, greatest(0, cut - 75) AS seed, CASE WHEN cut + rest > budget THEN least(cut, budget - least(rest, budget // 2)) ELSE cut END AS head, CASE WHEN cut + rest > budget THEN least(rest, budget // 2) ELSE rest END AS tail FROM b""")
def cut_points(t: Tables) -> DataFrame:
    """Where to go on from in a recording, the seed before that, and a context split between its two sides."""
    n = F.col("n_chars")
    cut = A.cut_frame((F.col("doc_id") % 50).cast("double"), 25, n)
    made = t.documents.select("doc_id", cut.alias("cut"), (n - cut).alias("rest"), (F.floor(n / 2) + 10).alias("budget"))
    split = A.context_split(F.col("cut"), F.col("rest"), F.col("budget"))
    return made.select("doc_id", "cut", F.greatest(F.lit(0), F.col("cut") - 75).cast("long").alias("seed"), split["head"].alias("head"), split["tail"].alias("tail"))


@query("STM-07", """
    WITH c AS (SELECT conv_id, turn, lag(turn, 1) OVER w AS a, lag(turn, 2) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id AS stream, turn AS chunk, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS BIGINT) AS warm_up, CAST(coalesce(a, 0) + coalesce(b, 0) + turn AS BIGINT) AS total FROM c""")
def left_context(t: Tables) -> DataFrame:
    """Chunks of one frame with the two frames before them in front."""
    chunks = t.conversations.select(F.col("conv_id").alias("stream"), F.col("turn").alias("chunk"), F.array("turn").alias("frames"))
    out = frames.with_left_context(chunks, 2)
    return out.select("stream", "chunk", F.col("warm_up").cast("long").alias("warm_up"), F.aggregate("frames", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("STM-06", """
    SELECT CAST(conv_id AS VARCHAR) AS stream, turn AS frame, (turn * 10) || ',' || ((turn + 1) * 10 + 1) || ',' || ((turn + 2) * 10 + 2) AS codes FROM conversations c
    WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1) AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 2)""")
def aligned_frames(t: Tables) -> DataFrame:
    """Frames put together again from steps in which codebook k is k steps late."""
    steps = t.conversations.select(F.col("conv_id").cast("string").alias("stream"), F.col("turn").alias("step"), F.array(*[(F.col("turn") * 10 + k).cast("int") for k in range(3)]).alias("codes"))
    return frames.aligned(steps, 3).select("stream", "frame", F.array_join("codes", ",").alias("codes"))
