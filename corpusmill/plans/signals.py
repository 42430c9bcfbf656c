"""Queries on signals made of the vectors: alignment, spectra, loudness; sketches and centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import signals as S
from corpusmill.operators import similarity, sketches
from corpusmill.plans.catalog import Tables, query

_FRAMES, _SYMBOLS = 16, 4


@query("UDF-06", """
    WITH e AS (SELECT vec_id, 1 + label % 3 AS t1, 1 + (label // 3) % 3 AS t2, list_transform(range(16), lambda f: list_transform(range(4), lambda k: 3 * embedding[4 * f + k + 1]::DOUBLE)) AS x FROM embeddings),
    l AS (SELECT vec_id, t1, t2, list_transform(x, lambda r: list_transform(r, lambda v: v - ln(list_sum(list_transform(r, lambda u: exp(u)))))) AS l FROM e),
    s AS (SELECT vec_id, t1, t2, list_transform(range(17), lambda f: coalesce(list_sum(list_transform(l[1 : f], lambda r: r[1])), 0.0)) AS z, list_transform(range(17), lambda f: coalesce(list_sum(list_transform(l[1 : f], lambda r: r[t1 + 1])), 0.0)) AS a,
        list_transform(range(17), lambda f: coalesce(list_sum(list_transform(l[1 : f], lambda r: r[t2 + 1])), 0.0)) AS b FROM l),
    p AS (SELECT s1, e1, s2, e2 FROM range(16) q(s1), range(1, 17) w(e1), range(16) x(s2), range(1, 17) y(e2) WHERE s1 < e1 AND e1 <= s2 AND s2 < e2),
    c AS (SELECT vec_id, s1, e1, s2, e2, z[s1 + 1] + a[e1 + 1] - a[s1 + 1] + z[s2 + 1] - z[e1 + 1] + b[e2 + 1] - b[s2 + 1] + z[17] - z[e2 + 1] AS score FROM s, p WHERE t1 <> t2 OR s2 > e1)
    SELECT vec_id, round(max(score), 6) AS score, CAST(arg_max(s1, score) AS INT) AS s1, CAST(arg_max(e1, score) AS INT) AS e1, CAST(arg_max(s2, score) AS INT) AS s2, CAST(arg_max(e2, score) AS INT) AS e2 FROM c GROUP BY vec_id""")
def alignment(t: Tables) -> DataFrame:
    """Two words of one symbol each, aligned to 16 frames of four symbols; the SQL tries every pair of spans."""
    values = F.transform("embedding", lambda x: 3 * x.cast("double"))
    made = t.embeddings.select("vec_id", "label", values.alias("x"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(_FRAMES - 1)), lambda f: F.slice("x", f * _SYMBOLS + 1, _SYMBOLS))
    shares = F.transform(rows, lambda r: F.transform(r, lambda v: v - F.ln(F.aggregate(r, F.lit(0.0), lambda a, u: a + F.exp(u)))))
    words = F.array(F.array((1 + F.col("label") % 3).cast("int")), F.array((1 + F.floor(F.col("label") / 3) % 3).cast("int")))
    none = F.lit(None).cast("struct<start:int,end:int>")
    got = S.aligned(made.select("vec_id", shares.alias("e"), words.alias("w"), F.array(none, none).alias("o")), "vec_id", "e", "w", "o")
    at = lambda k, side: F.element_at("spans", k)[side]
    return got.select("vec_id", F.round("score", 6).alias("score"), at(1, "start").alias("s1"), at(1, "end").alias("e1"), at(2, "start").alias("s2"), at(2, "end").alias("e2"))


@query("MTH-17 MTH-09", """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
    w AS (SELECT vec_id, f, k, i, x[f * 8 + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS v FROM e, range(7) a(f), range(9) b(k), range(16) c(i)),
    m AS (SELECT vec_id, f, k, sqrt(sum(v * cos(2 * pi() * k * i / 16)) ** 2 + sum(v * sin(2 * pi() * k * i / 16)) ** 2) AS m FROM w GROUP BY ALL),
    c AS (SELECT vec_id, f, sum(m * k * 6.25) / greatest(sum(m), 1e-9) AS c FROM m GROUP BY ALL),
    d AS (SELECT vec_id, f, sum(greatest(d, 0)) AS flux FROM (SELECT vec_id, f, m - lag(m) OVER (PARTITION BY vec_id, k ORDER BY f) AS d FROM m) WHERE d IS NOT NULL GROUP BY ALL),
    z AS (SELECT vec_id, f, flux - avg(flux) OVER (PARTITION BY vec_id) AS z FROM d),
    r AS (SELECT x.vec_id, y.f - x.f AS lag, sum(x.z * y.z) AS r FROM z x JOIN z y ON y.vec_id = x.vec_id AND y.f > x.f GROUP BY ALL),
    b AS (SELECT vec_id, 60 * 12.5 / lag AS bpm, r * exp(-0.5 * log2(60 * 12.5 / lag / 120) ** 2) AS s FROM r),
    t AS (SELECT vec_id, arg_max(bpm, s) AS bpm FROM b GROUP BY vec_id),
    h AS (SELECT vec_id, sum(m) FILTER (k * 6.25 > 30) / sum(m) AS high FROM m GROUP BY vec_id)
    SELECT vec_id, round(high, 6) AS high_share, round((SELECT avg(c) FROM c WHERE c.vec_id = h.vec_id), 6) AS centroid, round((SELECT avg(flux) FROM d WHERE d.vec_id = h.vec_id), 6) AS flux, round(CASE WHEN bpm >= 180 THEN bpm / 2 ** (floor(log2(bpm / 180)) + 1) WHEN bpm < 60 THEN bpm * 2 ** ceil(log2(60 / bpm)) ELSE bpm END, 6) AS bpm FROM h JOIN t USING (vec_id)""")
def spectra(t: Tables) -> DataFrame:
    """Vectors as signals of 100 samples a second: share of high frequencies, centroid, onset strength and tempo."""
    got = S.with_spectrum(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", 100.0, 16, 8, 30.0)
    return got.select("vec_id", *[F.round(c, 6).alias(c) for c in ("high_share", "centroid", "flux", "bpm")])


@query("MTH-11 SRC-14 SRC-22")
def loudness_gains(t: Tables) -> DataFrame:
    """Each vector's values as the amplitudes of a tone, 25 ms each: integrated loudness and the gain to -16 LUFS. Tested against
    filters step by step and reference tones."""
    tone = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.sin(i * 2 * F.pi() * 440 / 4000))
    made = t.embeddings.select("vec_id", tone.alias("tone"), "embedding")
    samples = F.flatten(F.transform("embedding", lambda a: F.transform("tone", lambda x: x * a.cast("double"))))
    got = S.with_loudness(made.select("vec_id", samples.alias("x")), "vec_id", "x", 4000.0)
    return got.select("vec_id", F.round("lufs", 4).alias("lufs"), F.round("gain", 6).alias("gain"))


@query("JOIN-17 MTH-14", """
    WITH e AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT vec_id % 97 AS center, i, avg(x) AS c FROM e GROUP BY ALL),
    s AS (SELECT vec_id, center, sum(x * c) / greatest(sqrt(sum(x * x)) * sqrt(sum(c * c)), 1e-9) AS sim FROM e JOIN c USING (i) GROUP BY ALL),
    r AS (SELECT vec_id, center, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, center) AS rank FROM s)
    SELECT vec_id, rank, center, round(sim, 6) AS sim FROM r WHERE rank <= 3""")
def nearest_centers(t: Tables) -> DataFrame:
    """The three nearest of 97 centres of each vector, by products of blocks of vectors and tiles of centres."""
    cells = t.embeddings.select((F.col("vec_id") % 97).alias("center"), F.posexplode("embedding").alias("i", "x")).groupBy("center", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centers = cells.groupBy("center").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("v"))
    found = similarity.nearest(t.embeddings, "vec_id", "embedding", centers, "center", "v", 3, tile=40)
    return found.select("vec_id", F.posexplode("nearest").alias("rank", "n")).select("vec_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("n.id").alias("center"), F.round("n.sim", 6).alias("sim"))


@query("AGG-37", r"""
    WITH w AS (SELECT lang, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM documents), n AS (SELECT lang, count(DISTINCT w) AS words FROM w GROUP BY lang)
    SELECT lang, words, true AS words_inside, true AS median_inside, true AS top_inside FROM n""")
def merged_sketches(t: Tables) -> DataFrame:
    """Sketches stored for each source and merged for each language: whether distinct words, the median length and the most frequent
    words they tell lie within their stated bounds of the exact values, which stand beside them in sketch_errors."""
    return sketches.held_against_exact(t.documents, "source", "lang").select("lang", "words", "words_inside", "median_inside", "top_inside")


@query("AGG-37")
def sketch_errors(t: Tables) -> DataFrame:
    """The measured errors of the same sketches."""
    return sketches.held_against_exact(t.documents, "source", "lang")
