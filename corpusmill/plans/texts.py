"""Queries on texts: gates, facets, audits, coverage, chunks and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import quality, ranking
from corpusmill.plans.catalog import Tables, query

_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '\s+'), lambda x: x <> '')"
_N = f"CAST(len({_WORDS.format('text')}) AS BIGINT)"
#: Phrases that occur in the tables' invented languages.
PHRASES = ("license", "example.com", "the and", "que de", "worthless")
FACETS = X.CAPTION_FACETS


def _phrase_case(low: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({low}, '{p}') THEN 'junk:{p}'" for p in PHRASES) + " END"


_JUNK = f"""CASE WHEN n < 6 THEN 'short' WHEN n < 300 AND {_phrase_case('lower(text)')} IS NOT NULL THEN {_phrase_case('lower(text)')} END"""


def _judged(t: Tables) -> DataFrame:
    n = X.word_count(F.col("text"))
    return t.documents.select("doc_id", n.alias("n_words"), X.junk_reason(F.col("text"), n, phrases=PHRASES, junk_words=300).alias("reason"))


@query("FLT-02", f"SELECT doc_id, n AS n_words, {_JUNK} AS reason FROM (SELECT *, {_N} AS n FROM documents)")
def junk_reason(t: Tables) -> DataFrame:
    return _judged(t)


@query("FLT-03", f"""
    WITH r AS (SELECT {_JUNK} AS reason FROM (SELECT *, {_N} AS n FROM documents))
    SELECT coalesce(split_part(reason, ':', 1), 'kept') AS family, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM r GROUP BY 1""")
def junk_by_reason(t: Tables) -> DataFrame:
    judged = _judged(t)
    total = judged.agg(F.count(F.lit(1)).alias("_t"))
    family = F.coalesce(F.split("reason", ":")[0], F.lit("kept"))
    return judged.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("family", "n", F.round(F.col("n") / F.col("_t"), 9).alias("share"))


@query("FLT-17 WIN-10", f"""
    WITH d AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents),
    g AS (SELECT doc_id, max(c) AS most FROM (SELECT doc_id, gram, count(*) AS c FROM
          (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS gram FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)) GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, len(w) >= 20 AND (len(list_distinct(w)) / greatest(len(w), 1) < 0.4 OR coalesce(most, 0) >= 3) AS loops FROM d LEFT JOIN g USING (doc_id)""")
def repetition_loop(t: Tables) -> DataFrame:
    return X.with_repetition_loop(t.documents.select("doc_id", "text"), "text", "loops").drop("text")


@query("WIN-10", f"""
    WITH d AS (SELECT lang, {_WORDS.format('lower(text)')} AS w FROM documents)
    SELECT lang, gram, count(*) AS n FROM (SELECT lang, array_to_string(w[i : i + 4], ' ') AS gram FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)) GROUP BY lang, gram
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= 3""")
def ngram5(t: Tables) -> DataFrame:
    d = t.documents.select("lang", X.words(F.lower("text")).alias("w")).where(F.size("w") >= 5)
    grams = d.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice("w", i, 5), " "))).alias("gram"))
    return ranking.most_frequent(grams, "lang", "gram", 3)


_FLAGS = {k: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in v) + ")" for k, v in FACETS.items()}


@query("FLT-15", f"SELECT doc_id, {', '.join(f'{sql} AS {k}' for k, sql in _FLAGS.items())} FROM documents")
def facet_flags(t: Tables) -> DataFrame:
    low = F.lower("text")
    return t.documents.select("doc_id", *[X.contains_any(low, v).alias(k) for k, v in FACETS.items()])


@query("AGG-10", f"""
    WITH f AS (SELECT {' + '.join(f'CAST({sql} AS INT)' for sql in _FLAGS.values())} AS k FROM documents)
    SELECT count(*) AS n, count(*) FILTER (k >= 4) AS rich, count(*) FILTER (k <= 1) AS thin, CAST(quantile_cont(k, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(k, 0.9) AS DOUBLE) AS p90 FROM f""")
def facet_coverage(t: Tables) -> DataFrame:
    low = F.lower("text")
    k = sum((X.contains_any(low, v).cast("int") for v in FACETS.values()), F.lit(0))
    f = t.documents.select(k.alias("k"))
    return f.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("k") >= 4, 1)).alias("rich"), F.count(F.when(F.col("k") <= 1, 1)).alias("thin"), F.percentile("k", F.lit(0.5)).alias("p50"), F.percentile("k", F.lit(0.9)).alias("p90"))


#: Word edges are spelled out: engines differ in what letters beyond ASCII mean to a word edge.
_WORD = r"(?:\A|[^\p{L}\p{N}_])%s(?:[^\p{L}\p{N}_]|\z)"
_RX = {**{w: _WORD % w for w in ("the", "und", "les")}, "shout": r"[A-Z]{4,}!!"}


@query("FLT-18 AGG-33", " UNION ALL ".join(f"""
    SELECT '{k}' AS pattern, count(*) FILTER (regexp_matches(text, '{rx}')) AS hits, round(100.0 * count(*) FILTER (regexp_matches(text, '{rx}')) / count(*), 9) AS percent,
    CASE WHEN 100.0 * count(*) FILTER (regexp_matches(text, '{rx}')) / count(*) >= 4 AND count(*) FILTER (regexp_matches(text, '{rx}')) >= 200 THEN 'CLOSED' ELSE 'OPEN' END AS verdict FROM documents""" for k, rx in _RX.items()))
def regex_floor_verdict(t: Tables) -> DataFrame:
    counted = t.documents.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("text").rlike(rx), 1)).alias(k) for k, rx in _RX.items()])
    rows = counted.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(k).alias("hits")) for k in _RX])).alias("r")).select("n", "r.*")
    percent = 100.0 * F.col("hits") / F.col("n")
    return rows.select("pattern", "hits", F.round(percent, 9).alias("percent"), ranking.floor_verdict(F.col("hits"), percent, 4.0, 200).alias("verdict"))


@query("AGG-33", """
    WITH a AS (SELECT source, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id) GROUP BY 1), b AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
    SELECT source, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS now, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (source)""")
def run_over_run(t: Tables) -> DataFrame:
    """Labelled documents, the state of an earlier run, against all of them."""
    count = lambda d, c: d.groupBy("source").agg(F.count(F.lit(1)).alias(c))
    earlier = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    both = count(earlier, "before").join(count(t.documents, "now"), "source", "full_outer").fillna(0, ["before", "now"])
    return both.withColumn("delta", F.col("now") - F.col("before"))


@query("AGG-06", """
    SELECT lang, min(n_chars) AS min, quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75,
    quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.99) AS p99, max(n_chars) AS max, avg(n_chars) AS mean FROM documents GROUP BY lang""")
def length_percentiles(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(*ranking.percentile_vector("n_chars"))


@query("AGG-02", """
    WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, max(n_chars) FILTER (rn = least(floor(n * 0.1) + 1, n)) AS p10, max(n_chars) FILTER (rn = least(floor(n * 0.5) + 1, n)) AS p50,
    max(n_chars) FILTER (rn = least(floor(n * 0.9) + 1, n)) AS p90 FROM r GROUP BY lang""")
def nearest_rank_percentiles(t: Tables) -> DataFrame:
    return ranking.nearest_rank(t.documents, ["lang"], "n_chars", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("AGG-43", """
    WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars >= 500)
    SELECT lang, max(n_chars) FILTER (rn = n // 2 + 1) AS median FROM r GROUP BY lang""")
def upper_median(t: Tables) -> DataFrame:
    return ranking.upper_median(t.documents.where("n_chars >= 500"), ["lang"], "n_chars")


_STATUS = "CASE WHEN n_chars / 20.0 < 20 THEN 'too_short' WHEN n_chars / 20.0 > 330 THEN 'too_long' ELSE 'ok' END"


@query("FLT-04", f"SELECT {_STATUS} AS status, count(*) AS n, round(sum(n_chars / 20.0) / 3600, 9) AS hours FROM documents GROUP BY 1")
def duration_classes(t: Tables) -> DataFrame:
    """Characters at 20 a second stand in for seconds."""
    seconds = F.col("n_chars") / 20.0
    return t.documents.groupBy(quality.backfilled_status(quality.duration_class(seconds), seconds).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(seconds) / 3600, 9).alias("hours"))


@query("AGG-15", " UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS seconds, count(*) FILTER (n_chars >= {c}) AS survivors, round(count(*) FILTER (n_chars >= {c}) / count(*), 9) AS kept, round(coalesce(sum(n_chars) FILTER (n_chars >= {c}), 0) / 3600.0, 9) AS hours FROM documents" for c in (30, 100, 300, 1000, 3000)))
def length_survival(t: Tables) -> DataFrame:
    return ranking.survival(t.documents, "n_chars", [30, 100, 300, 1000, 3000]).select("seconds", "survivors", F.round("kept", 9).alias("kept"), F.round("hours", 9).alias("hours"))


@query("FLT-09", "SELECT n_chars >= 258 AS long_enough, n_chars >= 1 AS paddable, count(*) AS n FROM documents GROUP BY ALL")
def trainable_lengths(t: Tables) -> DataFrame:
    return t.documents.groupBy(quality.trainable(F.col("n_chars"), 256).alias("long_enough"), quality.trainable(F.col("n_chars"), 256, True).alias("paddable")).agg(F.count(F.lit(1)).alias("n"))


@query("AGG-09", f"""
    WITH d AS (SELECT {_N} AS n FROM documents)
    SELECT CAST(least(ceil(n / 72), 16) AS BIGINT) AS chunks, count(*) AS rows, count(*) FILTER (n > 72 * 16) AS over_cap FROM d GROUP BY 1""")
def chunk_histogram(t: Tables) -> DataFrame:
    n = t.documents.select(X.word_count(F.col("text")).alias("n"))
    return n.groupBy(X.word_chunks(F.col("n")).alias("chunks")).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("n") > 72 * 16, 1)).alias("over_cap"))


@query("AGG-16", f"""
    SELECT lang, count(*) AS entries, CAST(sum({_N}) AS BIGINT) AS words, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM documents GROUP BY lang ORDER BY entries DESC, lang LIMIT 25""")
def lang_audit(t: Tables) -> DataFrame:
    total = t.documents.agg(F.count(F.lit(1)).alias("_t"))
    counts = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("entries"), F.sum(X.word_count(F.col("text"))).alias("words"))
    return counts.crossJoin(F.broadcast(total)).select("lang", "entries", "words", F.round(F.col("entries") / F.col("_t"), 9).alias("share")).orderBy(F.col("entries").desc(), "lang").limit(25)


@query("AGG-01", f"""
    WITH d AS (SELECT lang, {_N} AS n FROM documents)
    SELECT lang, count(*) AS present, round(avg(CAST(n = 0 AS INT)), 9) AS wordless, median(n) AS median_words, round(avg(n), 6) AS mean_words, round(avg(CAST(n < 6 AS INT)), 9) AS short FROM d GROUP BY lang""")
def group_stats(t: Tables) -> DataFrame:
    d = t.documents.select("lang", X.word_count(F.col("text")).alias("n"))
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("present"), share(F.col("n") == 0).alias("wordless"), F.median("n").alias("median_words"), F.round(F.avg("n"), 6).alias("mean_words"), share(F.col("n") < 6).alias("short"))


@query("JOIN-14", f"""
    SELECT source = 'src0' AS in_group, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, median(n_chars) AS median_chars FROM documents GROUP BY 1""")
def group_vs_rest(t: Tables) -> DataFrame:
    return t.documents.groupBy((F.col("source") == "src0").alias("in_group")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.median("n_chars").alias("median_chars"))


@query("AGG-07 SRT-02", "SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 8")
def marker_mix(t: Tables) -> DataFrame:
    total = t.documents.agg(F.count(F.lit(1)).alias("_t"))
    mix = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    return mix.select("source", "n", F.round(F.col("n") / F.col("_t"), 9).alias("share")).orderBy(F.col("n").desc(), "source").limit(8)


@query("AGG-08", "SELECT lang, count(*) FILTER (n_chars BETWEEN 150 AND 350) AS in_band, count(*) FILTER (n_chars < 60) AS tiny, count(*) FILTER (n_chars = 0) AS empty, count(*) FILTER (n_chars >= 2995) AS capped FROM documents GROUP BY lang")
def caption_lengths(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    count = lambda c: F.count(F.when(c, 1))
    return t.documents.groupBy("lang").agg(count(n.between(150, 350)).alias("in_band"), count(n < 60).alias("tiny"), count(n == 0).alias("empty"), count(n >= 2995).alias("capped"))


@query("AGG-13", f"""
    WITH d AS (SELECT {_N} AS n FROM documents)
    SELECT CASE WHEN n < 20 THEN '[0,20)' WHEN n < 60 THEN '[20,60)' WHEN n < 120 THEN '[60,120)' WHEN n < 500 THEN '[120,500)' ELSE '[500,)' END AS band, count(*) AS rows FROM d GROUP BY 1""")
def word_bands(t: Tables) -> DataFrame:
    n = X.word_count(F.col("text"))
    band = F.when(n < 20, "[0,20)").when(n < 60, "[20,60)").when(n < 120, "[60,120)").when(n < 500, "[120,500)").otherwise("[500,)")
    return t.documents.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("rows"))


@query("AGG-13 SRT-04", """
    WITH c AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS rn FROM documents GROUP BY source)
    SELECT CASE WHEN rn <= 5 THEN source ELSE 'other' END AS source, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def top_sources_and_other(t: Tables) -> DataFrame:
    counts = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), "source").limit(5)
    rest = counts.join(F.broadcast(top.select("source")), "source", "left_anti").agg(F.sum("n").alias("n")).where("n is not null").select(F.lit("other").alias("source"), "n")
    return top.union(rest)


@query("AGG-17", """
    WITH c AS (SELECT lang, unnest(string_split(lower(text), '')) AS ch FROM documents)
    SELECT lang, count(*) AS chars, count(*) FILTER (ch BETWEEN 'a' AND 'z') AS covered, count(*) FILTER (NOT ch BETWEEN 'a' AND 'z') AS uncovered FROM c WHERE ch <> '' GROUP BY lang HAVING count(*) >= 1000""")
def codepoint_coverage(t: Tables) -> DataFrame:
    """Code points inside a vocabulary (a to z here), per language with 1000 or more; counted without exploding texts."""
    low = F.lower("text")
    d = t.documents.select("lang", F.length(low).cast("long").alias("chars"), F.length(F.regexp_replace(low, "[^a-z]", "")).cast("long").alias("covered"))
    return d.groupBy("lang").agg(F.sum("chars").alias("chars"), F.sum("covered").alias("covered")).where("chars >= 1000").withColumn("uncovered", F.col("chars") - F.col("covered"))


@query("AGG-36", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_totals(t: Tables) -> DataFrame:
    return t.documents.rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("JOIN-12", """
    SELECT conv_id, count(*) AS turns, max(turn) + 1 AS expected, CASE WHEN count(*) = max(turn) + 1 THEN 'covered' ELSE 'stale' END AS status FROM conversations GROUP BY conv_id""")
def stale_pairs(t: Tables) -> DataFrame:
    from corpusmill.operators.joins import stale

    got = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    want = t.conversations.groupBy("conv_id").agg((F.max("turn") + 1).alias("expected"))
    return stale(got.select("conv_id", "turns"), want, "conv_id", "turns", "expected").join(got, "conv_id").select("conv_id", "turns", "expected", "status")


@query("SNK-19 STR-20", r"""
    SELECT p_partkey, regexp_replace(substr(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), 1, 48), '^-|-$', '', 'g') AS slug,
    CAST(nullif(regexp_extract(p_brand, '#(\d+)', 1), '') AS BIGINT) AS brand, printf('%d:%02d', p_size // 60 + p_size, p_size % 60) AS clock FROM part""")
def slug_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), X.trailing_number(F.col("p_brand"), "#").alias("brand"), X.minutes_text(F.col("p_size") * 61).alias("clock"))


@query("STR-02 STR-03", """
    SELECT l_orderkey, l_linenumber, CASE translate(lower(trim(l_linestatus)), ' -', '__') WHEN 'o' THEN 'open' WHEN 'f' THEN 'final' ELSE 'none' END AS label FROM lineitem""")
def label_fold(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", X.lookup(F.col("l_linestatus"), {"o": "open", "f": "final"}, "none").alias("label"))


@query("STR-10", r"""
    WITH w AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN length(w) >= 2 AND w[1] = w[-1] AND w[1] IN ('"', chr(39)) THEN trim(w[2:-2], ' ') ELSE w END AS s FROM w)
    SELECT doc_id, md5(CASE WHEN length(s) <= 300 THEN s ELSE trim(regexp_replace(s[1:300], ' [^ ]*$', ''), ' ') END) AS digest FROM s""")
def caption_clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.clean_caption(F.col("text"), 300).cast("binary")).alias("digest"))


@query("STR-16", f"SELECT doc_id, array_to_string(({_WORDS.format('text')})[1:12], ' ') AS head FROM documents")
def first_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.first_words(F.col("text"), 12).alias("head"))


@query("STR-17", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s'']', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS digest FROM documents")
def wer_normalise(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.wer_normalised(F.col("text")).cast("binary")).alias("digest"))


@query("ARR-07", "SELECT event_id, props ->> '$.k' AS k, length(props) AS size FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("size"))
