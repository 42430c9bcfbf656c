"""Queries that audit: lyric and language statistics, coverage, comparisons of versions, scores, incremental recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import arrays as A
from corpusmill.functions import kernels
from corpusmill.functions import text as X
from corpusmill.operators import dedup, joins, quality, ranking, windows
from corpusmill.plans.catalog import Tables, query
from corpusmill.streaming import events as E

_N = r"CAST(len(list_filter(regexp_split_to_array(coalesce({}, ''), '\s+'), lambda x: x <> '')) AS BIGINT)"


def _n_if(c):
    return F.count(F.when(c, 1))


def _lyrics(t: Tables) -> DataFrame:
    """Labelled documents as lyrics: words, null where quality is 0, gender from toxic, a log-probability from the id."""
    l = t.labels.withColumnRenamed("doc_id", "_l")  # noqa: E741
    n = F.when(F.col("quality") == 1, X.word_count(F.col("text"))).otherwise(0)
    gender = F.when(F.col("toxic") == 1, "male").when(F.col("_l") % 3 == 0, "female")
    return t.documents.join(l, F.col("doc_id") == F.col("_l")).select("doc_id", "source", "lang", n.alias("n"), gender.alias("gender"), (-(F.col("doc_id") % 40) / 10.0).alias("logprob"))


_LYRICS = f"""
    y AS (SELECT doc_id, source, lang, CASE WHEN quality = 1 THEN {_N.format('text')} ELSE 0 END AS n, CASE WHEN toxic = 1 THEN 'male' WHEN doc_id % 3 = 0 THEN 'female' END AS gender, -(doc_id % 40) / 10.0 AS logprob
        FROM documents JOIN labels USING (doc_id))"""


@query("AGG-01", f"""
    WITH {_LYRICS}, c AS (SELECT source = 'src0' AS own, lang, row_number() OVER (PARTITION BY source = 'src0' ORDER BY count(*) DESC, lang) AS rn FROM y WHERE n > 0 GROUP BY 1, 2),
    top AS (SELECT own, string_agg(lang, ',' ORDER BY rn) AS top_langs FROM c WHERE rn <= 4 GROUP BY own)
    SELECT source = 'src0' AS own, count(*) AS present, round(avg(CAST(n = 0 AS INT)), 9) AS instrumental, median(n) FILTER (n > 0) AS median_words, round(avg(n) FILTER (n > 0), 6) AS mean_words,
        count(*) FILTER (n > 0 AND gender = 'male') AS male, count(*) FILTER (n > 0 AND gender = 'female') AS female, count(*) FILTER (n > 0 AND gender IS NULL) AS unknown, median(logprob) FILTER (n > 0) AS logprob,
        round(avg(CAST(lang IS NOT NULL AS INT)) FILTER (n > 0), 9) AS lang_coverage, any_value(top_langs) AS top_langs FROM y LEFT JOIN top ON top.own = (source = 'src0') GROUP BY 1""")
def lyric_stats(t: Tables) -> DataFrame:
    y = _lyrics(t).withColumn("own", F.col("source") == "src0")
    sung = lambda c: F.when(F.col("n") > 0, c)
    stats = y.groupBy("own").agg(
        F.count(F.lit(1)).alias("present"), F.round(F.avg((F.col("n") == 0).cast("int")), 9).alias("instrumental"), F.median(sung(F.col("n"))).alias("median_words"), F.round(F.avg(sung(F.col("n"))), 6).alias("mean_words"),
        _n_if((F.col("n") > 0) & (F.col("gender") == "male")).alias("male"), _n_if((F.col("n") > 0) & (F.col("gender") == "female")).alias("female"), _n_if((F.col("n") > 0) & F.col("gender").isNull()).alias("unknown"),
        F.median(sung(F.col("logprob"))).alias("logprob"), F.round(F.avg(sung(F.col("lang").isNotNull().cast("int"))), 9).alias("lang_coverage"),
    )
    counts = y.where("n > 0").groupBy("own", "lang").agg(F.count(F.lit(1)).alias("c"))
    top = ranking.top_per_group(counts, "own", [F.col("c").desc(), F.col("lang")], 4).groupBy("own").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "lang"))), lambda s: s["lang"]).alias("l"))
    return stats.join(top.select("own", F.array_join("l", ",").alias("top_langs")), "own", "left")


@query("AGG-02", """
    WITH o AS (SELECT o_orderpriority AS codec, o_totalprice / 1000 AS rate FROM orders)
    SELECT codec, count(*) AS n, count(*) FILTER (rate < 96) AS below_96, count(*) FILTER (rate >= 96 AND rate < 192) AS to_192, count(*) FILTER (rate >= 192) AS above FROM o GROUP BY codec""")
def codec_bands(t: Tables) -> DataFrame:
    rate = F.col("o_totalprice") / 1000
    return t.orders.groupBy(F.col("o_orderpriority").alias("codec")).agg(F.count(F.lit(1)).alias("n"), _n_if(rate < 96).alias("below_96"), _n_if((rate >= 96) & (rate < 192)).alias("to_192"), _n_if(rate >= 192).alias("above"))


@query("AGG-13", f"""
    WITH {_LYRICS}, b AS (SELECT coalesce(gender, 'unknown') AS gender, CASE WHEN n < 20 THEN '[0,20)' WHEN n < 30 THEN '[20,30)' WHEN n < 60 THEN '[30,60)' WHEN n < 120 THEN '[60,120)' ELSE '[120,)' END AS band FROM y),
    c AS (SELECT gender, band, count(*) AS n FROM b GROUP BY gender, band) SELECT gender, band, n, round(n / sum(n) OVER (PARTITION BY gender), 9) AS share FROM c""")
def gender_bands(t: Tables) -> DataFrame:
    n = F.col("n")
    band = F.when(n < 20, "[0,20)").when(n < 30, "[20,30)").when(n < 60, "[30,60)").when(n < 120, "[60,120)").otherwise("[120,)")
    c = _lyrics(t).groupBy(F.coalesce("gender", F.lit("unknown")).alias("gender"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gender")), 9))


@query("AGG-14", """
    WITH s AS (SELECT lang, sum(n_chars) / 20.0 AS audio FROM documents GROUP BY lang), e AS (SELECT lang, audio, 40 * 8 * 30.0 / greatest(audio, 1.0) AS epochs FROM s)
    SELECT lang, round(audio, 6) AS audio, round(epochs, 6) AS epochs, CASE WHEN epochs < 2 THEN 'under' WHEN epochs <= 15 THEN 'healthy' ELSE 'over' END AS verdict FROM e""")
def effective_epochs(t: Tables) -> DataFrame:
    """How often 40 steps of 8 crops of 30 seconds sweep each language's audio."""
    s = t.documents.groupBy("lang").agg((F.sum("n_chars") / 20.0).alias("audio"))
    epochs = ranking.effective_epochs(40, 8, 30.0, F.col("audio"))
    return s.select("lang", F.round("audio", 6).alias("audio"), F.round(epochs, 6).alias("epochs"), ranking.epoch_verdict(epochs).alias("verdict"))


@query("AGG-16", f"""
    WITH {_LYRICS} SELECT count(*) AS entries, count(*) FILTER (n > 0) AS with_words, count(lang) AS with_lang, count(*) FILTER (n > 0 AND logprob IS NOT NULL) AS with_logprob,
        round(count(*) FILTER (n > 0 AND lang <> 'en') / greatest(count(*) FILTER (n > 0 AND lang IS NOT NULL), 1), 9) AS non_english FROM y""")
def lang_totals(t: Tables) -> DataFrame:
    has = F.col("n") > 0
    return _lyrics(t).agg(
        F.count(F.lit(1)).alias("entries"), _n_if(has).alias("with_words"), F.count("lang").alias("with_lang"), _n_if(has & F.col("logprob").isNotNull()).alias("with_logprob"),
        F.round(_n_if(has & (F.col("lang") != "en")) / F.greatest(_n_if(has & F.col("lang").isNotNull()), F.lit(1)), 9).alias("non_english"),
    )


@query("AGG-17", """
    WITH c AS (SELECT unnest(string_split(lower(text), '')) AS ch FROM documents) SELECT ch, count(*) AS n FROM c WHERE ch <> '' AND NOT ch BETWEEN 'a' AND 'z' GROUP BY ch ORDER BY n DESC, ch LIMIT 30""")
def uncovered_codepoints(t: Tables) -> DataFrame:
    """The 30 most frequent code points outside a vocabulary (a to z), counted in Arrow batches before they are shuffled."""
    rest = t.documents.select(F.regexp_replace(F.lower("text"), "[a-z]", "").alias("text"))
    counts = kernels.codepoint_counts(rest, "text")
    return counts.groupBy("ch").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "ch").limit(30)


_CAPTION = """text || CASE doc_id % 6 WHEN 0 THEN ' Electronic,  folk and IDM by ' || source WHEN 1 THEN ' the vocals are sparse in ' || lang WHEN 2 THEN ' There might be VOCALS of ' || source WHEN 3 THEN ' folk and idm, some' || lang || 'vocals' ELSE '' END"""


@query("AGG-22 FLT-19", f"""
    WITH m AS (SELECT 'v' || (1 + doc_id % 3) AS marker, {_CAPTION} AS text FROM documents), k AS (SELECT *, {_N.format('text')} AS n FROM m)
    SELECT marker, count(*) AS n, round(avg(n), 6) AS mean_words, count(*) FILTER (regexp_matches(text, '{X.GENRE_DEFAULT}')) AS defaults, count(*) FILTER (regexp_matches(text, '{X.VOCAL_HEDGE}')) AS hedges,
        marker = max(marker) OVER () AS newest FROM k GROUP BY marker""")
def marker_compare(t: Tables) -> DataFrame:
    """Captions of each version, some with a phrase of either kind: number, length and two failure patterns; the newest is the greatest
    marker."""
    d = F.col("doc_id") % 6
    tail = F.when(d == 0, F.concat(F.lit(" Electronic,  folk and IDM by "), "source")).when(d == 1, F.concat(F.lit(" the vocals are sparse in "), "lang"))
    tail = tail.when(d == 2, F.concat(F.lit(" There might be VOCALS of "), "source")).when(d == 3, F.concat(F.lit(" folk and idm, some"), "lang", F.lit("vocals"))).otherwise(F.lit(""))
    m = t.documents.select(F.concat(F.lit("v"), 1 + F.col("doc_id") % 3).alias("marker"), F.concat("text", tail).alias("text"))
    c = m.groupBy("marker").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(X.word_count(F.col("text"))), 6).alias("mean_words"), _n_if(F.col("text").rlike(X.GENRE_DEFAULT)).alias("defaults"), _n_if(F.col("text").rlike(X.VOCAL_HEDGE)).alias("hedges")
    )
    return c.withColumn("newest", F.col("marker") == F.max("marker").over(Window.partitionBy()))  # one row a marker


@query("AGG-26 UDF-05", """
    WITH p AS (SELECT conv_id, turn, 10 + turn % 7 AS n, turn % 3 AS dropped, (turn // 3) % 3 AS put, (turn // 2) % 4 AS changed FROM conversations)
    SELECT conv_id, round(sum(dropped + put + changed) / sum(n), 9) AS pooled, round(avg((dropped + put + changed) / n), 9) AS mean FROM p GROUP BY conv_id""")
def word_error_rates(t: Tables) -> DataFrame:
    """References of 10 to 16 different words against the same with some dropped at the end, some inserted in front and some replaced
    by unknown ones in the middle: pooled and mean error rates."""
    n, at = (10 + F.col("turn") % 7).cast("int"), F.col("turn")
    words = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("w"), i.cast("string")))
    dropped, put, changed = (at % 3).cast("int"), (F.floor(at / 3) % 3).cast("int"), (F.floor(at / 2) % 4).cast("int")
    replaced = F.transform(words, lambda w, i: F.when((i >= 3) & (i < 3 + changed), F.concat(F.lit("x"), i.cast("string"))).otherwise(w))
    spoken = F.concat(F.array_repeat(F.lit("uh"), put), F.slice(replaced, F.lit(1), n - dropped))
    made = t.conversations.select("conv_id", F.array_join(words, " ").alias("r"), F.array_join(spoken, " ").alias("s"))
    got = kernels.corpus_word_error_rate(made, "r", "s", ["conv_id"])
    return got.select("conv_id", F.round("pooled", 9).alias("pooled"), F.round("mean", 9).alias("mean"))


@query("AGG-27", """
    WITH w AS (SELECT event_type, sum(value * user_id) / sum(user_id) AS loss FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, round(loss, 6) AS loss, round((SELECT loss FROM w WHERE event_type = 'view') - loss, 6) AS gain FROM w""")
def ablation_gains(t: Tables) -> DataFrame:
    """Weighted mean of each regime and what it gains on one of them."""
    w = t.events.where("value is not null").groupBy("event_type").agg((F.sum(F.col("value") * F.col("user_id")) / F.sum("user_id")).alias("loss"))
    base = w.where("event_type = 'view'").select(F.col("loss").alias("base"))
    return w.crossJoin(F.broadcast(base)).select("event_type", F.round("loss", 6).alias("loss"), F.round(F.col("base") - F.col("loss"), 6).alias("gain"))


@query("AGG-31 AGG-32 AGG-42", """
    WITH f AS (SELECT event_id, event_id % 10 / 20.0::DOUBLE AS sil, value / 50 AS beat, event_id % 40 / 100.0::DOUBLE AS rms, CASE WHEN event_id % 4 <> 0 THEN value / 100 END AS clap FROM events WHERE value IS NOT NULL),
    s AS (SELECT *, greatest(0.0, least(1.0, 1 - sil / 0.3)) * (0.6 * least(beat, 1.0) + 0.4 * CASE WHEN rms < 0.02 OR rms > 0.35 THEN 0 ELSE greatest(0.0, least(1.0, 1 - abs(rms - 0.1) / 0.1)) END) AS rhythm FROM f)
    SELECT event_id, round(rhythm, 6) AS rhythm, round(coalesce(clap, 0) - 0.5 * rms - 0.8 * sil + 0.2 * beat, 6) AS composite, round(rhythm * (0.5 + 0.5 * greatest(0.0, least(1.0, coalesce(clap, 0) / 0.5))), 6) AS blend FROM s""")
def clip_scores(t: Tables) -> DataFrame:
    f = t.events.where("value is not null").select(
        "event_id", (F.col("event_id") % 10 / 20.0).alias("sil"), (F.col("value") / 50).alias("beat"), (F.col("event_id") % 40 / 100.0).alias("rms"), F.when(F.col("event_id") % 4 != 0, F.col("value") / 100).alias("clap")
    )
    rhythm = ranking.rhythm_score(F.col("sil"), F.col("beat"), F.col("rms"))
    composite = ranking.composite(F.col("clap"), F.col("rms"), F.col("sil"), F.col("beat"))
    return f.select("event_id", F.round(rhythm, 6).alias("rhythm"), F.round(composite, 6).alias("composite"), F.round(ranking.fixed_blend(rhythm, F.col("clap")), 6).alias("blend"))


@query("AGG-34", """
    SELECT 'step_' || o_orderkey || '.pt' AS name, o_orderkey AS step, round(o_totalprice, 2) AS size FROM orders WHERE o_orderstatus = 'P' ORDER BY step""")
def checkpoint_inventory(t: Tables) -> DataFrame:
    """Checkpoints by the step in their names."""
    made = t.orders.where("o_orderstatus = 'P'").select(F.concat(F.lit("step_"), "o_orderkey", F.lit(".pt")).alias("name"), F.round("o_totalprice", 2).alias("size"))
    return made.select("name", X.trailing_number(F.col("name"), "step_").alias("step"), "size").orderBy("step")


@query("AGG-35", """
    SELECT p_size AS layers, 64 * p_size AS width, text, 2 * 9 * 1025 * 64 * p_size + p_size * (4 * (64 * p_size) * (64 * p_size) + CASE WHEN text THEN 4 ELSE 0 END * (64 * p_size) * (64 * p_size) + 2 * (64 * p_size) * (256 * p_size)
        + CASE WHEN text THEN 3 ELSE 2 END * 64 * p_size) + 64 * p_size AS params FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS p_size FROM part), (SELECT unnest([true, false]) AS text)""")
def parameter_counts(t: Tables) -> DataFrame:
    """Parameters of decoders by width, depth and whether they attend to text; 1024 entries a table and one of padding."""
    sizes = t.part.select(F.col("p_size").cast("long").alias("layers")).distinct().select("layers", (64 * F.col("layers")).alias("width"), F.explode(F.array(F.lit(True), F.lit(False))).alias("text"))
    return sizes.withColumn("params", ranking.decoder_parameters(F.col("width"), F.col("layers"), 4 * F.col("width"), F.col("text"), 9, 1025))


@query("AGG-37", "SELECT lang, count(DISTINCT source) AS sources, true AS close FROM documents GROUP BY lang")
def approximate_counts(t: Tables) -> DataFrame:
    """An extension: distinct texts and sources by sketches, held against the exact number where that is small."""
    told = t.documents.groupBy("lang").agg(F.approx_count_distinct("source", 0.01).alias("sources"), F.approx_count_distinct("text", 0.02).alias("a"))
    # By itself: in one aggregate with them, each distinct text would have sketches of its own.
    texts = t.documents.select(F.col("lang").alias("_l"), F.md5(F.col("text").cast("binary")).alias("_t")).distinct()
    d = told.join(texts.groupBy("_l").agg(F.count("_t").alias("b")), F.col("lang").eqNullSafe(F.col("_l")))
    return d.select("lang", "sources", (F.abs(F.col("a") - F.col("b")) <= 0.15 * F.col("b") + 2).alias("close"))


@query("AGG-41", """
    WITH c AS (SELECT ['lyrics', 'instrumental', 'none'][1 + event_id % 3] AS cond, event_type AS ladder, value AS leaked, value / 100 AS wer FROM events WHERE value IS NOT NULL)
    SELECT cond, ladder, count(*) AS n, round(CASE WHEN cond = 'lyrics' THEN avg(wer) ELSE avg(leaked) END, 6) AS metric FROM c GROUP BY cond, ladder""")
def condition_cells(t: Tables) -> DataFrame:
    """Cells of a sweep: error rate where there are lyrics, leaked words where there are none."""
    cond = F.element_at(F.array(F.lit("lyrics"), F.lit("instrumental"), F.lit("none")), (F.col("event_id") % 3 + 1).cast("int"))
    c = t.events.where("value is not null").groupBy(cond.alias("cond"), F.col("event_type").alias("ladder"))
    metric = F.when(F.col("cond") == "lyrics", F.avg(F.col("value") / 100)).otherwise(F.avg("value"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.round(metric, 6).alias("metric"))


@query("AGG-43", """
    WITH d AS (SELECT lang, n_chars AS frames, n_chars * 1.5::DOUBLE + doc_id % 7 AS ms FROM documents WHERE n_chars >= 500), r AS (SELECT lang, ms, row_number() OVER (PARTITION BY lang ORDER BY ms) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM d),
    m AS (SELECT lang, max(ms) FILTER (rn = n // 2 + 1) AS median_ms FROM r GROUP BY lang)
    SELECT lang, round(avg(ms), 6) AS mean_ms, any_value(median_ms) AS median_ms, round(sum(ms) / sum(frames), 9) AS ms_per_frame FROM d JOIN m USING (lang) GROUP BY lang""")
def bench_summary(t: Tables) -> DataFrame:
    """Mean, upper median and weighted time of texts of 500 characters or more."""
    d = t.documents.where("n_chars >= 500").select("lang", "n_chars", (F.col("n_chars") * 1.5 + F.col("doc_id") % 7).alias("ms"))
    means = d.groupBy("lang").agg(F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.sum("ms") / F.sum("n_chars"), 9).alias("ms_per_frame"))
    return means.join(ranking.upper_median(d, ["lang"], "ms").withColumnRenamed("median", "median_ms"), "lang")


# What a captioner that refuses says, and what shows that a caption is a list or a preamble.
REFUSALS = ("i'm sorry", "i am sorry", "i cannot", "i can't", "i can not", "as an ai", "i'm unable", "i am unable", "unable to provide", "i do not have", "i don't have access", "sorry, i")
ARTIFACTS = ("```", "\n- ", "\n* ", "\n1.", "\n2.", "•", "## ", "**genre", "here is", "here's a", "description:")


def _any(words) -> str:
    quoted = lambda w: "'" + w.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(" + " OR ".join(f"contains(low, {quoted(w)})" for w in words) + ")"


_PHRASES = (*REFUSALS, *ARTIFACTS, "a calm song", "")
_SAYS = ", ".join("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in _PHRASES)


@query("FLT-16", f"""
    WITH d AS (SELECT event_id, lower(event_type || ' ' || ([{_SAYS}])[1 + (event_id * 7 + user_id) % {len(_PHRASES)}] || ' ' || user_id) AS low FROM events)
    SELECT event_id, {_any(REFUSALS)} AS refusal, {_any(ARTIFACTS)} AS artifact FROM d""")
def refusal_flags(t: Tables) -> DataFrame:
    """Captions with each of the phrases in some place, in whatever case."""
    said = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), ((F.col("event_id") * 7 + F.col("user_id")) % len(_PHRASES) + 1).cast("int"))
    text = F.concat("event_type", F.lit(" "), F.when(F.col("event_id") % 2 == 0, F.upper(said)).otherwise(said), F.lit(" "), F.col("user_id").cast("string"))
    d = t.events.select("event_id", F.lower(text).alias("low"))
    return d.select("event_id", X.contains_any(F.col("low"), REFUSALS).alias("refusal"), X.contains_any(F.col("low"), ARTIFACTS).alias("artifact"))


def _junk_sql(text: str, n: str) -> str:
    """The reason by the fixed phrases and limits."""
    quoted = [p.replace("'", "''") for p in X.JUNK_PHRASES]
    hit = "CASE " + " ".join(f"WHEN contains(lower({text}), '{p}') THEN 'junk:{p}'" for p in quoted) + " END"
    return f"CASE WHEN {n} < {X.MIN_WORDS} THEN 'short' WHEN {n} < {X.JUNK_MAX_WORDS} AND {hit} IS NOT NULL THEN {hit} END"


_SAID = """CASE WHEN (conv_id + turn) % 11 = 0 THEN NULL ELSE text || CASE (conv_id + turn) % 7 WHEN 0 THEN ' Thanks for Watching' WHEN 1 THEN ' ' || role || '.com' WHEN 2 THEN ' Subtitles by ' || role
    WHEN 3 THEN ' Please SUBSCRIBE and see you next time' ELSE '' END END"""


@query("FLT-02", f"""
    WITH s AS (SELECT conv_id, turn, {_SAID} AS text FROM conversations), n AS (SELECT *, {_N.format('text')} AS n FROM s) SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN {_junk_sql('text', 'n')} END AS reason FROM n""")
def junk_transcripts(t: Tables) -> DataFrame:
    """Turns as transcripts, some with what speech recognition makes up on silence, by the fixed phrases and limits."""
    said = _transcripts(t)
    return said.select("conv_id", "turn", F.when(F.col("text").isNotNull(), X.junk_reason(F.col("text"), X.word_count(F.col("text")))).alias("reason"))


def _transcripts(t: Tables) -> DataFrame:
    d = F.col("conv_id") + F.col("turn")
    tail = F.when(d % 7 == 0, F.lit(" Thanks for Watching")).when(d % 7 == 1, F.concat(F.lit(" "), "role", F.lit(".com"))).when(d % 7 == 2, F.concat(F.lit(" Subtitles by "), "role"))
    tail = tail.when(d % 7 == 3, F.lit(" Please SUBSCRIBE and see you next time")).otherwise(F.lit(""))
    return t.conversations.select("conv_id", "turn", F.when(d % 11 != 0, F.concat("text", tail)).alias("text"))


@query("FLT-03", f"""
    WITH s AS (SELECT {_SAID} AS text FROM conversations), r AS (SELECT text, CASE WHEN text IS NOT NULL THEN {_junk_sql('text', 'n')} END AS reason FROM (SELECT *, {_N.format('text')} AS n FROM s)),
    m AS (SELECT unnest(['dry run', 'write']) AS mode), x AS (SELECT mode, text, reason, CASE WHEN mode = 'dry run' OR reason IS NULL THEN text END AS left_over FROM m, r)
    SELECT mode, count(text) AS checked, count(reason) AS flagged, count(*) FILTER (text IS NULL) AS already_null, count(*) FILTER (text IS NOT NULL AND reason IS NULL) AS vocal_ready, count(*) AS total, count(left_over) AS left_over,
        count(CASE WHEN left_over IS NOT NULL THEN reason END) AS flagged_again, count(*) FILTER (reason = 'short') AS short, count(*) FILTER (reason LIKE 'junk:%') AS junk FROM x GROUP BY mode""")
def junk_nulled(t: Tables) -> DataFrame:
    """Counters of a pass that nulls made-up transcripts, as a dry run and written, and what a second pass over its result finds."""
    found = []
    for mode, dry in (("dry run", True), ("write", False)):
        first, counters = quality.nulled(_transcripts(t), "text", dry=dry)
        again = quality.nulled(first.select("text"), "text", dry=True)[1]
        left = first.agg(F.count("text").alias("left_over"))
        both = counters.crossJoin(F.broadcast(again.select(F.col("flagged").alias("flagged_again")))).crossJoin(F.broadcast(left))  # a row each
        found.append(both.withColumn("mode", F.lit(mode)))
    return found[0].unionByName(found[1]).select("mode", "checked", "flagged", "already_null", "vocal_ready", "total", "left_over", "flagged_again", "short", "junk")


@query("JOIN-12 AGG-36", """
    WITH g AS (SELECT conv_id, count(*) AS n FROM conversations WHERE turn % 9 <> 8 GROUP BY 1 HAVING conv_id % 5 <> 0), w AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
    s AS (SELECT 'w' || w.conv_id % 3 AS wave, CASE WHEN g.n IS NULL THEN 'missing' WHEN g.n <> w.n THEN 'stale' ELSE 'covered' END AS status FROM w LEFT JOIN g USING (conv_id))
    SELECT coalesce(wave, 'TOTAL') AS wave, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'covered') AS covered FROM s GROUP BY ROLLUP (wave)""")
def phoneme_coverage(t: Tables) -> DataFrame:
    """Groups derived from words, some missing and some with other counts, by wave with a total."""
    size = lambda d: d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    derived = size(t.conversations.where("turn % 9 <> 8")).where("conv_id % 5 <> 0")
    s = joins.stale(derived, size(t.conversations).withColumnRenamed("n", "words"), "conv_id", "n", "words").withColumn("wave", F.concat(F.lit("w"), F.col("conv_id") % 3))
    count = lambda v: _n_if(F.col("status") == v).alias(v)
    return s.rollup("wave").agg(count("missing"), count("stale"), count("covered")).withColumn("wave", F.coalesce("wave", F.lit("TOTAL")))


@query("JOIN-21", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, (SELECT avg(o_custkey) FROM orders)) AS cfg, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'shared') AS mode FROM events")
def shared_defaults(t: Tables) -> DataFrame:
    """Fields of items, else those of their batch."""
    items = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("cfg"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("mode"))
    batch = t.orders.agg(F.avg("o_custkey").alias("cfg"), F.lit("shared").alias("mode"))
    return joins.with_defaults(items, batch, ["cfg", "mode"])


_BYTE = "CAST('0x' || substr(md5(c), {}, 2) AS BIGINT)"


@query("JOIN-23", rf"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
    k AS (SELECT doc_id, array_to_string(w[i * 72 + 1 : i * 72 + 72], ' ') AS c FROM (SELECT doc_id, w, unnest(range(CAST(least(ceil(len(w) / 72.0), 16) AS BIGINT))) AS i FROM w)),
    v AS (SELECT doc_id, count(*) AS n, sum({_BYTE.format(1)}) AS a, sum({_BYTE.format(3)}) AS b, sum({_BYTE.format(5)}) AS d FROM k GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_chunks, CAST(greatest(ceil(len(w) / 72.0) - 16, 0) AS BIGINT) AS n_dropped, coalesce(round(a / n, 6), 0.0)::DOUBLE AS v0, coalesce(round(b / n, 6), 0.0)::DOUBLE AS v1, coalesce(round(d / n, 6), 0.0)::DOUBLE AS v2
    FROM w LEFT JOIN v USING (doc_id)""")
def chunk_dictionary(t: Tables) -> DataFrame:
    """Texts in up to 16 chunks, the surveyed bound, with the number beyond it. Each distinct chunk is embedded once (here by bytes
    of its digest) and looked up; a text's vector is the mean of its chunks', that of one without any is zero."""
    d = t.documents.select("doc_id", X.words(F.col("text")).alias("w"))
    chunks = d.select("doc_id", F.posexplode(A.chunks_of(F.col("w"), 72, 16)).alias("i", "c")).select("doc_id", F.array_join("c", " ").alias("c"))
    byte = lambda k: F.conv(F.substring(F.md5(F.col("c").cast("binary")), 2 * k + 1, 2), 16, 10).cast("double")
    base = d.select("doc_id", F.greatest(F.ceil(F.size("w") / 72) - 16, F.lit(0)).cast("long").alias("n_dropped"))
    found = joins.embedded(base, chunks, "doc_id", "c", F.array(*[byte(k) for k in range(3)]), 3)
    return found.select("doc_id", "n_chunks", "n_dropped", *[F.round(F.col("vector")[k], 6).alias(f"v{k}") for k in range(3)])


@query("WIN-15", r"""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)
    SELECT doc_id FROM r WHERE i < 15 OR (k % greatest(1, n // 15) = 0 AND k < greatest(1, n // 15) * 15)""")
def longest_and_strided(t: Tables) -> DataFrame:
    """The 15 longest texts and 15 spread over all."""
    d = t.documents.select("doc_id", "n_chars")
    longest = d.orderBy(F.col("n_chars").desc(), "doc_id").limit(15).select("doc_id")
    return longest.union(windows.strided(d.select("doc_id"), ["doc_id"], 15).select("doc_id")).distinct()


@query("STM-03", """
    SELECT doc_id AS seq, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped_existing' WHEN n_chars < 400 THEN 'skipped_short' WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'done' END AS status FROM documents""")
def item_status(t: Tables) -> DataFrame:
    """One status an item, with its place in the order: done before, too short, failed or done."""
    marked = t.documents.join(t.labels.select("doc_id", F.lit(True).alias("there")), "doc_id", "left")
    work = F.when(F.col("doc_id") % 13 == 0, F.lit("%")).otherwise(F.base64(F.encode(F.lit("ok"), "UTF-8")))
    todo = marked.where("there is null and n_chars >= 400").select("doc_id", work.alias("x"))
    results = kernels.mapped(todo, "doc_id", "x", "base64").select("doc_id", F.when(F.col("error").isNotNull(), "failed").otherwise("done").alias("r"))
    status = F.when(F.col("there"), "skipped_existing").when(F.col("n_chars") < 400, "skipped_short").otherwise(F.col("r"))
    return marked.join(results, "doc_id", "left").select(F.col("doc_id").alias("seq"), status.alias("status"))


@query("STM-11 FLT-05", r"""
    WITH m AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')) AS h, n_chars FROM documents), r AS (SELECT *, n_chars > 9000 AS long FROM m)
    SELECT doc_id, CASE WHEN long THEN 'too_long' WHEN doc_id <> min(doc_id) FILTER (NOT long) OVER (PARTITION BY h) THEN 'duplicate' ELSE 'ok' END AS status FROM r""")
def recomputed_status(t: Tables) -> DataFrame:
    """A manifest whose marks of duplicates are dropped and found anew over all of it, after ok rows that are too long are marked."""
    d = F.col("doc_id")
    h = F.sha2(X.normalised(F.col("text")).cast("binary"), 256)
    manifest = t.documents.select("doc_id", "n_chars", h.alias("h"), F.when((d % 4 == 0), "duplicate").otherwise("ok").alias("old"))
    reset = F.when(F.col("old") == "duplicate", F.lit("ok")).otherwise(F.col("old"))
    judged = manifest.withColumn("status", quality.backfilled_status(reset, F.col("n_chars"), 9000))
    fine = dedup.exact_duplicates(judged.where("status = 'ok'").select("doc_id", "h"), F.col("h"), "doc_id").select("doc_id", "status")
    return fine.union(judged.where("status <> 'ok'").select("doc_id", "status"))


@query("STM-13", """
    SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL""")
def hourly_counts(t: Tables) -> DataFrame:
    """An extension: tumbling windows on the table, as on a stream."""
    return E.tumbling(t.events, "ts", ["event_type"]).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("STM-13", """
    WITH s AS (SELECT event_type, unnest(range(4)) AS k, ts FROM events) SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, count(*) AS n FROM s GROUP BY ALL""")
def sliding_counts(t: Tables) -> DataFrame:
    return E.sliding(t.events, "ts", ["event_type"]).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("STM-13", """
    WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(t: Tables) -> DataFrame:
    return E.sessions(t.events, "ts", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("STM-13", "SELECT DISTINCT user_id FROM events")
def first_of_each_user(t: Tables) -> DataFrame:
    """One event a user; on a table, whole duplicates by key."""
    return t.events.dropDuplicates(["user_id"]).select("user_id")


@query("STM-14", """
    SELECT event_id, event_type || ' (' || length(event_type) || ')' AS prompt FROM events""")
def prompt_memo(t: Tables) -> DataFrame:
    """Prompts rewritten once each, however many items share them, and joined back."""
    memo = t.events.select("event_type").distinct().withColumn("prompt", F.concat("event_type", F.lit(" ("), F.length("event_type"), F.lit(")")))
    return t.events.select("event_id", "event_type").join(memo, "event_type").select("event_id", "prompt")


@query("SRC-14", """
    SELECT vec_id, round(greatest(list_max(embedding), -list_min(embedding))::DOUBLE, 5) AS peak, label = 9 AS failed FROM embeddings WHERE label <> 9 UNION ALL SELECT vec_id, NULL, true FROM embeddings WHERE label = 9""")
def signal_backends(t: Tables) -> DataFrame:
    """A signal backend (a decoder, loudness or tempo model in its place) by name, with errors caught row by row."""
    values = F.when(F.col("label") == 9, F.lit("no numbers")).otherwise(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","))
    out = kernels.mapped(t.embeddings.select("vec_id", values.alias("x")), "vec_id", "x", "peak")
    return out.select("vec_id", F.round(F.col("result").cast("double"), 5).alias("peak"), F.col("error").isNotNull().alias("failed"))


@query("STM-04 SRT-03", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 40")
def next_chunk(t: Tables) -> DataFrame:
    """The rows that a sweep would work on next: the first 40 of what is pending."""
    return joins.pending(t.documents.select("doc_id"), t.labels, "doc_id").orderBy("doc_id").limit(40)
