"""Queries on sources, packs and sinks: readers with type guards, packing, plans of moves, copies and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import arrays as A
from corpusmill.functions import hashing as H
from corpusmill.operators import joins, quality
from corpusmill.plans.catalog import Tables, query
from corpusmill.sources import packs as P
from corpusmill.sources import rawpack, stores
from corpusmill.sources import tables as S
from corpusmill.sources.scratch import shared_path

_H8 = "CAST('0x' || substr(sha1({}), 1, 8) AS BIGINT)"


def _songs(t: Tables, where: str) -> DataFrame:
    """Orders as songs: two codebooks, as many frames as the key modulo five and one more."""
    n = (F.col("o_orderkey") % 5 + 1).cast("int")
    row = lambda k: F.array_repeat((F.col("o_custkey") * k % 1024).cast("int"), n)
    return t.orders.where(where).select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("name"), F.array(row(1), row(7)).alias("codes"))


def _packed(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "pack")
    P.write_pack(_songs(t, "o_orderstatus = 'F'"), path, 500)
    P.write_pack(_songs(t, "o_orderstatus <> 'F'"), path, 500, append=True)
    return P.read_pack(t.spark, path)


_PLACED = """
    s AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS name, o_custkey, o_orderkey % 5 + 1 AS n, o_orderstatus = 'F' AS early FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY early ORDER BY name) - 1 AS i FROM s),
    f AS (SELECT coalesce(max(i // 500) + 1, 0) AS first FROM r WHERE early),
    p AS (SELECT r.*, CASE WHEN early THEN i // 500 ELSE first + i // 500 END AS shard_id, i % 500 AS local_idx FROM r, f),
    o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY shard_id ORDER BY local_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p)"""


@query("SNK-05 SNK-06 SNK-18 SRC-08 SRC-09", f"""
    WITH {_PLACED} SELECT name, CAST(shard_id AS BIGINT) AS shard_id, local_idx, "offset", n AS n_frames FROM o""")
def pack_roundtrip(t: Tables) -> DataFrame:
    """A pack written, appended to, read back and enumerated from its index."""
    index = S.checked_version(P.pack_index(_packed(t)))
    return S.packed_songs(index).select("name", F.col("shard_id").cast("long").alias("shard_id"), F.col("local_idx").cast("long").alias("local_idx"), "offset", "n_frames")


@query("SRC-08 SRC-09 SRC-10 ARR-04 SNK-05", f"""
    WITH {_PLACED} SELECT name, shard_id, CAST(local_idx AS INT) AS local_idx, "offset", CAST(n AS INT) AS n_frames, array_to_string(list_transform(range(n), lambda x: CAST(o_custkey % 1024 AS VARCHAR)), ',') AS row0,
        array_to_string(list_transform(range(n), lambda x: CAST(o_custkey * 7 % 1024 AS VARCHAR)), ',') AS row1 FROM o""")
def raw_pack(t: Tables) -> DataFrame:
    """Songs written as int16 blobs with an index, appended to, and read back by their byte ranges."""
    path = shared_path(t.spark, "rawpack")
    rawpack.write(_songs(t, "o_orderstatus = 'F'"), path, 500)
    rawpack.write(_songs(t, "o_orderstatus <> 'F'"), path, 500, append=True)
    row = lambda k: F.array_join(F.transform(F.element_at("codes", k + 1), lambda x: x.cast("string")), ",").alias(f"row{k}")
    return rawpack.read(t.spark, path).select("name", "shard_id", "local_idx", "offset", "n_frames", row(0), row(1))


@query("SRC-10 ARR-04", f"WITH {_PLACED} SELECT name, array_to_string(list_transform(range(n), lambda x: CAST(o_custkey * 7 % 1024 AS VARCHAR)), ',') AS row FROM o")
def pack_slices(t: Tables) -> DataFrame:
    """The second codebook of songs, cut out of their shard's blob by byte range."""
    path = shared_path(t.spark, "rawpack")
    rawpack.write(_songs(t, "true"), path, 500)
    return rawpack.read(t.spark, path).select("name", F.array_join(F.element_at("codes", 2), ",").alias("row"))


@query("FLT-20", f"""
    WITH {_PLACED}, m AS (SELECT shard_id, count(*) AS n FROM o GROUP BY 1)
    SELECT shard_id, unnest(CASE shard_id % 5 WHEN 0 THEN [] WHEN 1 THEN ['version'] WHEN 2 THEN ['bytes', 'uncommitted'] WHEN 3 THEN ['last_offset', 'bytes', 'melody', 'stems'] ELSE ['membership'] END) AS problem FROM m""")
def shard_validity(t: Tables) -> DataFrame:
    """Ten checks of shards, of which four in five have been spoilt in one way each."""
    index = P.pack_index(_packed(t))
    k = F.col("shard_id") % 5
    total = F.when(k == 3, F.col("total_T") + 1).otherwise(F.col("total_T"))
    spoilt = index.select(
        F.col("shard_id").cast("long").alias("shard_id"), F.when(k == 1, 1).otherwise(F.col("format_version")).alias("format_version"), F.lit(2).alias("n_codebooks"), total.alias("total_T"),
        "names", "offsets", (F.col("total_T") * 4 - F.when(k == 2, 1).otherwise(0)).alias("token_bytes"), (k != 2).alias("committed"),
        F.when(k == 4, F.slice("names", 2, 10_000)).otherwise(F.col("names")).alias("expected_names"), F.lit(True).alias("has_melody"), (F.col("total_T") * 24).alias("mel_bytes"),
        F.lit(True).alias("has_stems"), F.transform("names", lambda n: F.lit(True)).alias("stem_present"), (F.col("total_T") * 16).alias("stem_bytes"),
    )
    return quality.pack_problems(spoilt, melody=True, stems=True, codebooks=2)


@query("FLT-21", """
    WITH a AS (SELECT source, count(*) AS n, max(n_chars) AS most FROM documents GROUP BY source), e AS (SELECT source, CASE WHEN source = 'src3' THEN n + 1 ELSE n END AS n, most FROM a WHERE source <> 'src5')
    SELECT coalesce(e.source, a.source) AS source, e.n AS expected, a.n AS actual FROM e FULL JOIN a USING (source) WHERE e.n IS DISTINCT FROM a.n""")
def tripwire(t: Tables) -> DataFrame:
    """A recorded state, in which one count differs and one source is missing, against the present one."""
    now = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    recorded = now.where("source <> 'src5'").withColumn("n", F.when(F.col("source") == "src3", F.col("n") + 1).otherwise(F.col("n")))
    return joins.differences(recorded, now, "source", "n")


_LABEL = T.StructType().add("quality", T.IntegerType()).add("toxic", T.IntegerType())


def _label_shards(t: Tables, shards: int) -> str:
    """The folder of JSON files into which the labels are written."""
    path = shared_path(t.spark, "labels-json")
    stores.write_keyed_json(t.labels.withColumn("v", F.struct("quality", "toxic")), path, "doc_id", "v", shards)
    return path


@query("SRC-03 SNK-11", f"SELECT doc_id, quality, toxic FROM labels WHERE {_H8.format('CAST(doc_id AS VARCHAR)')} % 16 <> 7")
def keyed_json_shards(t: Tables) -> DataFrame:
    """Labels written as 16 JSON files on disk and read again; one of them is torn (its end is missing) and left out."""
    path = _label_shards(t, 16)
    torn = t.spark.read.text(f"{path}/shard=7")
    torn.where("value <> '}'").coalesce(1).write.mode("overwrite").text(f"{path}-torn/shard=7")  # one shard
    files = [f"{path}/shard={k}" for k in range(16) if k != 7 and k in _shards_of(t, 16)]
    rows = S.keyed_json(t.spark, [*files, f"{path}-torn/shard=7"], _LABEL)
    return rows.select(F.col("key").cast("long").alias("doc_id"), F.col("value.quality").alias("quality"), F.col("value.toxic").alias("toxic"))


def _shards_of(t: Tables, shards: int) -> set[int]:
    """Shards that have a label; a row for each."""
    return {r[0] for r in t.labels.select(H.shard_of(F.col("doc_id"), shards).cast("int")).distinct().collect()}


@query("SRC-04", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 9 ELSE toxic END AS toxic FROM labels")
def keyed_json_strict(t: Tables) -> DataFrame:
    """Files that must all be whole: a torn one would fail the query. Every tenth key is in a later folder too, which wins it."""
    path, later = _label_shards(t, 8), shared_path(t.spark, "labels-json")
    stores.write_keyed_json(t.labels.where("doc_id % 10 = 0").withColumn("v", F.struct("quality", F.lit(9).alias("toxic"))), f"{later}/z", "doc_id", "v", 4)
    rows = S.keyed_json(t.spark, [f"{path}/*", f"{later}/z/*"], _LABEL, torn="fail", rank=F.col("_metadata.file_path").contains("/z/").cast("int"))
    return rows.select(F.col("key").cast("long").alias("doc_id"), F.col("value.toxic").alias("toxic"))


@query("SRC-15 FLT-13", """
    SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN md5(text) END AS description, CASE WHEN doc_id % 3 = 0 THEN 'male' WHEN doc_id % 3 = 1 THEN 'female' END AS gender,
        CASE WHEN doc_id % 5 < 3 THEN 60.5::DOUBLE + doc_id % 90 WHEN doc_id % 5 = 3 THEN 1.0::DOUBLE END AS bpm, doc_id % 2 = 0 AS current FROM documents""")
def conditioning_loaders(t: Tables) -> DataFrame:
    """Typed reading of loose JSON: a description must be a string, a gender one of two, a tempo a number or a boolean."""
    d = F.col("doc_id")
    raw = F.to_json(F.struct(
        F.when(d % 4 != 1, F.md5(F.col("text").cast("binary"))).alias("description"), F.when(d % 4 == 1, d).alias("description_number"),
        F.element_at(F.array(F.lit("male"), F.lit("female"), F.lit("robot")), (d % 3 + 1).cast("int")).alias("gender"), F.concat(F.lit("audio_llm_v"), d % 2 + 1).alias("captioner"),
    ))
    raw = F.regexp_replace(raw, "description_number", "description")
    tempo = F.when(d % 5 < 3, F.concat(F.lit('{"bpm": '), (60.5 + d % 90).cast("string"), F.lit("}"))).when(d % 5 == 3, F.lit('{"bpm": true}')).otherwise(F.lit('{"bpm": "97"}'))
    made = t.documents.select("doc_id", F.parse_json(raw).alias("tags"), F.parse_json(tempo).alias("tempo"))
    return S.conditioned(made).select("doc_id", "description", "gender", "bpm", (F.col("captioner") == "audio_llm_v1").alias("current"))


@query("FLT-01 SRC-07", """
    SELECT user_id, count(*) FILTER (event_id % 5 = 0 AND user_id % 4 = 0 AND event_id // 5 % 4 = 0) AS valid, count(*) FILTER (NOT (event_id % 5 = 0 AND user_id % 4 = 0 AND event_id // 5 % 4 = 0)) AS dropped FROM events GROUP BY user_id""")
def word_validity(t: Tables) -> DataFrame:
    """Words as loose JSON made of the columns: a text and two numbers are a word; booleans are no numbers and numbers no text."""
    kind, d = (lambda k, *values: F.element_at(F.array(*[F.coalesce(v.cast("string"), F.lit("0")) for v in values]), (k + 1).cast("int"))), F.col("event_id")
    number = lambda k, x: kind(k, x, F.concat(F.lit('"'), x.cast("string"), F.lit('"')), F.lit("true"), F.lit("null"))
    word = kind(d % 5, F.to_json(F.array("event_type")).substr(F.lit(2), F.length("event_type") + 2), d, F.lit("null"), F.lit("false"), F.lit("[]"))
    start, end = number(F.col("user_id") % 4, F.coalesce(F.col("value"), F.lit(0.0))), number(F.floor(d / 5) % 4, d)
    raw = F.concat(F.lit('{"word": '), word, F.lit(', "start": '), start, F.lit(', "end": '), end, F.lit("}"))
    ok = S.valid_json_word(F.parse_json(raw))
    return t.events.groupBy("user_id").agg(F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~ok, 1)).alias("dropped"))


@query("SRC-16", """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unknown_vocals' WHEN quality = 1 AND toxic = 0 THEN 'vocals' ELSE 'instrumental' END AS vocals, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS n_dropped
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def lyrics_state(t: Tables) -> DataFrame:
    """Labels as lyrics: poor ones are null, toxic ones have no valid word, the others one of two; no label, no entry."""
    word = lambda w, a, b: F.struct(F.lit(w).alias("word"), F.lit(a).cast("double").alias("start"), F.lit(b).cast("double").alias("end"))
    words = F.array(word("a", 0.0, 1.0), word("b", 1.0, None))
    words = F.when(F.col("toxic") == 0, words).otherwise(F.array(word("b", 1.0, None)))
    entries = t.labels.select("doc_id", F.when(F.col("quality") == 1, F.struct(words.alias("words"))).alias("value"), F.lit(True).alias("present"))
    return S.lyrics_state(t.documents.select("doc_id").join(entries, "doc_id", "left")).select("doc_id", "vocals", "n_dropped")


@query("SRC-05 SRC-17 FLT-14", """
    WITH s AS (SELECT conv_id, turn, round(turn * 1.23456::DOUBLE, 3) AS a, CASE turn % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'verse' WHEN 2 THEN NULL WHEN 3 THEN 'chorus' ELSE 'noise' END AS label FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY a) - 1 AS i FROM s WHERE label IN ('verse', 'chorus'))
    SELECT conv_id, i, label, a AS start FROM k""")
def structure_segments(t: Tables) -> DataFrame:
    """Segments of a whitelist of labels, rounded to milliseconds, by start; they come in reverse."""
    label = F.element_at(F.array(F.lit("start"), F.lit("verse"), F.lit(None).cast("string"), F.lit("chorus"), F.lit("noise")), (F.col("turn") % 5 + 1).cast("int"))
    segment = F.struct((F.col("turn") * 1.23456).alias("start"), ((F.col("turn") + 1) * 1.23456).alias("end"), label.alias("label"))
    songs = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(segment), False).alias("segments"))
    kept = songs.select("conv_id", F.posexplode(S.section_segments(F.col("segments"))).alias("i", "s"))
    return kept.select("conv_id", F.col("i").cast("long").alias("i"), F.col("s.label").alias("label"), F.col("s.start").alias("start"))


@query("SRC-06 SRC-18 ARR-01", r"""
    WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations)
    SELECT conv_id, turn, len(ws) AS n_groups, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS n_flat, array_to_string(list_transform(ws, lambda x: CAST(length(x) AS VARCHAR)), ',') AS sizes FROM w""")
def csr_roundtrip(t: Tables) -> DataFrame:
    """Ragged groups as a flat array of 16-bit integers with 32-bit offsets, and back."""
    ws = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    groups = F.transform(ws, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: i.cast("smallint")))
    made = t.conversations.select("conv_id", "turn", groups.alias("g")).select("conv_id", "turn", F.flatten("g").alias("flat"), A.group_offsets(F.col("g")).alias("o"))
    back = made.select("conv_id", "turn", F.size("flat").cast("long").alias("n_flat"), A.regrouped(F.col("flat"), F.col("o")).alias("b"))
    return back.select("conv_id", "turn", F.size("b").cast("long").alias("n_groups"), "n_flat", F.array_join(F.transform("b", lambda g: F.size(g).cast("string")), ",").alias("sizes"))


@query("SRC-11 SRC-13", """
    WITH e AS (SELECT vec_id, CASE WHEN label <> 3 THEN embedding[1:12] ELSE embedding[1:10] END AS c FROM embeddings)
    SELECT doc_id, coalesce(len(c) = 12, false) AS present, round(CASE WHEN len(c) = 12 THEN list_sum(list_transform(c, lambda x: x::DOUBLE)) ELSE 0.0 END, 6) AS total FROM documents LEFT JOIN e ON vec_id = doc_id""")
def chroma_or_zeros(t: Tables) -> DataFrame:
    """A sidecar of 12 values a song: zeros where it is missing or has another length."""
    side = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.slice("embedding", F.lit(1), F.when(F.col("label") != 3, 12).otherwise(10)).alias("c"))
    xs, present = P.or_zeros(F.col("c"), 12)
    return t.documents.select("doc_id").join(side, "doc_id", "left").select("doc_id", present.alias("present"), F.round(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SRC-12 UDF-01 UDF-02", """
    SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN length(text) END AS size, doc_id % 9 = 0 AS corrupt FROM documents""")
def decoded_or_corrupt(t: Tables) -> DataFrame:
    """A decoder as a pluggable backend: broken input is a row with an error, not a failed task."""
    from corpusmill.functions import kernels

    coded = F.when(F.col("doc_id") % 9 == 0, F.lit("%broken%")).otherwise(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", ""))
    out = kernels.mapped(t.documents.select("doc_id", coded.alias("content")), "doc_id", "content", "base64")
    return out.select("doc_id", F.length("result").cast("long").alias("size"), F.col("error").isNotNull().alias("corrupt"))


@query("SRC-19", "SELECT * FROM (VALUES ('dac', 44100, 9, 1024, 86, 512), ('spectrostream', 48000, 32, 1024, 25, 1920)) v(codec, sample_rate, n_codebooks, vocab_size, frame_rate_hz, hop)")
def codec_table(t: Tables) -> DataFrame:
    return S.codecs(t.spark)


@query("SRC-20", "SELECT doc_id, md5(lower(coalesce(text, ''))) AS digest FROM documents")
def tags_fallback(t: Tables) -> DataFrame:
    """The first of three sources that has rows: the latest one is empty, the cache is whole, the labels are not asked."""
    layers = [t.documents.where("lang = 'xx'"), t.documents, t.labels]
    return S.first_with_rows(layers).select("doc_id", F.md5(F.lower(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


@query("SRC-21", """
    WITH d AS (SELECT doc_id, n_chars AS total, least(4, n_chars // 500) AS k, CAST(floor(n_chars * 0.05) AS BIGINT) AS lo FROM documents),
    e AS (SELECT *, greatest(lo, total - 500 - lo) AS hi FROM d)
    SELECT doc_id, CASE WHEN total <= 500 THEN '0' WHEN k <= 1 THEN CAST(least(CAST(floor(total * 0.25) AS BIGINT), total - 500) AS VARCHAR)
        ELSE array_to_string(list_transform(range(k), lambda i: CAST(CAST(floor(lo + (hi - lo) * (i::DOUBLE / greatest(k - 1, 1))) AS BIGINT) AS VARCHAR)), ',') END AS starts FROM e""")
def excerpt_starts(t: Tables) -> DataFrame:
    """Up to four windows of 500 characters of each text."""
    return t.documents.select("doc_id", F.array_join(S.excerpts(F.col("n_chars"), 500), ",").alias("starts"))


@query("SRC-23 SRT-03", """
    WITH w AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 60) SELECT o_orderkey FROM w WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def sample_wave(t: Tables) -> DataFrame:
    """The first 60 keys of a wave, less those that the copy has."""
    first = t.orders.where("o_orderstatus = 'F'").select("o_orderkey").orderBy("o_orderkey").limit(60)
    return joins.pending(first, t.orders.where("o_orderpriority = '1-URGENT'"), "o_orderkey")


@query("SNK-01 SNK-03", f"""
    WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'new' END AS v FROM documents WHERE {_H8.format('CAST(doc_id AS VARCHAR)')} % 8 < 3)
    SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN n.doc_id IS NOT NULL THEN n.v ELSE source END AS value FROM documents d LEFT JOIN n USING (doc_id)""")
def upsert_shards(t: Tables) -> DataFrame:
    """A store of eight shards, three of which are upserted into; a null of the new rows wins as well."""
    path, key = shared_path(t.spark, "store"), F.col("doc_id").cast("string").alias("key")
    stores.put(t.documents.select(key, F.col("source").alias("value")), path, shards=8)
    new = t.documents.where(H.shard_of(F.col("doc_id"), 8) < 3).select(key, F.when(F.col("doc_id") % 3 != 0, "new").alias("value"))
    stores.put(new, path, shards=8)
    return stores.current(t.spark, path).select("key", "value")


@query("SNK-08 STM-12", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0 OR doc_id % 15 = 0")
def quarantine_union(t: Tables) -> DataFrame:
    """Names that could not be read in two runs."""
    return stores.quarantine(t.documents.where("doc_id % 10 = 0").select("doc_id"), t.documents.where("doc_id % 15 = 0").select("doc_id"))


@query("SNK-12", "SELECT source, doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def wave_cleanup(t: Tables) -> DataFrame:
    """What a cleanup would delete of each wave: files that the packed index holds. It refuses to plan while that is empty."""
    return stores.cleanup_plan(t.documents.select("source", "doc_id", "n_chars"), t.labels, "doc_id")


@query("SNK-13 JOIN-20", "SELECT d.doc_id, l.quality, n_chars FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0")
def corrupt_cleanup(t: Tables) -> DataFrame:
    """Files that are there and that the manifest calls corrupt, with its status."""
    return stores.status_plan(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", "quality"), "doc_id", F.col("quality") == 0)


@query("SNK-14", """
    SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS kept FROM documents""")
def copied_if_absent(t: Tables) -> DataFrame:
    """Rows that a copy lacks are written into it; what it has stays. The copy is verified against the source."""
    path = shared_path(t.spark, "copy")
    there = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "source", F.lit(True).alias("kept"))
    there.write.parquet(path)
    return stores.copy_missing(t.documents.select("doc_id", "source", F.lit(False).alias("kept")), path, "doc_id")


@query("SNK-15 AGG-02", """
    WITH c AS (SELECT CASE WHEN n_chars / 20.0 < 20 THEN 'too_short' WHEN n_chars / 20.0 > 330 THEN 'too_long' ELSE 'ok' END AS status, n_chars FROM documents)
    SELECT status, '| ' || status || ' | ' || count(*) || ' | ' || printf('%.1f', sum(n_chars / 20.0) / 3600) || ' |' AS line FROM c GROUP BY status""")
def status_report(t: Tables) -> DataFrame:
    """Lines of a Markdown table: status, rows and hours."""
    seconds = F.col("n_chars") / 20.0
    rows = t.documents.groupBy(quality.duration_class(seconds).alias("status")).agg(F.count(F.lit(1)).alias("n"), (F.sum(seconds) / 3600).alias("hours"))
    return rows.select("status", F.format_string("| %s | %d | %.1f |", "status", "n", "hours").alias("line"))


@query("SNK-16", """
    SELECT run, source, n, n - lag(n) OVER (PARTITION BY source ORDER BY run) AS delta FROM (SELECT 'run' || k AS run, source, count(*) FILTER (doc_id % 3 < k) AS n FROM documents, (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL)""")
def run_snapshots(t: Tables) -> DataFrame:
    """A snapshot table keyed by run, written run by run, and each count's change since the run before."""
    path = shared_path(t.spark, "snapshots")
    for k in (1, 2, 3):
        count = t.documents.groupBy("source").agg(F.count(F.when(F.col("doc_id") % 3 < k, 1)).alias("n"))
        stores.snapshot(count, path, f"run{k}")
    return stores.changes(t.spark.read.parquet(path), "source", "n")


_TARGET = 31
_SPILL = f"""
    n AS (SELECT source, count(*) AS c, TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) AS w FROM documents GROUP BY 1),
    r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    pool AS (SELECT source, doc_id, row_number() OVER (ORDER BY w NULLS LAST, source, doc_id) - 1 AS i FROM r JOIN n USING (source) WHERE rn > {_TARGET}),
    free AS (SELECT source AS dst, greatest({_TARGET} - c, 0) AS k, coalesce(sum(greatest({_TARGET} - c, 0)) OVER (ORDER BY w NULLS LAST, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM n WHERE source <> 'zz'),
    mv AS (SELECT pool.source AS src, coalesce(dst, 'zz') AS dst, doc_id AS name, i FROM pool LEFT JOIN free ON i >= lo AND i < lo + k)"""


@query("JOIN-15 WIN-05 AGG-19", f"WITH {_SPILL} SELECT * FROM mv")
def rebalance_moves(t: Tables) -> DataFrame:
    """Which row beyond 31 of a source goes where: free places first, in order, then an overflow."""
    return P.move_plan(t.documents, "source", "doc_id", _TARGET, "zz")


@query("JOIN-16", """
    WITH m AS (SELECT o_custkey % 7 AS dst, o_custkey AS name FROM orders WHERE o_orderstatus = 'P'), h AS (SELECT DISTINCT o_custkey % 7 AS dst, o_custkey AS name FROM orders WHERE o_orderpriority = '5-LOW')
    SELECT DISTINCT dst, name, 'exists' AS problem FROM m SEMI JOIN h USING (dst, name) UNION ALL SELECT dst, name, 'repeated' FROM m GROUP BY ALL HAVING count(*) > 1""")
def move_collisions(t: Tables) -> DataFrame:
    f = F.col("o_custkey") % 7
    moves = t.orders.where("o_orderstatus = 'P'").select(f.alias("dst"), F.col("o_custkey").alias("name"))
    return P.collisions(moves, t.orders.where("o_orderpriority = '5-LOW'").select(f.alias("folder"), F.col("o_custkey").alias("base")), "folder", "base")


@query("AGG-23", """
    WITH m AS (SELECT l.doc_id, quality, CASE WHEN d.doc_id IS NULL THEN 'gone' ELSE 'present' END AS file FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang <> 'de') d USING (doc_id))
    SELECT quality, file, count(*) AS n, count(*) FILTER (quality = 0 AND file = 'present') AS deleted_but_present FROM m GROUP BY ALL""")
def manifest_forensics(t: Tables) -> DataFrame:
    """Status of a manifest against what is there (here all but German documents)."""
    here = t.documents.where("lang <> 'de'").select("doc_id", F.lit("present").alias("file"))
    m = t.labels.join(here, "doc_id", "left").fillna("gone", ["file"])
    return m.groupBy("quality", "file").agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("quality") == 0) & (F.col("file") == "present"), 1)).alias("deleted_but_present"))


@query("FLT-22 FLT-25", "SELECT count(*) AS n_pending, (SELECT count(*) FROM labels) AS n_done FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def guarded_run(t: Tables) -> DataFrame:
    """Counts of a run; it fails if work was pending and nothing succeeded."""
    pending = joins.pending(t.documents.select("doc_id"), t.labels, "doc_id").agg(F.count(F.lit(1)).alias("n_pending"))
    done = t.labels.agg(F.count(F.lit(1)).alias("n_done"))
    return quality.guarded(pending.crossJoin(F.broadcast(done)), "n_pending", "n_done")


@query("SRC-01", "SELECT table_name AS stem FROM information_schema.tables WHERE table_name IN ('region', 'nation', 'documents', 'events')")
def table_files(t: Tables) -> DataFrame:
    """Files of a folder by name, without reading what is in them."""
    found = S.wave_listing(t.spark, t.sf_dir, "", "*.parquet")
    return found.select("stem").where(F.col("stem").isin("region", "nation", "documents", "events")).distinct()


@query("STM-01 STM-12 UDF-03", """
    SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE source END AS value FROM documents""")
def streamed_upserts(t: Tables) -> DataFrame:
    """Two waves of files, streamed into a store as they come; the second one brings some keys again."""
    from corpusmill.streaming import waves

    root = shared_path(t.spark, "ingest")
    schema = T.StructType().add("key", T.StringType()).add("value", T.StringType())
    key = F.col("doc_id").cast("string").alias("key")
    t.documents.select(key, F.col("source").alias("value")).write.parquet(f"{root}/in/wave_1")
    waves.ingest_upserts(t.spark, f"{root}/in/wave_*", schema, f"{root}/state", f"{root}/store", shards=4)
    t.documents.where("doc_id % 3 = 0").select(key, F.lit("again").alias("value")).write.parquet(f"{root}/in/wave_2")
    waves.ingest_upserts(t.spark, f"{root}/in/wave_*", schema, f"{root}/state", f"{root}/store", shards=4)
    return t.spark.read.parquet(f"{root}/store").select("key", "value")


@query("STM-02 STM-09", "SELECT * FROM (VALUES ('w1', 'listed', 'done'), ('w1', 'counted', 'done'), ('w2', 'listed', 'done'), ('w2', 'counted', 'done'), ('w3', 'listed', 'done')) v(wave, stage, status)")
def wave_statuses(t: Tables) -> DataFrame:
    """Three waves through two stages; the last wave's second stage fails, and a second run works on that stage alone."""
    from corpusmill.streaming import waves

    status = waves.StageStatus(t.spark, shared_path(t.spark, "status"))

    def counted(_, rows: DataFrame) -> None:
        if rows.count() == 0:
            raise RuntimeError("an empty wave")

    stages = [("listed", lambda spark, rows: rows.limit(1).count()), ("counted", counted)]
    inventory = {"w1": t.documents, "w2": t.labels, "w3": t.documents.where("doc_id is null")}
    for _ in range(2):
        waves.run_waves(t.spark, inventory, stages, status)
    return t.spark.read.parquet(status.path)


_OBJECTS = """
    b AS (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.mp3' AS base FROM documents),
    k AS (SELECT base, base AS key FROM b WHERE doc_id % 3 <> 0 UNION ALL SELECT base, 'waves/wave_' || (doc_id // 150) || '/' || base FROM b WHERE doc_id % 3 = 0 OR doc_id % 4 = 0
        UNION ALL SELECT base, 'waves/wave_' || (doc_id % 5) || '/' || base FROM b WHERE doc_id % 7 = 0 UNION ALL SELECT base, 'old/' || base FROM b WHERE doc_id % 11 = 0)"""


def _objects(t: Tables) -> DataFrame:
    """Keys of files: flat, in waves of which some are the right ones, and in another folder, some more than once."""
    d = F.col("doc_id")
    base = F.concat(F.lpad(d.cast("string"), 9, "0"), F.lit(".mp3"))
    inside = lambda k: F.concat(F.lit("waves/wave_"), F.floor(k).cast("string"), F.lit("/"), base)
    keys = F.array(
        F.when(d % 3 != 0, base), F.when((d % 3 == 0) | (d % 4 == 0), inside(d / 150)), F.when(d % 7 == 0, inside(d % 5)), F.when(d % 11 == 0, F.concat(F.lit("old/"), base)),
    )
    return t.documents.select(F.explode(F.array_compact(keys)).alias("key"))


@query("AGG-19 WIN-03", f"""
    WITH {_OBJECTS}, r AS (SELECT base, key, (dense_rank() OVER (ORDER BY base) - 1) // 100 AS wave FROM k),
    p AS (SELECT base, wave, min(key) AS source, bool_or(key = 'waves/wave_' || wave || '/' || base) AS there, count(*) AS n_copies FROM r GROUP BY base, wave)
    SELECT base, wave, CASE WHEN there THEN 'already' WHEN contains(source, '/') THEN 'from folder' ELSE 'from flat' END AS status, source, n_copies FROM p""")
def wave_placement(t: Tables) -> DataFrame:
    """Every file's wave by the rank of its name, whether it is there, and which of its copies moves."""
    return P.wave_moves(_objects(t), "key", 100)


@query("AGG-19", f"""
    WITH {_OBJECTS}, r AS (SELECT base, key, (dense_rank() OVER (ORDER BY base) - 1) // 100 AS wave FROM k),
    p AS (SELECT base, wave, min(key) AS source, bool_or(key = 'waves/wave_' || wave || '/' || base) AS there, count(*) AS n_copies FROM r GROUP BY base, wave)
    SELECT wave, count(*) AS placed, count(*) FILTER (there) AS already, count(*) FILTER (NOT there AND NOT contains(source, '/')) AS from_flat, count(*) FILTER (NOT there AND contains(source, '/')) AS from_folder,
        CAST(sum(n_copies - 1) AS BIGINT) AS duplicates FROM p GROUP BY wave""")
def wave_counts(t: Tables) -> DataFrame:
    """The same plan counted by wave, with the copies that are left in place."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return P.wave_moves(_objects(t), "key", 100).groupBy("wave").agg(
        F.count(F.lit(1)).alias("placed"), n("already").alias("already"), n("from flat").alias("from_flat"), n("from folder").alias("from_folder"), F.sum(F.col("n_copies") - 1).alias("duplicates")
    )


@query("SRC-01", """
    WITH f AS (SELECT DISTINCT regexp_extract(source, '[0-9]+$') AS wave FROM documents)
    SELECT 'all' AS scope, wave, count(*) AS n FROM f GROUP BY wave UNION ALL SELECT 'one', wave, count(*) FROM f WHERE wave = '3' GROUP BY wave UNION ALL SELECT 'flat', NULL, 1""")
def wave_scopes(t: Tables) -> DataFrame:
    """Files listed in all waves, in one of them, and beside the waves; contents are not read. Each wave has a file with its number of
    texts, and one file lies beside the waves."""
    root = shared_path(t.spark, "waves")
    sizes = t.documents.groupBy(F.concat(F.lit("wave_"), F.regexp_extract("source", "[0-9]+$", 0)).alias("folder")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    sizes.repartition("folder").write.partitionBy("folder").text(f"{root}/written")
    stores.renamed(t.spark, f"{root}/written", "folder=", f"{root}/waves")
    t.documents.agg(F.count(F.lit(1)).cast("string").alias("value")).coalesce(1).write.text(f"{root}/flat")
    scopes = {"all": (root, "all"), "one": (root, "3"), "flat": (f"{root}/flat", "")}
    found = None
    for scope, (where, which) in scopes.items():
        listed = S.wave_listing(t.spark, where, which, "part-*.txt").groupBy("wave").agg(F.count(F.lit(1)).alias("n")).select(F.lit(scope).alias("scope"), "wave", "n")
        found = listed if found is None else found.union(listed)
    return found


_FAILED = "SELECT CAST(doc_id AS VARCHAR) AS item FROM documents WHERE {}"


@query("SNK-08 STM-12 UDF-01", f"SELECT 'union' AS mode, item FROM ({_FAILED.format('doc_id % 9 = 0 OR doc_id % 15 = 0')}) UNION ALL SELECT 'overwrite', item FROM ({_FAILED.format('doc_id % 15 = 0')})")
def failed_items(t: Tables) -> DataFrame:
    """Texts decoded in two runs, in which different ones are broken: the manifest of failed items that the second run unites with the
    first one's, and the one that it writes in its place."""
    from corpusmill.functions import kernels

    def decoded(broken: str) -> DataFrame:
        coded = F.when(F.expr(broken), F.lit("%broken%")).otherwise(F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", ""))
        return kernels.mapped(t.documents.select("doc_id", coded.alias("content")), "doc_id", "content", "base64")

    found = None
    for mode in ("union", "overwrite"):
        path = shared_path(t.spark, "failed")
        stores.record_failures(decoded("doc_id % 9 = 0"), path, "doc_id")
        rows = stores.record_failures(decoded("doc_id % 15 = 0"), path, "doc_id", union=mode == "union").select(F.lit(mode).alias("mode"), F.col("key").alias("item"))
        found = rows if found is None else found.union(rows)
    return found
