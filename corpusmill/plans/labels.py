"""Queries on labels, prompts and captions: folding, parsing and naming, on texts made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import kernels
from corpusmill.functions import markers as M
from corpusmill.functions import text as X
from corpusmill.plans.catalog import Tables, query


def picked(values, by: Column) -> Column:
    """The by-th of some literals, counted round."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _pick(values, by: str) -> str:
    listed = ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[1 + {by} % {len(values)}]"


_WHICH = "(event_id * 7 + user_id)"


def _alias(values, by: str = _WHICH) -> Column:
    """One of some spellings for each event, with its case and the white space around it changed from event to event."""
    x, k = picked(values, F.expr(by)), F.col("event_id") % 4
    return F.when(k == 0, F.upper(x)).when(k == 1, F.concat(F.lit("  "), F.initcap(x))).when(k == 2, F.concat(x, F.lit(" "))).otherwise(x)


#: Every alias, and what is none.
_GENDERS = (*X.GENDERS, "mixed", "robot", "males", None)


@query("STR-04", f"""
    WITH a AS (SELECT event_id, {_pick(_GENDERS, _WHICH)} AS x FROM events)
    SELECT event_id, CASE WHEN x IN ('male', 'm', 'man', 'men', 'boy', 'guy') THEN 'male' WHEN x IN ('female', 'f', 'woman', 'women', 'girl') THEN 'female' ELSE 'unknown_gender' END AS gender FROM a""")
def gender_fold(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.gender_label(_alias(_GENDERS)).alias("gender"))


_VOCALS = (*X.VOCALS, "inst", "choir", "no voice", None)


@query("STR-07", f"""
    WITH a AS (SELECT event_id, {_pick(_VOCALS, _WHICH)} AS x FROM events)
    SELECT event_id, CASE WHEN x IN ('vocals', 'vocal', 'voice', 'sung') THEN 'vocals' WHEN x IN ('instrumental', 'no_vocals', 'no_vocal') THEN 'instrumental' ELSE 'unknown_vocals' END AS vocals FROM a""")
def vocal_fold(t: Tables) -> DataFrame:
    """Spellings with hyphens and spaces for underscores among them."""
    said = _alias(_VOCALS)
    return t.events.select("event_id", X.vocal_label(F.when(F.col("user_id") % 2 == 0, F.replace(said, F.lit("_"), F.lit("-"))).otherwise(F.replace(said, F.lit("_"), F.lit(" ")))).alias("vocals"))


@query("STR-08", "SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang END AS code FROM documents")
def language_fold(t: Tables) -> DataFrame:
    """Languages written as names and with prefixes come back as codes."""
    lang = F.col("lang")
    said = F.when(lang == "en", "English").when(lang == "fr", "lang:fr").when(lang == "de", "language:German").otherwise(F.upper(lang))
    return t.documents.select("doc_id", X.language_code(said).alias("code"))


_TEMPOS = ("slow", "tempo: 97", "120bpm", "181.5 BPM", "fast", "-5", "quick", None)


@query("STR-05", """
    WITH v AS (SELECT event_id, ([65.0, 97.0, 120.0, 181.5, 160.0, NULL, NULL, NULL])[1 + event_id % 8]::DOUBLE AS bpm FROM events)
    SELECT event_id, bpm, CASE WHEN bpm IS NULL THEN -1 ELSE len(list_filter([60, 70, 80, 90, 100, 110, 120, 130, 140, 150, 160, 170, 180], lambda e: bpm >= e)) END AS bucket FROM v""")
def tempo_parse(t: Tables) -> DataFrame:
    bpm = X.parse_tempo(picked(_TEMPOS, F.col("event_id")))
    return t.events.select("event_id", bpm.alias("bpm")).select("event_id", "bpm", X.tempo_bucket(F.col("bpm")).cast("long").alias("bucket"))


_SIGNS, _MODES = ("", "#", "b", "♯", "♭", " sharp", "-flat", "_sharp"), ("", " major", "maj", " Maj", "_minor", "min", "m", " blues")


@query("STR-06", f"""
    WITH k AS (SELECT event_id, event_id % 8 AS letter, {_pick((0, 1, -1, 1, -1, 1, -1, 1), 'user_id')} AS shift, {_pick((0, 0, 0, 0, 1, 1, 1, 2), '(event_id // 8)')} AS mode FROM events)
    SELECT event_id, CASE WHEN letter < 7 AND mode < 2 THEN (['c', 'c_sharp', 'd', 'd_sharp', 'e', 'f', 'f_sharp', 'g', 'g_sharp', 'a', 'a_sharp', 'b'])[1 + (([9, 11, 0, 2, 4, 5, 7, 0])[1 + letter] + shift + 12) % 12]
        || CASE mode WHEN 1 THEN '_minor' ELSE '_major' END END AS key FROM k""")
def key_parse(t: Tables) -> DataFrame:
    """Keys written as letter, sign and mode in every way, with and without "key:" before them; h and blues are no keys."""
    letter = F.char((F.col("event_id") % 8 + 97).cast("int"))
    said = F.concat(F.when(F.col("event_id") % 5 == 0, F.lit("Key: ")).otherwise(F.lit("")), F.when(F.col("user_id") % 3 == 0, F.upper(letter)).otherwise(letter), picked(_SIGNS, F.col("user_id")), picked(_MODES, F.floor(F.col("event_id") / 8)))
    return t.events.select("event_id", X.parse_key(said).alias("key"))


_MARKED = ("[female] [{bpm}bpm] [verse] ", "[Am] [bridge] [chorus] ", "[french] [m] [male] ", "[] [nonsense] ", "[instrumental] ", "")


@query("STR-09", """
    WITH e AS (SELECT event_id, event_id % 6 AS k, 60 + event_id % 140 AS bpm, event_type FROM events)
    SELECT event_id, ['female', 'unknown_gender', 'male', 'unknown_gender', 'unknown_gender', 'unknown_gender'][1 + k] AS gender,
        CASE WHEN k = 0 THEN CAST(bpm AS VARCHAR) ELSE 'unknown_tempo' END AS tempo, CASE WHEN k = 1 THEN 'a_minor' ELSE 'unknown_key' END AS key,
        CASE WHEN k = 4 THEN 'instrumental' ELSE 'vocals' END AS vocals, CASE WHEN k = 2 THEN 'fr' ELSE 'unknown_lang' END AS language,
        ['verse', 'bridge', 'no_section', 'no_section', 'no_section', 'no_section'][1 + k] AS section,
        CASE WHEN k = 1 THEN 'section:chorus word:' ELSE 'word:' END || event_type || ' section:solo word:end' AS body FROM e""")
def marker_parse(t: Tables) -> DataFrame:
    """Streams with every kind of prefix, an inline section and a stray inline tempo."""
    head = F.replace(picked(_MARKED, F.col("event_id")), F.lit("{bpm}"), (60 + F.col("event_id") % 140).cast("string"))
    made = t.events.select("event_id", F.concat(head, F.col("event_type"), F.lit(" [solo] [99bpm] end")).alias("text"))
    body = F.array_join(F.transform("body", lambda b: F.concat(b["kind"], F.lit(":"), b["value"])), " ")
    return M.with_markers(made, "text").select("event_id", *[F.col("header")[f].alias(f) for f in M.FAMILIES], body.alias("body"))


#: What a tag may say, and what makes it none.
_TAGS = ("male", "female", "man", "woman", "boy", "girl", "instrumental", "none", "unknown", "m", "f", "malet", "band")


@query("STR-11", f"""
    WITH e AS (SELECT event_id, event_type, {_pick(_TAGS, _WHICH)} AS x FROM events)
    SELECT event_id, 'A calm ' || event_type || ' song.' || CASE WHEN x IN ('malet', 'band') THEN ' ' || CASE WHEN event_id % 2 = 0 THEN 'GENDER: ' ELSE 'gender - ' END || CASE event_id % 4 WHEN 0 THEN upper(x) ELSE x END ELSE '' END AS caption,
        CASE WHEN x IN ('male', 'man', 'boy', 'm') THEN 'male' WHEN x IN ('female', 'woman', 'girl', 'f') THEN 'female' END AS gender FROM e""")
def gender_split(t: Tables) -> DataFrame:
    """Captions that end in a tag, in either spelling; a tag that says something else belongs to the caption."""
    label = picked(_TAGS, F.expr(_WHICH))
    tag = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("GENDER: ")).otherwise(F.lit("gender - ")), F.when(F.col("event_id") % 4 == 0, F.upper(label)).otherwise(label))
    made = t.events.select("event_id", F.concat(F.lit("A calm "), "event_type", F.lit(" song. "), tag).alias("c"))
    return made.select("event_id", X.before_gender_tag(F.col("c")).alias("caption"), X.gender_tag(F.col("c")).alias("gender"))


@query("STR-12 ARR-06", """
    SELECT event_id, 'dry ' || event_type AS drums, CASE WHEN event_id % 2 = 0 THEN 'deep ' || event_id ELSE '' END AS bass, '' AS vocals,
        CASE WHEN event_id % 3 = 0 THEN 'pads and bells' ELSE '' END AS other, md5('A song.' || chr(10)) AS rest FROM events""")
def stem_lines(t: Tables) -> DataFrame:
    """Captions of four stems from lines in any order, with bullets, sentinels and a second line of the same stem."""
    text = F.expr("""concat('A song.\\n* DRUMS: dry  ', event_type, '\\n', if(event_id % 2 = 0, concat('Bass - deep ', event_id), 'BASS: None.'), '\\n> vocals: n/a\\nDrums: again',
        if(event_id % 3 = 0, '\\nOTHER: pads and bells', ''))""")
    made = t.events.select("event_id", text.alias("c")).select("event_id", X.stem_captions(F.col("c")).alias("s"), X.without_stem_lines(F.col("c")).alias("r"))
    rest = F.md5(F.concat(X.stripped(F.col("r")), F.lit("\n")).cast("binary"))
    return made.select("event_id", *[F.col("s")[k].alias(name) for k, name in enumerate(X.STEMS)], rest.alias("rest"))


@query("STR-13", r"""
    WITH s AS (SELECT doc_id, trim(regexp_replace('"' || text || '"', '^\s+|\s+$', '', 'g'), ' ') AS s FROM documents),
    u AS (SELECT doc_id, list_filter(regexp_split_to_array(s[2:-2], '\s+'), lambda x: x <> '') AS w FROM s)
    SELECT doc_id, md5(array_to_string(w[1:240], ' ')) AS digest FROM u""")
def prompt_sanitised(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.sanitised(F.concat(F.lit('"'), "text", F.lit('"'))).cast("binary")).alias("digest"))


@query("STR-14", r"""
    WITH d AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents)
    SELECT doc_id, n = 0 OR n > 120 AS verbatim FROM d""")
def prompt_gate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.passes_through(F.col("text")).alias("verbatim"))


@query("STR-15", "SELECT doc_id, md5(trim(replace(text, '. ', ', '), ' ') || '. ' || lang) AS digest FROM documents")
def tags_and_lyrics(t: Tables) -> DataFrame:
    joined = F.concat_ws(". ", X.flattened_tags(F.col("text")), F.col("lang"))
    return t.documents.select("doc_id", F.md5(joined.cast("binary")).alias("digest"))


@query("STR-18", """
    WITH l AS (SELECT event_id, round(value, 1) AS a, event_id % 7 AS b FROM events WHERE value IS NOT NULL)
    SELECT event_id, round(a + b, 6) AS ladder_sum, 2 AS ladder_size, 'm' || b AS model, CASE WHEN b % 2 = 0 THEN 'vocals,drums' ELSE 'other,bass' END AS stems FROM l""")
def list_parse(t: Tables) -> DataFrame:
    """A ladder of numbers, a map id=path and a list of stems, each from a string."""
    made = t.events.where("value is not null").select("event_id", F.round("value", 1).alias("a"), (F.col("event_id") % 7).alias("b"))
    ladder = X.number_list(F.concat_ws(" , ", F.col("a").cast("string"), F.col("b").cast("string")))
    paths = F.str_to_map(F.concat(F.lit("x=/p/x,y=/p/m"), F.col("b")), F.lit(","), F.lit("="))
    stems = X.stem_list(F.when(F.col("b") % 2 == 0, F.lit("Vox, drum,voice,")).otherwise(F.lit("instruments,bass")))
    return made.select(
        "event_id", F.round(F.aggregate(ladder, F.lit(0.0), lambda x, y: x + y), 6).alias("ladder_sum"), F.size(ladder).alias("ladder_size"),
        F.element_at(F.split(F.element_at(paths, F.lit("y")), "/"), -1).alias("model"), F.array_join(stems, ",").alias("stems"),
    )


@query("STR-19", "SELECT event_id, event_id * 3 - 5 AS total, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 3 END AS n FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id, 0, 0 FROM events WHERE event_id % 4 = 0")
def fingerprint_parse(t: Tables) -> DataFrame:
    said = F.when(F.col("event_id") % 4 == 0, F.lit("ERROR: no sound")).otherwise(F.concat(F.lit("DURATION=9\nFINGERPRINT="), F.concat_ws(",", F.col("event_id"), F.col("event_id") * 2, F.lit(-5))))
    made = t.events.select("event_id", X.fingerprint(said).alias("f"))
    return made.select("event_id", F.aggregate("f", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"), F.size("f").alias("n"))


@query("STR-01 UDF-07", r"""
    WITH w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\s+')) AS w FROM conversations)
    SELECT conv_id, turn, md5(string_agg(f, ' ' ORDER BY f)) AS digest FROM (SELECT conv_id, turn, regexp_replace(lower(w), '[^a-zÀ-ɏ'']', '', 'g') AS f FROM w) WHERE f <> '' GROUP BY ALL""")
def alignment_forms(t: Tables) -> DataFrame:
    """Words in the aligner's charset, by the kernel that Spark's SQL can call; the tables' words are in NFKC as they are."""
    kernels.register(t.spark)
    words = t.conversations.select("conv_id", "turn", F.explode(X.words(F.col("text"))).alias("w")).selectExpr("conv_id", "turn", "align_form(w) as f").where("f <> ''")
    return words.groupBy("conv_id", "turn").agg(F.md5(F.array_join(F.array_sort(F.collect_list("f")), " ").cast("binary")).alias("digest"))


@query("STR-21", r"""
    WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM conversations)
    SELECT conv_id, turn, len(ws) AS n_groups, CAST(coalesce(list_sum(list_transform(ws, lambda x: list_sum(list_transform(string_split(x, ''), lambda c: unicode(c))))), 0) AS BIGINT) AS code_sum FROM w""")
def word_code_groups(t: Tables) -> DataFrame:
    """A phonemizer's hook: each word becomes a group of codes (code points stand in for phones)."""
    ws = X.words(F.lower("text"))
    groups = F.transform(ws, lambda w: F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.ascii(c)))
    total = F.aggregate(F.flatten("g"), F.lit(0).cast("long"), lambda x, y: x + y)
    return t.conversations.select("conv_id", "turn", groups.alias("g")).select("conv_id", "turn", F.size("g").cast("long").alias("n_groups"), total.alias("code_sum"))


@query("SNK-19 ARR-08", r"""
    WITH n AS (SELECT event_id, ts, regexp_replace(regexp_replace(lower(event_type || ' of User #' || user_id || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM events)
    SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '_song_' || slug[1:48] || '_id' || event_id || '.mp3' AS name, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM n""")
def output_names(t: Tables) -> DataFrame:
    """File names with a UTC stamp, and the stamp as seconds since 1970."""
    e = t.events.withColumn("at", F.to_timestamp_ltz(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    prompt = F.concat("event_type", F.lit(" of User #"), "user_id", F.lit("!"))
    stamp = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", X.output_name(stamp, F.lit("song"), prompt, F.concat(F.lit("ID-"), "event_id")).alias("name"), F.unix_seconds("at").alias("at"))


@query("SET-04", "SELECT conv_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(list(role)), lambda r: r)), lambda r: r), ',') AS roles FROM conversations GROUP BY conv_id")
def distinct_roles(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
