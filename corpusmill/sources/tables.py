"""Readers of tables, keyed JSON shards, listings and packed indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT_VERSION = 2

WORD = T.StructType().add("word", T.StringType()).add("start", T.DoubleType()).add("end", T.DoubleType())
LYRICS = (
    T.StructType().add("text", T.StringType()).add("words", T.ArrayType(WORD)).add("language", T.StringType()).add("language_probability", T.DoubleType())
    .add("avg_logprob", T.DoubleType()).add("gender", T.StringType()).add("aligned", T.IntegerType())
)
SEGMENT = T.StructType().add("start", T.DoubleType()).add("end", T.DoubleType()).add("label", T.StringType())
STRUCTURE = T.StructType().add("segments", T.ArrayType(SEGMENT)).add("bpm", T.DoubleType())
TAGS = T.StructType().add("description", T.StringType()).add("captioner", T.StringType()).add("gender", T.StringType()).add("stems", T.MapType(T.StringType(), T.StringType()))
KEY = T.StructType().add("key", T.StringType())
TEMPO = T.StructType().add("bpm", T.DoubleType())
PHONEMES = T.ArrayType(T.ArrayType(T.IntegerType()))
#: Widths of supported codecs: sample rate, codebooks, vocabulary, frames a second, samples a frame.
CODECS = {"dac": (44_100, 9, 1024, 86, 44_100 // 86), "spectrostream": (48_000, 32, 1024, 25, 1920)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_rows(files: DataFrame, value: T.DataType, torn: str = "skip") -> DataFrame:
    """(key, value, present) of rows (path, value) that each hold one JSON object of keys; a null value is kept, with present
    true. A row that isn't JSON is skipped ("skip") or raises ("fail"). A key in several keeps the value of the last path."""
    parsed = files.select((F.struct("rank", "path") if "rank" in files.columns else F.col("path")).alias("_path"), F.from_json("value", T.MapType(T.StringType(), value)).alias("_map"))
    if torn == "fail":
        parsed = parsed.withColumn("_map", F.when(F.col("_map").isNull(), F.raise_error(F.concat(F.lit("torn JSON: "), F.col("_path").cast("string")))).otherwise(F.col("_map")))
    rows = parsed.select("_path", F.explode("_map").alias("key", "_value"))
    latest = rows.groupBy("key").agg(F.max_by(F.struct("_value"), "_path").alias("_v"))
    return latest.select("key", F.col("_v._value").alias("value"), F.lit(True).alias("present"))


def keyed_json(spark: SparkSession, path: str | list[str], value: T.DataType, torn: str = "skip", rank: Column | None = None) -> DataFrame:
    """keyed_rows of JSON files, by their paths; rank (on the files) goes before the path in saying which file wins a key."""
    files = spark.read.text(path, wholetext=True)
    columns = [F.col("_metadata.file_path").alias("path"), *([rank.alias("rank")] if rank is not None else []), "value"]
    return keyed_rows(files.select(*columns), value, torn)


def torn_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of files that hold no JSON object."""
    files = spark.read.text(path, wholetext=True)
    return files.where(F.from_json("value", T.MapType(T.StringType(), T.StringType())).isNull()).select(F.col("_metadata.file_path").alias("path"))


def wave_listing(spark: SparkSession, root: str, wave: str = "all", glob: str = "*.mp3") -> DataFrame:
    """(path, wave, stem, name, size) of the files of all waves, one wave, or ("") those that lie in root itself. Contents
    are not read."""
    where = root if wave == "" else f"{root}/waves/wave_{'*' if wave == 'all' else wave}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(where)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", F.nullif(F.regexp_extract("path", r"/waves/wave_([^/]+)/", 1), F.lit("")).alias("wave"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), name.alias("name"), F.col("length").alias("size"))


def split_keys(keys: DataFrame, key: str = "key") -> DataFrame:
    """Object keys waves/wave_<digits>/<file>.mp3 as (folder, key, base); others are left out."""
    parts = F.split(key, "/")
    ok = (F.size(parts) == 3) & (F.try_element_at(parts, F.lit(1)) == "waves") & F.try_element_at(parts, F.lit(2)).rlike(r"^wave_\d+$") & F.col(key).endswith(".mp3")
    return keys.where(ok).withColumn("folder", F.element_at(parts, 2)).withColumn("base", F.element_at(parts, 3))


def checked_version(index: DataFrame, version: int = FORMAT_VERSION) -> DataFrame:
    """index, failing on the first row of another format version."""
    return index.where(F.when(F.col("format_version") == version, F.lit(True)).otherwise(F.raise_error(F.lit(f"format_version must be {version}")).isNull()))


def packed_songs(meta: DataFrame) -> DataFrame:
    """(shard_id, local_idx, name, n_frames, offset) of every song of packed shards (names, offsets with one more item)."""
    songs = meta.select("shard_id", "offsets", F.posexplode("names").alias("local_idx", "name"))
    at = F.col("local_idx") + 1
    return songs.select("shard_id", "local_idx", "name", (F.element_at("offsets", at + 1) - F.element_at("offsets", at)).alias("n_frames"), F.element_at("offsets", at).alias("offset"))


def valid_word(w: Column) -> Column:
    """A word with a text and both times (typed JSON reading has turned other types into null)."""
    return w.isNotNull() & w["word"].isNotNull() & w["start"].isNotNull() & w["end"].isNotNull()


def valid_json_word(w: Column) -> Column:
    """valid_word of loose JSON (a variant): booleans are no numbers, numbers no text."""
    kind = lambda k: F.schema_of_variant(F.try_variant_get(w, f"$.{k}", "variant"))
    number = lambda k: F.coalesce(kind(k).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.lit(False))
    return F.coalesce(kind("word") == "STRING", F.lit(False)) & number("start") & number("end")


def conditioned(df: DataFrame, tags: str = "tags", tempo: str = "tempo") -> DataFrame:
    """df with description and captioner (strings), gender (one of two) and bpm (numbers, and booleans as 1 and 0) of loose JSON
    (variants); what is of another type is null."""
    at = lambda c, k: F.try_variant_get(c, f"$.{k}", "variant")
    text = lambda c, k: F.when(F.schema_of_variant(at(c, k)) == "STRING", F.try_variant_get(c, f"$.{k}", "string"))
    kind = F.schema_of_variant(at(tempo, "bpm"))
    bpm = F.when(kind == "BOOLEAN", F.try_variant_get(tempo, "$.bpm", "boolean").cast("double")).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(tempo, "$.bpm", "double"))
    gender = text(tags, "gender")
    return df.withColumn("description", text(tags, "description")).withColumn("captioner", text(tags, "captioner")).withColumn("gender", F.when(gender.isin("male", "female"), gender)).withColumn("bpm", bpm)


def first_with_rows(layers: list[DataFrame]) -> DataFrame:
    """The first of several tables that is not empty, the last one if all are."""
    return next((d for d in layers[:-1] if not d.isEmpty()), layers[-1])


def lyrics_state(df: DataFrame, value: str = "value", present: str = "present") -> DataFrame:
    """df with words (the valid ones), n_dropped and vocals: vocals, instrumental (null or no valid word) or unknown_vocals
    (no entry at all; present is null or false)."""
    raw = F.coalesce(F.col(value)["words"], F.array().cast(T.ArrayType(WORD)))
    good = F.filter(raw, valid_word)
    state = F.when(~F.coalesce(F.col(present), F.lit(False)), "unknown_vocals").when(F.size(good) > 0, "vocals").otherwise("instrumental")
    return df.withColumn("words", good).withColumn("n_dropped", F.size(raw) - F.size(good)).withColumn("vocals", state)


#: Labels of sections that an analysis may give.
SECTION_LABELS = ("intro", "verse", "chorus", "bridge", "outro", "break", "inst", "solo")


def ordered_segments(segments: Column) -> Column:
    """Segments without null, start and end labels, by start."""
    kept = F.filter(segments, lambda s: s["label"].isNotNull() & ~s["label"].isin("start", "end"))
    return F.array_sort(kept, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def section_segments(segments: Column) -> Column:
    """Segments with a known label, times rounded to milliseconds, by start."""
    kept = F.filter(segments, lambda s: F.coalesce(s["label"].isin(*SECTION_LABELS), F.lit(False)))
    return ordered_segments(F.transform(kept, lambda s: F.struct(F.round(s["start"], 3).alias("start"), F.round(s["end"], 3).alias("end"), s["label"].alias("label"))))


def codecs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in CODECS.items()], "codec string, sample_rate int, n_codebooks int, vocab_size int, frame_rate_hz int, hop int")


def excerpts(total: Column, window: int, most: int = 4) -> Column:
    """Starts of up to `most` windows in a recording, all in samples: 0 if one window holds it; a quarter in, or where it still
    fits, if there is room for one; else evenly spread between 5 % and 95 % less a window."""
    k = F.least(F.lit(most), F.floor(total / window)).cast("int")
    low = F.floor(total * 0.05).cast("long")
    high = F.greatest(low, total - window - low)
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(low + (high - low) * (i / F.greatest(k - 1, F.lit(1)))).cast("long"))
    single = F.least(F.floor(total * 0.25).cast("long"), total - window)
    return F.when(total <= window, F.array(F.lit(0).cast("long"))).when(k <= 1, F.array(single.cast("long"))).otherwise(spread)
