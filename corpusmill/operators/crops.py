"""Crops of songs: where they start, what of words and sections falls into them, and what supervision they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.windows import grouped_row_number

BIAS = 0.9


def drawn(key: Column, salt: str) -> Column:
    """A number in [0, 1) that any engine draws alike: the first 48 bits of md5(salt:key)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / float(1 << 48)


def eligible(songs: DataFrame, words: DataFrame, key: str, frames: str, segment: int) -> DataFrame:
    """Songs with a word that fill a crop."""
    return songs.where(F.col(frames) >= segment).join(words.select(key).distinct(), key, "left_semi")


def crop_starts(songs: DataFrame, words: DataFrame, key: str, frames: str, start: str, end: str, segment: int, rate: float, bias: float = BIAS) -> DataFrame:
    """songs with crop_start, a frame in [0, frames - segment]: with probability bias such that a drawn word of the song lies
    inside the crop, if one can; else anywhere. Draws come from hashes of the key."""
    at = F.col(key)
    u = lambda salt: drawn(at, salt)
    numbered = words.select(at.alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.row_number().over(Window.partitionBy(key).orderBy(start, end)).alias("_i"))
    counts = words.groupBy(at.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    picked = songs.join(counts, at == F.col("_c"), "left").withColumn("_w", F.floor(u("word") * F.col("_n")) + 1)
    picked = picked.join(numbered, (at == F.col("_k")) & (F.col("_w") == F.col("_i")), "left")
    last = F.greatest(F.col(frames) - segment, F.lit(0))
    low, high = F.greatest(F.lit(0.0), F.col("_e") - segment / rate), F.least(last / rate, F.col("_s"))
    near = F.greatest(F.lit(0), F.least(F.round((low + u("place") * (high - low)) * rate).cast("long"), last))
    anywhere = F.floor(u("start") * (last + 1)).cast("long")
    biased = (u("coin") < bias) & F.coalesce(low <= high, F.lit(False)) & (last > 0)
    return picked.withColumn("crop_start", F.when(biased, near).otherwise(anywhere)).drop("_c", "_n", "_w", "_k", "_s", "_e", "_i")


def crop(codes: Column, start: Column, segment: int, codebooks: int, pad: int) -> Column:
    """The first codebooks of [K][T] codes, segment frames from start, padded at the end."""
    return F.transform(F.slice(codes, 1, codebooks), lambda row: F.slice(F.concat(F.slice(row, (start + 1).cast("int"), segment), F.array_repeat(F.lit(pad).cast("int"), segment)), 1, segment))


def words_in(songs: DataFrame, words: DataFrame, key: str, begin: Column, stop: Column, start: str, end: str) -> DataFrame:
    """(key, n): words with end > begin and start < stop of each song's one window; songs without any have 0."""
    windows = songs.select(F.col(key), begin.alias("_b"), stop.alias("_x"))
    hit = (F.col(end) > F.col("_b")) & (F.col(start) < F.col("_x"))
    return windows.join(words.select(key, start, end), key, "left").groupBy(key).agg(F.count(F.when(hit, 1)).alias("n"))


def injected(words: DataFrame, bounds: DataFrame, key: str, start: str, word: str, bound: str, label: str) -> DataFrame:
    """(key, place, kind, value): words in order of start with each boundary before the first word that starts at or after it;
    boundaries after the last word vanish. Words and boundaries are those of one window already."""
    events = words.select(key, F.col(start).alias("_at"), F.lit(1).alias("_side"), F.col(word).cast("string").alias("value")).union(
        bounds.select(key, F.col(bound).alias("_at"), F.lit(0).alias("_side"), F.col(label).cast("string").alias("value"))
    )
    last = words.groupBy(F.col(key).alias("_k")).agg(F.max(start).alias("_last"))
    kept = events.join(last, F.col(key).eqNullSafe(F.col("_k"))).where(F.col("_at") <= F.col("_last")).drop("_k", "_last")
    numbered = grouped_row_number(kept, [key], ["_at", "_side", "value"], "place")
    return numbered.select(key, F.col("place").cast("long").alias("place"), F.when(F.col("_side") == 1, "word").otherwise("section").alias("kind"), "value")


def wordless_share(songs: DataFrame, words: DataFrame, key: str, frames: str, start: str, end: str, segment: int, rate: float) -> DataFrame:
    """(key, n_starts, n_wordless): how many frames a crop can start at, and from how many of them it holds no word, exactly.

    A word lies in the crops that start in one range of frames; the union of a song's ranges is swept in order of where they begin,
    each adding what lies beyond the furthest end so far. A song shorter than a crop has one start; one without words is wordless.
    """
    last = F.greatest(F.col(frames) - segment, F.lit(0)).cast("long")
    tops = songs.select(key, last.alias("_last"))
    # A crop from s holds a word if s / rate < end and (s + segment) / rate > start, asked of the frames around either bound.
    a, b = F.floor(F.col(start) * rate - segment), F.ceil(F.col(end) * rate)
    first = F.coalesce(*[F.when((a + k + segment) / rate > F.col(start), a + k) for k in (-1, 0, 1, 2)])
    stop = F.coalesce(*[F.when((b + k) / rate < F.col(end), b + k) for k in (1, 0, -1, -2)])
    spans = words.join(tops, key).select(key, F.greatest(first, F.lit(0)).alias("_a"), F.least(stop, F.col("_last")).alias("_b")).where("_a <= _b")
    before = F.max("_b").over(Window.partitionBy(key).orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.col("_b") - F.greatest(F.col("_a") - 1, F.coalesce(before, F.lit(-1))), F.lit(0))
    held = spans.withColumn("_n", added).groupBy(key).agg(F.sum("_n").alias("_held"))
    return tops.join(held, key, "left").select(key, (F.col("_last") + 1).alias("n_starts"), (F.col("_last") + 1 - F.coalesce("_held", F.lit(0))).alias("n_wordless"))


def drawn_wordless(songs: DataFrame, words: DataFrame, key: str, frames: str, start: str, end: str, segment: int, rate: float, draws: int) -> DataFrame:
    """(key, n_draws, n_empty): crops drawn with seeds 0 to draws - 1 anywhere in each song, and how many hold no word."""
    last = F.greatest(F.col(frames) - segment, F.lit(0))
    every = songs.select(key, last.alias("_last"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_d"))
    digits = F.substring(F.md5(F.concat(F.lit("draw:"), F.col("_d").cast("string"), F.lit(":"), F.col(key).cast("string")).cast("binary")), 1, 12)
    at = F.floor(F.conv(digits, 16, 10).cast("long") / float(1 << 48) * (F.col("_last") + 1)).cast("long")
    drawn_at = every.select(key, "_d", at.alias("_s"))
    hits = drawn_at.join(words.select(F.col(key).alias("_k"), F.col(start).alias("_a"), F.col(end).alias("_b")), (F.col(key) == F.col("_k")) & (F.col("_b") > F.col("_s") / rate) & (F.col("_a") < (F.col("_s") + segment) / rate), "left")
    return hits.groupBy(key, "_d").agg(F.count("_k").alias("_n")).groupBy(key).agg(F.count(F.lit(1)).alias("n_draws"), F.count(F.when(F.col("_n") == 0, 1)).alias("n_empty"))
