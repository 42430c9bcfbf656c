"""Quality gates for recordings and packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SECONDS, MAX_SECONDS = 20, 330
MAX_CLIPPED, MAX_SILENT, MIN_DBFS, MIN_BIT_RATE = 0.02, 0.60, -40.0, 96_000
FRAME_SECONDS, SILENT_DBFS, CLIP_LEVEL = 0.05, -50.0, 0.992
ENCODE_DBFS, ENCODE_CLIP_LEVEL, ENCODE_CLIPPED = -50.0, 0.9995, 0.20
MAX_STEREO_SECONDS, MAX_MONO_SECONDS = 360, 420
N_CHROMA, N_STEMS = 12, 4


def duration_class(seconds: Column, low: float = MIN_SECONDS, high: float = MAX_SECONDS) -> Column:
    """too_short, too_long or ok; both bounds are ok."""
    return F.when(seconds < low, "too_short").when(seconds > high, "too_long").otherwise("ok")


def backfilled_status(status: Column, seconds: Column, high: float = MAX_SECONDS) -> Column:
    return F.when((status == "ok") & (seconds > high), F.lit("too_long")).otherwise(status)


def _square_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))


def rms(samples: Column) -> Column:
    return F.sqrt(_square_sum(samples) / F.greatest(F.size(samples), F.lit(1)))


def dbfs(level: Column) -> Column:
    return 20 * F.log10(F.greatest(level, F.lit(1e-10)))


def frame_levels(samples: Column, width: Column) -> Column:
    """Root mean square of each whole frame of width samples; what is left over at the end is dropped."""
    frames = F.floor(F.size(samples) / width).cast("int")
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.sqrt(_square_sum(F.slice(samples, i * width + 1, width)) / width)))


def signal_figures(samples: Column, rate: Column) -> dict[str, Column]:
    """clip_ratio, silent_ratio and rms_dbfs of an array of samples, null for an empty one. Silence is judged by whole 50 ms
    frames, by the whole recording if it is shorter than one."""
    size, some = F.size(samples), F.size(samples) > 0
    levels = frame_levels(samples, F.greatest(F.lit(1), F.floor(rate * FRAME_SECONDS).cast("int")))
    whole = dbfs(rms(samples))
    share = F.size(F.filter(levels, lambda x: dbfs(x) < SILENT_DBFS)) / F.size(levels)
    return {
        "clip_ratio": F.when(some, F.size(F.filter(samples, lambda x: F.abs(x) >= CLIP_LEVEL)) / size),
        "silent_ratio": F.when(some, F.coalesce(share, F.when(whole < SILENT_DBFS, 1.0).otherwise(0.0))),
        "rms_dbfs": F.when(some, whole),
    }


def signal_reasons(clip: Column, silent: Column, level: Column, bit_rate: Column) -> Column:
    """Reasons against a recording with their figures, such as "clipped(5.0%>2%)"; none means ok."""
    percent = lambda x, digits: F.format_string(f"%.{digits}f%%", 100 * x)
    return F.array_compact(F.array(
        F.when(clip > MAX_CLIPPED, F.concat(F.lit("clipped("), percent(clip, 1), F.lit(f">{MAX_CLIPPED:.0%})"))),
        F.when(silent > MAX_SILENT, F.concat(F.lit("silent("), percent(silent, 0), F.lit(f">{MAX_SILENT:.0%})"))),
        F.when(level < MIN_DBFS, F.concat(F.lit("dead("), F.format_string("%.0f", level), F.lit(f"dBFS<{MIN_DBFS:.0f})"))),
        F.when((bit_rate > 0) & (bit_rate < MIN_BIT_RATE), F.concat(F.lit("lowbitrate("), F.floor(bit_rate / 1000).cast("string"), F.lit(f"k<{MIN_BIT_RATE // 1000}k)"))),
    ))


def encode_reason(samples: Column) -> Column:
    """Why a recording is not worth encoding: silent (also if it is empty) or clipped; null if it is."""
    level = rms(samples)
    silent = (F.size(samples) == 0) | (level <= 0) | (20 * F.log10(level + 1e-12) < ENCODE_DBFS)
    clipped = F.size(F.filter(samples, lambda x: F.abs(x) >= ENCODE_CLIP_LEVEL)) / F.greatest(F.size(samples), F.lit(1)) > ENCODE_CLIPPED
    return F.when(silent, F.lit("silent")).when(clipped, F.lit("clipped"))


def over_ceiling(seconds: Column, channels: Column) -> Column:
    """Longer than the encoder takes: 360 s in stereo, 420 s in mono."""
    return seconds > F.when(channels > 1, MAX_STEREO_SECONDS).otherwise(MAX_MONO_SECONDS)


def trainable(n_frames: Column, segment: int, pad_short: bool = False) -> Column:
    """Long enough for a crop of segment frames and two more; with padding any song of a frame."""
    return n_frames >= (1 if pad_short else segment + 2)


def pack_problems(meta: DataFrame, version: int = 2, melody: bool = False, stems: bool = False, codebooks: int | None = None) -> DataFrame:
    """(shard_id, problem) of packed shard metadata: format_version, n_codebooks, total_T, offsets, names and token_bytes; where
    the table has them also committed, expected_names, has_melody, mel_bytes, has_stems, stem_present and stem_bytes, which
    melody and stems ask for."""
    o, has = F.col("offsets"), set(meta.columns)
    checks = [
        (F.col("format_version") != version, "version"),
        (F.size(o) != F.size("names") + 1, "offsets_size"),
        (F.try_element_at(o, F.lit(1)) != 0, "first_offset"),
        (F.try_element_at(o, F.lit(-1)) != F.col("total_T"), "last_offset"),
        (F.exists(F.zip_with(F.slice(o, 2, F.size(o)), F.slice(o, F.lit(1), F.size(o) - 1), lambda b, a: b - a), lambda d: d <= 0), "order"),
        (F.size(F.array_distinct("names")) != F.size("names"), "repeated_name"),
        (F.col("token_bytes") != F.col("n_codebooks") * F.col("total_T") * 2, "bytes"),
    ]
    if "committed" in has:
        checks.append((~F.col("committed"), "uncommitted"))
    if "expected_names" in has:
        checks.append((~F.col("names").eqNullSafe(F.col("expected_names")), "membership"))
    if codebooks is not None:
        checks.append((F.col("n_codebooks") != codebooks, "codebooks"))
    if melody:
        checks.append((~F.col("has_melody") | (F.col("mel_bytes") != N_CHROMA * F.col("total_T") * 2), "melody"))
    if stems:
        checks.append((~F.col("has_stems") | (F.size("stem_present") != F.size("names")) | (F.col("stem_bytes") != N_STEMS * F.col("n_codebooks") * F.col("total_T") * 2), "stems"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in checks]))
    return meta.select("shard_id", F.explode(found).alias("problem"))


def fail_if_nothing_worked(n_pending: int, n_done: int) -> None:
    """Pending work of which none succeeded is an error, not an empty result."""
    if n_pending > 0 and n_done <= 0:
        raise RuntimeError(f"none of {n_pending} pending items succeeded")


def guarded(counts: DataFrame, pending: str, done: str) -> DataFrame:
    """One row of counts, failing if work was pending and none succeeded."""
    bad = (F.col(pending) > 0) & (F.col(done) <= 0)
    return counts.where(F.when(bad, F.raise_error(F.lit("none of the pending items succeeded")).isNull()).otherwise(F.lit(True)))


def stem_content(codes: Column, frames: Column, vocab: int = 1024) -> dict[str, Column]:
    """What an array of a stem's codes shows: out_of_range (a value below 0 or beyond the pad, which is vocab), misaligned (another
    number of frames than its song), dead (all values alike) and pads, the share of padding. A null array is misaligned; all of an
    empty one's are false and its pads 0."""
    some = F.coalesce(F.size(codes), F.lit(0)) > 0
    return {
        "out_of_range": some & F.exists(codes, lambda x: (x < 0) | (x > vocab)),
        "misaligned": ~F.coalesce(F.size(codes) == frames, F.lit(False)),
        "dead": some & (F.array_min(codes) == F.array_max(codes)),
        "pads": F.when(some, F.size(F.filter(codes, lambda x: x == vocab)) / F.size(codes)).otherwise(0.0),
    }


def nulled(df: DataFrame, text: str, logprob: str | None = None, dry: bool = False) -> tuple[DataFrame, DataFrame]:
    """df with reason, and text null where there is one (dry: as it was); and a row of counters: texts checked and flagged, rows that
    were null already, texts that are left as fit to sing, all rows, and the flagged ones by kind of reason."""
    from corpusmill.functions.text import junk_reason, word_count

    at = F.col(text)
    reason = F.when(at.isNotNull(), junk_reason(at, word_count(at), F.col(logprob) if logprob else None))
    judged = df.withColumn("reason", reason)
    n = lambda c: F.count(F.when(c, 1))
    counters = judged.agg(
        F.count(text).alias("checked"), F.count("reason").alias("flagged"), n(at.isNull()).alias("already_null"), n(at.isNotNull() & F.col("reason").isNull()).alias("vocal_ready"), F.count(F.lit(1)).alias("total"),
        n(F.col("reason") == "short").alias("short"), n(F.col("reason").startswith("junk:")).alias("junk"), n(F.col("reason") == "low_confidence").alias("low_confidence"),
    )
    return (judged if dry else judged.withColumn(text, F.when(F.col("reason").isNull(), at))), counters
