"""Array, sequence and vector functions as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def force_length(xs: Column, n: int, pad) -> Column:
    """Cut or padded to n items."""
    return F.slice(F.concat(F.coalesce(xs, F.array().cast("array<bigint>")), F.array_repeat(F.lit(pad), n)), 1, n)


def mask(xs: Column, n: int) -> Column:
    """n booleans: which places of force_length hold items of xs."""
    size = F.coalesce(F.size(xs), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i <= size)


def delay_row(row: Column, k: int, codebooks: int, pad: int) -> Column:
    """Row k of the delay pattern: moved k places to the right, padded to a length of size + codebooks - 1."""
    return F.concat(F.array_repeat(F.lit(pad), k), row, F.array_repeat(F.lit(pad), codebooks - 1 - k))


def undelay_row(row: Column, k: int, codebooks: int) -> Column:
    return F.slice(row, F.lit(k + 1), F.size(row) - codebooks + 1)


def ladder(values: list[float], n: int, whole: bool = False) -> list[float]:
    """A list stretched or shrunk to n values by linear interpolation."""
    if n == 1 or len(values) == 1:
        out = [values[0]] * n
    else:
        at = [k * (len(values) - 1) / (n - 1) for k in range(n)]
        out = [values[int(x)] + (x - int(x)) * (values[min(int(x) + 1, len(values) - 1)] - values[int(x)]) for x in at]
    return [max(1, round(v)) for v in out] if whole else [round(v, 4) for v in out]


def resample(xs: Column, n: int) -> Column:
    """An array of doubles stretched or shrunk to n values by linear interpolation."""
    last = F.size(xs) - 1

    def at(i):
        x = i * last / F.lit(max(1, n - 1))
        low = F.floor(x).cast("int")
        a, b = F.element_at(xs, low + 1), F.element_at(xs, F.least(low + 1, last) + 1)
        return a + (x - low) * (b - a)

    return F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column, floor: float = 1e-9) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(floor))


def clamp_spans(spans: Column, least: float = 0.001, own: Column | None = None) -> Column:
    """Start and end times made monotone: each span starts at or after the end of the one before and lasts least or more.

    A true recurrence: an end that was raised moves the next start, so a running maximum would give other results. Times are
    rounded to milliseconds in the result only. spans: array<struct<start: double, end: double>>; a null span stays null, or is
    own's span at its place, whose end moves the next start as well. If own has another length, the result is own.
    """
    pairs = F.arrays_zip(spans.alias("x"), (spans if own is None else own).alias("y"))
    state = F.struct(F.lit(0.0).alias("cursor"), F.filter(spans, lambda x: F.lit(False)).alias("out"))

    def step(acc, p):
        x, y = p["x"], p["y"]
        start = F.greatest(x["start"], acc["cursor"], F.lit(0.0))
        end = F.greatest(x["end"], start + least)
        made = F.struct(F.round(start, 3).alias("start"), F.round(end, 3).alias("end"))
        kept = F.struct(y["start"].alias("start"), y["end"].alias("end"))
        cursor = F.when(x.isNotNull(), end).when(y.isNotNull(), F.greatest(acc["cursor"], y["end"])).otherwise(acc["cursor"])
        return F.struct(cursor.alias("cursor"), F.concat(acc["out"], F.array(F.when(x.isNotNull(), made).when(y.isNotNull(), kept))).alias("out"))

    clamped = F.aggregate(pairs, state, step, lambda acc: acc["out"])
    return clamped if own is None else F.when(F.size(spans) == F.size(own), clamped).otherwise(own)


def infill_order(xs: Column, cut_a: Column, cut_b: Column, pre: int, suf: int, mid: int) -> Column:
    """Prefix, suffix and middle of an array, each after its marker: the order of fill-in-the-middle training."""
    return F.concat(F.array(F.lit(pre)), F.slice(xs, F.lit(1), cut_a), F.array(F.lit(suf)), F.slice(xs, cut_b + 1, F.size(xs)), F.array(F.lit(mid)), F.slice(xs, cut_a + 1, cut_b - cut_a))


def dbfs(rms: Column) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(1e-10)))


def cosine_rate(step: Column, warmup: int, total: int, peak: float, floor: float) -> Column:
    """Learning rate: linear warm-up to peak, then half a cosine down to floor."""
    part = F.least(F.lit(1.0), (step - warmup) / F.lit(max(1, total - warmup)))
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(floor + (peak - floor) * 0.5 * (1 + F.cos(F.pi() * part)))


def guided(base: Column, stages: Column, scales: Column) -> Column:
    """base + sum of scales[i] * (stages[i + 1] - stages[i])."""
    steps = F.zip_with(F.slice(stages, 2, F.size(stages)), F.slice(stages, F.lit(1), F.size(stages) - 1), lambda b, a: b - a)
    return base + F.aggregate(F.zip_with(steps, scales, lambda d, s: d * s), F.lit(0.0), lambda t, x: t + x)


def normalised_z(xs: Column) -> Column:
    """Values less their mean, over their population deviation; null if they hardly differ."""
    n, total = F.size(xs), F.aggregate(xs, F.lit(0.0), lambda t, x: t + x)
    centred = F.transform(xs, lambda x: x - total / n)
    deviation = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda t, x: t + x * x) / n)
    return F.when(deviation > 1e-6, F.transform(centred, lambda x: x / deviation))


def l2_normalised(xs: Column, floor: float = 1e-9) -> Column:
    size = F.greatest(F.sqrt(dot(xs, xs)), F.lit(floor))
    return F.transform(xs, lambda x: x.cast("double") / size)


def chunks_of(xs: Column, size: int, most: int) -> Column:
    """Consecutive chunks of an array, at most `most`, an empty array for an empty one."""
    n = F.least(F.ceil(F.size(xs) / size).cast("int"), F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(xs, i * size + 1, size))).otherwise(F.slice(F.array(xs), F.lit(1), F.lit(0)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _running_sums(sizes: pd.Series) -> pd.Series:
    return sizes.map(lambda x: None if x is None else np.concatenate([[0], np.cumsum(x)]).astype(np.int32))


def regrouped(flat: Column, offsets: Column) -> Column:
    """Ragged groups of a flat array: group i is flat[offsets[i]] up to flat[offsets[i + 1]]."""
    n = F.size(offsets) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(flat, F.element_at(offsets, i) + 1, F.element_at(offsets, i + 1) - F.element_at(offsets, i)))).otherwise(F.slice(F.array(flat), F.lit(1), F.lit(0)))


def group_offsets(groups: Column) -> Column:
    """0 and the running sums of the groups' sizes, as ints; null for a null array. Sums run once over the sizes, whatever their number."""
    return _running_sums(F.transform(groups, lambda g: F.size(g)))


def crossfaded(a: Column, b: Column, fade: int) -> Column:
    """Two arrays joined with an equal-power fade over `fade` values at most, fewer if one of them is shorter."""
    n = F.least(F.lit(fade), F.size(a), F.size(b))
    at = lambda i: F.when(n > 1, (i - 1) / (n - 1)).otherwise(F.lit(0.0)) * F.pi() / 2
    seam = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(a, F.size(a) - n + i) * F.cos(at(i)) + F.element_at(b, i) * F.sin(at(i)))
    joined = F.concat(F.slice(a, F.lit(1), F.size(a) - n), seam, F.slice(b, n + 1, F.size(b)))
    return F.when(n > 0, joined).otherwise(F.concat(a, b))


def frame_count(samples: Column, hop: int) -> Column:
    return F.ceil(samples / hop).cast("long")


def bucketed_samples(samples: Column, hop: int, grid: int, most: int) -> Column:
    """Samples padded so that their frames are a multiple of grid; as they are where that is not more, or more than `most`."""
    target = (F.ceil(frame_count(samples, hop) / grid) * grid * hop).cast("long")
    return F.when((target <= samples) | (target > most), samples).otherwise(target).cast("long")


def frame_safe(samples: Column, hop: int, rate: int, frame_rate: float) -> Column:
    """Samples moved on by half a frame where frames counted in floating point are not the frames there are, twice at most."""
    out = samples
    for _ in range(2):  # one half frame is enough wherever the two counts differ
        off = F.ceil((out.cast("double") / F.lit(float(rate))) * F.lit(float(frame_rate))) != frame_count(out, hop)
        out = F.when(off, out + hop // 2).otherwise(out)
    return out.cast("long")


def frames_to_seconds(start: Column, end: Column, n_frames: Column, seconds: Column) -> Column:
    """start and end of a span of frames in seconds, a millisecond long at least; 0 and 0 if there is no recording."""
    ok, each = (n_frames > 0) & (seconds > 0), seconds / n_frames
    first = F.when(ok, F.greatest(F.lit(0.0), start * each)).otherwise(0.0)
    return F.struct(first.alias("start"), F.when(ok, F.greatest(first + 0.001, end * each)).otherwise(0.0).alias("end"))


def gender_of_pitch(f0: Column, least: int = 50, bound: float = 165.0) -> Column:
    """female or male by the median pitch of voiced frames, null for fewer than `least` of them."""
    xs = F.array_sort(F.filter(f0, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(xs)
    median = (F.try_element_at(xs, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(xs, F.floor(n / 2).cast("int") + 1)) / 2
    return F.when(n >= least, F.when(median >= bound, F.lit("female")).otherwise(F.lit("male")))


def cut_frame(seconds: Column, rate: int, n_frames: Column) -> Column:
    """A time as a frame from 1 to the last one."""
    return F.greatest(F.lit(1), F.least(F.floor(seconds * rate), n_frames)).cast("long")


def context_split(head: Column, tail: Column, budget: Column) -> Column:
    """Frames kept before and after a gap: all if they fit, else the tail gets half of the budget at most, the head the rest."""
    over = head + tail > budget
    kept = F.least(tail, F.floor(budget / 2))
    return F.struct(F.when(over, F.least(head, budget - kept)).otherwise(head).cast("long").alias("head"), F.when(over, kept).otherwise(tail).cast("long").alias("tail"))
