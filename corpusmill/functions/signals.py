"""Signal kernels in Arrow batches: forced alignment, spectrum with tempo, gated loudness.

Rows of a batch that have equally long signals are worked on as one matrix. Nothing is shuffled, and a batch holds as many rows as
Spark puts into it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Forced alignment ---------------------------------------------------------------------------------------------------------


def best_path(emission: np.ndarray, tokens: list[int], blank: int = 0) -> tuple[float, list[tuple[int, int]]] | None:
    """The likeliest way to say tokens in order over all frames, with blanks before, between and after them.

    emission: log-probabilities [frames, symbols]. Returns the path's log-probability and the frames [start, end) of each token;
    None where there are too few frames (two equal tokens need a blank between them) or no tokens.
    """
    states = [blank]
    for t in tokens:
        states += [t, blank]
    n, frames = len(states), len(emission)
    if not tokens or frames < len(tokens) + sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)):
        return None
    said = emission[:, states]
    skips = np.array([k >= 2 and states[k] != blank and states[k] != states[k - 2] for k in range(n)])
    score = np.full(n, -np.inf)
    score[:2] = said[0, :2]
    back = np.zeros((frames, n), np.int8)
    for f in range(1, frames):
        one = np.concatenate([[-np.inf], score[:-1]])
        two = np.where(skips, np.concatenate([[-np.inf, -np.inf], score[:-2]]), -np.inf)
        ways = np.stack([score, one, two])
        back[f] = ways.argmax(0)
        score = ways[back[f], np.arange(n)] + said[f]
    at = n - 1 if score[n - 1] > score[n - 2] else n - 2
    total, places = float(score[at]), np.zeros(frames, np.int64)
    for f in range(frames - 1, -1, -1):
        places[f] = at
        at -= back[f, at]
    spans = []
    for k in range(len(tokens)):
        own = np.flatnonzero(places == 2 * k + 1)
        spans.append((int(own[0]), int(own[-1]) + 1))
    return total, spans


def _fit(emission: np.ndarray, tokens: list[int], start: int, end: int, blank: int) -> float:
    """Mean log-probability of a frame if tokens are said in [start, end); -inf where they do not fit."""
    start, end = max(start, 0), min(end, len(emission))
    found = best_path(emission[start:end], tokens, blank) if end > start else None
    return found[0] / (end - start) if found else -np.inf


def refine(emission: np.ndarray, words: list[list[int]], old: list[tuple[int, int] | None], blank: int = 0) -> list[tuple[int, int, bool] | None]:
    """Frames [start, end) of each word and whether they are new: those of the likeliest path through all words, or the old ones
    where these fit the word better, frame by frame. A word without tokens keeps its old span; without one it has none."""
    flat = [t for w in words for t in w]
    found = best_path(emission, flat, blank)
    out, at = [], 0
    for w, was in zip(words, old, strict=True):
        span = None
        if found and w:
            span = (found[1][at][0], found[1][at + len(w) - 1][1])
            if was and _fit(emission, w, *was, blank) > _fit(emission, w, *span, blank):
                span = None
        at += len(w)
        out.append((*span, True) if span else (*was, False) if was else None)
    return out


SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("new", T.BooleanType()))


def aligned(df: DataFrame, key: str, emission: str, words: str, old: str, blank: int = 0) -> DataFrame:
    """(key, spans, score): refine() and the whole path's log-probability for rows with emission array<array<double>>, words
    array<array<int>> and old array<struct<start, end>>. A row whose numbers do not fit together keeps its old spans, score null."""

    def one(row: dict) -> tuple[list, float | None]:
        old_spans = [None if s is None else (s["start"], s["end"]) for s in row[old] or []]
        try:
            matrix, said = np.asarray(row[emission], np.float64), [list(w or []) for w in row[words]]
            spans = refine(matrix, said, old_spans, blank)
            path = best_path(matrix, [t for w in said for t in w], blank)
            return spans, path[0] if path else None
        except (TypeError, ValueError, IndexError):
            return [None if s is None else (*s, False) for s in old_spans], None

    def kernel(batches):
        for batch in batches:
            made = [one(r) for r in batch.select([emission, words, old]).to_pylist()]
            spans = [[None if s is None else dict(zip(("start", "end", "new"), s, strict=True)) for s in x] for x, _ in made]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("new", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(spans, kind), pa.array([s for _, s in made], pa.float64())], [key, "spans", "score"])

    schema = T.StructType([df.schema[key], T.StructField("spans", SPANS), T.StructField("score", T.DoubleType())])
    return df.select(key, emission, words, old).mapInArrow(kernel, schema)


# Spectrum and tempo -------------------------------------------------------------------------------------------------------

PRIOR_BPM, LOW_BPM, HIGH_BPM = 120.0, 60.0, 180.0


def framed(signals: np.ndarray, width: int, hop: int) -> np.ndarray:
    """Whole frames [rows, frames, width] of signals [rows, samples]; a signal shorter than one is padded to one."""
    if signals.shape[1] < width:
        signals = np.pad(signals, ((0, 0), (0, width - signals.shape[1])))
    return np.lib.stride_tricks.sliding_window_view(signals, width, axis=1)[:, ::hop]


def magnitudes(signals: np.ndarray, width: int, hop: int) -> np.ndarray:
    """Magnitudes [rows, frames, width // 2 + 1] under a Hann window."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    return np.abs(np.fft.rfft(framed(signals, width, hop) * window, axis=2))


def tempo(flux: np.ndarray, frame_rate: float) -> np.ndarray:
    """Beats a minute from onset strengths [rows, frames]: the lag at which they repeat best, weighed by a log-normal prior, folded
    into [LOW_BPM, HIGH_BPM); NaN where nothing changes."""
    rows, frames = flux.shape
    centred = flux - flux.mean(1, keepdims=True)
    size = 1 << (2 * frames - 1).bit_length()
    spectrum = np.fft.rfft(centred, size, axis=1)
    repeats = np.fft.irfft(np.abs(spectrum) ** 2, size, axis=1)[:, 1:frames]
    if frames < 2:
        return np.full(rows, np.nan)
    bpm = 60.0 * frame_rate / np.arange(1, frames)
    weighed = repeats * np.exp(-0.5 * np.log2(bpm / PRIOR_BPM) ** 2)
    best = bpm[weighed.argmax(1)]
    down = best / 2.0 ** (np.floor(np.log2(best / HIGH_BPM)) + 1)
    folded = np.where(best >= HIGH_BPM, down, np.where(best < LOW_BPM, best * 2.0 ** np.ceil(np.log2(LOW_BPM / best)), best))
    return np.where((centred**2).sum(1) > 1e-12, folded, np.nan)


def spectral_figures(signals: np.ndarray, rate: float, width: int, hop: int, cutoff: float) -> dict[str, np.ndarray]:
    """high_share (of magnitudes above cutoff), centroid (mean over frames), flux (mean onset strength) and bpm of each signal."""
    found = magnitudes(signals, width, hop)
    bins = np.arange(found.shape[2]) * rate / width
    flux = np.maximum(np.diff(found, axis=1), 0).sum(2)
    strengths = flux if flux.shape[1] else np.zeros((len(signals), 1))
    return {
        "high_share": found[:, :, bins > cutoff].sum((1, 2)) / np.maximum(found.sum((1, 2)), 1e-9),
        "centroid": ((found * bins).sum(2) / np.maximum(found.sum(2), 1e-9)).mean(1),
        "flux": strengths.mean(1),
        "bpm": tempo(strengths, rate / hop),
    }


# Loudness -----------------------------------------------------------------------------------------------------------------

ABSOLUTE_GATE, RELATIVE_GATE, BLOCK_SECONDS, STEP_SECONDS = -70.0, -10.0, 0.4, 0.1
#: The two filters of the K weighting: centre in hertz, quality, gain in decibels of the shelf.
SHELF, HIGH_PASS = (1681.974450955533, 0.7071752369554196, 3.999843853973347), (38.13547087602444, 0.5003270373238773)


def k_weights(rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Coefficients (b, a) of both filters at a sample rate, which must be over twice the shelf's centre."""
    f, q, gain = SHELF
    k, high = np.tan(np.pi * f / rate), 10 ** (gain / 20)
    band = high**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = np.array([high + band * k / q + k * k, 2 * (k * k - high), high - band * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    f, q = HIGH_PASS
    k = np.tan(np.pi * f / rate)
    a0 = 1 + k / q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]))]


def k_weighted(signals: np.ndarray, rate: float) -> np.ndarray:
    """Signals [rows, samples] through the K weighting, by its response over frequencies; half a second is added for what rings on."""
    n = signals.shape[1]
    size = 1 << (n + int(rate // 2)).bit_length()
    turn = np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size)
    response = np.ones(len(turn), complex)
    for b, a in k_weights(rate):
        response *= (b[0] + b[1] * turn + b[2] * turn**2) / (a[0] + a[1] * turn + a[2] * turn**2)
    return np.fft.irfft(np.fft.rfft(signals, size, axis=1) * response, size, axis=1)[:, :n]


def loudness(signals: np.ndarray, rate: float) -> np.ndarray:
    """Integrated loudness in LUFS of mono signals [rows, samples]: mean square of blocks of 400 ms that pass both gates; -inf where
    none does or the signal is shorter than a block."""
    width, hop = round(rate * BLOCK_SECONDS), round(rate * STEP_SECONDS)
    if signals.shape[1] < width:
        return np.full(len(signals), -np.inf)
    power = (framed(k_weighted(signals, rate), width, hop) ** 2).mean(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        level = lambda x: -0.691 + 10 * np.log10(x)
        mean = lambda keep: np.where(keep, power, 0).sum(1) / keep.sum(1)
        first = level(power) > ABSOLUTE_GATE
        second = first & (level(power) > (level(mean(first)) + RELATIVE_GATE)[:, None])
        return np.where(second.any(1), level(mean(second)), -np.inf)


def gains(signals: np.ndarray, rate: float, target: float = -16.0, peak_db: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
    """Loudness of each signal and the factor that brings it to target. Where loudness cannot be told the peak goes to peak_db; no
    peak passes 1 afterwards; silence is left as it is."""
    found, peak = loudness(signals, rate), np.abs(signals).max(1, initial=0.0)
    with np.errstate(divide="ignore", over="ignore"):
        factor = np.where(np.isfinite(found), 10 ** ((target - np.where(np.isfinite(found), found, 0)) / 20), 10 ** (peak_db / 20) / np.maximum(peak, 1e-300))
        factor = np.where(peak * factor > 1, 1 / np.maximum(peak, 1e-300), factor)
    return found, np.where(peak > 0, factor, 1.0)


# On tables ----------------------------------------------------------------------------------------------------------------


def by_length(column: pa.ListArray, work: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str]) -> list[pa.Array]:
    """Columns of what work makes of the rows' signals; rows of one length are one matrix. A null or empty signal, and one with a
    value that is null or no number, has nulls."""
    out = {n: np.full(len(column), np.nan) for n in names}
    sizes = column.value_lengths().fill_null(0).to_numpy()
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        signals = values[first[rows][:, None] + np.arange(n)]
        good = np.isfinite(signals).all(1)
        if good.any():
            for name, x in work(signals[good]).items():
                out[name][rows[good]] = x
    return [pa.array(out[n], mask=np.isnan(out[n])) for n in names]


def _mapped(df: DataFrame, key: str, samples: str, work: Callable, names: list[str]) -> DataFrame:
    def kernel(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *by_length(batch.column(1), work, names)], [key, *names])

    return df.select(key, samples).mapInArrow(kernel, T.StructType([df.schema[key], *[T.StructField(n, T.DoubleType()) for n in names]]))


def with_spectrum(df: DataFrame, key: str, samples: str, rate: float, width: int = 2048, hop: int = 512, cutoff: float = 6000.0) -> DataFrame:
    """(key, high_share, centroid, flux, bpm) of rows with an array of samples."""
    return _mapped(df, key, samples, lambda x: spectral_figures(x, rate, width, hop, cutoff), ["high_share", "centroid", "flux", "bpm"])


def with_loudness(df: DataFrame, key: str, samples: str, rate: float, target: float = -16.0) -> DataFrame:
    """(key, lufs, gain) of rows with an array of samples; lufs is null where it cannot be told."""

    def work(x):
        found, factor = gains(x, rate, target)
        return {"lufs": np.where(np.isfinite(found), found, np.nan), "gain": factor}

    return _mapped(df, key, samples, work, ["lufs", "gain"])
