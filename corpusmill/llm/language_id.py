"""Language ID: a convolutional network over bytes, trained in numpy, applied to fixed-length windows.

Each byte (A-Z lower-cased) is one-hot; filters of several widths slide over a window of WINDOW bytes; each filter's largest
response over the window goes through a rectifier into a softmax layer. A text is cut into consecutive windows that cover all
of it, the last one padded; the languages' log-probabilities are averaged over its windows, weighted by their bytes.

A trained filter's response to two neighbouring bytes is read from a table of all byte pairs, which is the same sum as the
convolution and needs no multiplication. Training uses Adam on windows of a bounded sample: PER_LANGUAGE documents of each
language and SAMPLE_BYTES of text at most; the STEPS batches are drawn from all windows of that sample, each language as likely
as the others. Scoring is one pass without a shuffle, a bounded number of windows at a time.

A text that is null or has no letter is `und` with score 0. Texts of any length are scored whole. With no labelled rows
everything is `und`. Repeated rows get equal results. Columns called like the two that are added are replaced. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm._fit import fold, sample
from corpusmill.llm._words import buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
PER_LANGUAGE = 400
SAMPLE_BYTES = 32 << 20
STEPS, BATCH, RATE = 320, 96, 0.02
FOLDS, HELD_OUT_FOLD = 3, 1
UNKNOWN = "und"
_GROUP = 2048  # windows scored at once

_FOLD_CASE = np.arange(256, dtype=np.uint8)
_FOLD_CASE[ord("A") : ord("Z") + 1] += 32


@dataclass
class Model:
    languages: list[str]
    filters: dict[int, np.ndarray]  # width -> [width, 256, FILTERS]
    bias: np.ndarray  # of all filters
    dense: np.ndarray
    shift: np.ndarray

    def tables(self) -> dict[int, tuple[np.ndarray, np.ndarray | None]]:
        """Per width: responses to byte pairs at the first two places, and at the next one or two."""
        out = {}
        for width, f in self.filters.items():
            pair = (f[0][None, :, :] + f[1][:, None, :]).reshape(65536, FILTERS)  # index: first + 256 * second
            rest = None if width == 2 else f[2] if width == 3 else (f[2][None, :, :] + f[3][:, None, :]).reshape(65536, FILTERS)
            out[width] = (np.ascontiguousarray(pair, np.float32), None if rest is None else np.ascontiguousarray(rest, np.float32))
        return out


def log_probabilities(model: Model, tables: dict, windows: np.ndarray) -> np.ndarray:
    """Log-probability of each language for windows of bytes [n, WINDOW]."""
    codes = windows.astype(np.uint16)
    pairs = codes[:, :-1] | codes[:, 1:] << 8
    pooled = []
    for width, (first, rest) in tables.items():
        n = WINDOW - width + 1
        response = first.take(pairs[:, :n].ravel(), axis=0)
        if width == 3:
            response += rest.take(codes[:, 2 : 2 + n].ravel(), axis=0)
        elif width == 4:
            response += rest.take(pairs[:, 2 : 2 + n].ravel(), axis=0)
        # The largest value by halves: whole rows are compared at once.
        table = response.reshape(len(windows), n, FILTERS)
        while table.shape[1] > 1:
            half = (table.shape[1] + 1) // 2
            top = np.maximum(table[:, : table.shape[1] - half], table[:, half:])
            table = np.concatenate([top, table[:, table.shape[1] - half : half]], 1) if 2 * half > table.shape[1] else top
        pooled.append(table[:, 0])
    hidden = np.maximum(np.concatenate(pooled, 1) + model.bias, 0)
    logits = hidden @ model.dense + model.shift
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def cut_windows(data: np.ndarray, at: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of rows a to b - 1: bytes [n, WINDOW] (0 beyond the text), the row of each and its number of bytes."""
    size = np.diff(at[a : b + 1])
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(a, b), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    used = np.minimum(WINDOW, np.repeat(size, count) - place * WINDOW)
    index = (np.repeat(at[a:b], count) + place * WINDOW)[:, None] + np.arange(WINDOW)[None, :]
    inside = np.arange(WINDOW)[None, :] < used[:, None]
    out = np.where(inside, _FOLD_CASE[data[np.minimum(index, len(data) - 1)]], 0) if len(row) else np.zeros((0, WINDOW), np.uint8)
    return out, row, used


def fit(rows: list[tuple[str, str]], seed: int = 3) -> Model | None:
    """A model from (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    rng, parts = np.random.default_rng(seed), []
    for lang in languages:
        data, at = buffers(pa.array([t for t, x in rows if x == lang], pa.string()))
        parts.append(cut_windows(data, at, 0, len(at) - 1)[0])
    x, first = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    n_all = len(WIDTHS) * FILTERS
    weights = [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS] + [np.zeros(n_all), rng.normal(0, 0.3, (n_all, len(languages))), np.zeros(len(languages))]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        target = rng.integers(0, len(languages), BATCH)
        pick = rng.integers(first[target], first[target + 1])
        codes = x[pick].astype(np.int64)
        pooled, best = [], []
        for f, width in zip(weights, WIDTHS, strict=False):
            n = WINDOW - width + 1
            response = sum(f[k][codes[:, k : k + n]] for k in range(width))
            top = response.argmax(1)
            best.append(top)
            pooled.append(np.take_along_axis(response, top[:, None, :], 1)[:, 0])
        before = np.concatenate(pooled, 1) + weights[-3]
        hidden = np.maximum(before, 0)
        logits = hidden @ weights[-2] + weights[-1]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), target] -= 1
        p /= len(pick)
        back = (p @ weights[-2].T) * (before > 0)
        grads = []
        for k, (width, top) in enumerate(zip(WIDTHS, best, strict=True)):
            g = np.zeros_like(weights[k])
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                np.add.at(g[j], (np.take_along_axis(codes, top + j, 1), np.arange(FILTERS)[None, :]), part)
            grads.append(g)
        grads += [back.sum(0), hidden.T @ p, p.sum(0)]
        for k, g in enumerate(grads):
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            weights[k] -= RATE * (1 - 0.9 * step / STEPS) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return Model(languages, dict(zip(WIDTHS, [w.astype(np.float32) for w in weights[:3]], strict=True)), *(w.astype(np.float32) for w in weights[3:]))


def fit_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, held_out: bool = True) -> Model | None:
    """A model fitted on documents with a language outside the held-out fold (held_out False: on all of them)."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_label"))
    if held_out:
        known = known.where(fold("_key", FOLDS) != HELD_OUT_FOLD)
    return fit(sample(known, per_language, SAMPLE_BYTES))


def add_language(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its probability; columns of those names are replaced."""
    docs = docs.drop(out, score)
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def kernel(batches):
        net = held.value
        tables = net.tables() if net else {}
        for batch in batches:
            column = batch.column(place).fill_null("")
            n, total = batch.num_rows, None
            lettered = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
            if net:
                data, at = buffers(column)
                total, weight, a = np.zeros((n, len(net.languages))), np.zeros(n), 0
                edges = np.concatenate([[0], np.cumsum(-(-np.diff(at) // WINDOW))])
                while a < n:  # whole rows, about _GROUP windows at a time; a longer row in slices
                    b = max(a + 1, int(np.searchsorted(edges, edges[a] + _GROUP, "right")) - 1)
                    span = at[a : b + 1]
                    slices = [(span, a)] if b - a > 1 else [(np.array([x, min(x + _GROUP * WINDOW, span[1])]), a) for x in range(int(span[0]), int(span[1]), _GROUP * WINDOW)]
                    for local, first in slices:
                        windows, row, used = cut_windows(data, local, 0, len(local) - 1)
                        if len(windows):
                            logs = log_probabilities(net, tables, windows) * used[:, None]
                            np.add.at(total, row + first, logs)
                            np.add.at(weight, row + first, used)
                    a = b
                total /= np.maximum(weight, 1)[:, None]
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                langs = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
                scores = np.where(lettered, p[np.arange(n), best], 0.0)
            else:
                langs, scores = [UNKNOWN] * n, np.zeros(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, out, score])

    return docs.mapInArrow(kernel, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    found = add_language(docs.select(id_col, text_col), fit_from(docs, id_col, text_col, lang_col), text_col)
    return found.select(id_col, F.coalesce(fold(id_col, FOLDS) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "lang_pred", "score")
