"""Quality classifier: naive Bayes support vectors (NB-SVM) over n-gram indicators of whole texts.

Features are indicators, hashed into WIDTH columns: runs of 1 to 3 tokens (white-space separated), runs of 1 to 3 token shapes
(what a token begins and ends with, its case, its length band, and whether it repeats the token before it) and runs of 3 bytes.
Each indicator is scaled by the logarithm of the ratio of its smoothed document frequencies in the two classes; a linear model
with hinge loss (dual variables between 0 and COST) is then fitted by dual coordinate descent, and a logistic curve on held-back
rows of the sample turns margins into scores. Its two parameters weigh the sample's classes by their share among all labelled
rows.

The model is fitted on the driver from a bounded sample: PER_CLASS rows of each class and SAMPLE_BYTES of text at most. Then
every row is scored in one pass without a shuffle. Texts of any length are scored whole. A null or empty text has no features
and gets the score of the intercept. A column called like the one that is added is replaced. With no labelled rows, or rows of one class only, scores are that class's share (0.5 with none). Repeated rows get
equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm._fit import fold, sample
from corpusmill.llm._scratch import fresh
from corpusmill.llm._words import buffers, chunks, mix64, power_tables

WIDTH = 1 << 16
PER_CLASS = 3000
SAMPLE_BYTES = 48 << 20
FOLDS, HELD_OUT_FOLD = 4, 2
THRESHOLD = 0.7
SMOOTHING = 1.0
#: Bytes of text whose features are found at once (about 200 bytes of memory each).
CHUNK_BYTES = 1 << 18
COST = 1.0
EPOCHS = 12

# Kinds of bytes: 0 white space, 1 lower case, 2 upper case, 3 digit, 4 from 0x80 on; then one kind for each mark or group.
_KIND = np.full(256, 5, np.uint64)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 4
for _k, _marks in enumerate((".", ",", "!?", ":;", "|", "#", "$", "%", "&", "*", "<>", "()[]{}", "'\"", "-_", "/\\", "@")):
    for _m in _marks:
        _KIND[ord(_m)] = 6 + _k
_LENGTHS = np.searchsorted([2, 4, 8, 16, 32, 64], np.arange(66), "right").astype(np.uint64)


def _slot(codes: np.ndarray, salt: int) -> np.ndarray:
    return (mix64(codes ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(48)).astype(np.int64)


def feature_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """Feature columns of each text, with repeats, in order of rows."""
    data, at = buffers(column)
    for row, stop in chunks(at, CHUNK_BYTES):
        raw, edges = data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        kind = _KIND[raw]
        inside = kind > 0
        opens, closes = inside.copy(), inside.copy()
        if len(raw):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            full = np.diff(edges) > 0
            opens[edges[:-1][full]] = inside[edges[:-1][full]]
            closes[edges[1:][full] - 1] = inside[edges[1:][full] - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        first = np.searchsorted(start, edges)
        size = end - start
        up, down = power_tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        value = (sums[end] - sums[start]) * down[start]
        same = np.zeros(len(start), bool)  # repeats the token before it
        if len(start) > 1:
            same[1:] = (size[1:] == size[:-1]) & (value[1:] == value[:-1])
            same[first[:-1][first[:-1] < len(start)]] = False
        second = kind[np.minimum(start + 1, np.maximum(end - 1, 0))] if len(start) else kind[:0]
        shape = ((kind[start] * np.uint64(32) + second) * np.uint64(32) + kind[end - 1]) * np.uint64(16) + _LENGTHS[np.minimum(size, 65)] * np.uint64(2) + same
        grams = []
        for salt, tokens in ((0, shape), (4, value)):
            for n in (1, 2, 3):
                code = tokens[: max(0, len(tokens) - n + 1)].copy()
                for k in range(1, n):
                    code = mix64(code) + tokens[k : k + len(code)]
                grams.append(_slot(code, salt + n))
        wide = raw.astype(np.uint64)
        triples = _slot(wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16), 9) if len(raw) > 2 else np.zeros(0, np.int64)
        for r in range(stop - row):
            a, b, x, y = first[r], first[r + 1], edges[r], edges[r + 1]
            yield np.concatenate([*(g[a : max(a, b - k % 3)] for k, g in enumerate(grams)), triples[x : max(x, y - 2)]])


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, column: pa.Array) -> np.ndarray:
        seen, out = np.zeros(WIDTH, bool), []
        for ids in feature_rows(column):
            seen[ids] = True
            active = np.flatnonzero(seen)
            out.append(self.bias + self.weight[active].sum() / np.sqrt(max(1, len(active))))
            seen[active] = False
        return np.array(out, np.float64)

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(column) + self.shift, -700, 700)))


def dual_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: float, epochs: int, seed: int = 5) -> np.ndarray:
    """Weights (the last is the intercept) of a linear model with hinge loss, fitted one dual variable at a time.

    rows: columns whose indicator is 1, each with the value ratio / root of their number; values are made as they are used.
    """
    w, alpha, rng = np.zeros(WIDTH + 1), np.zeros(len(y)), np.random.default_rng(seed)
    squares = ratio * ratio
    norms = np.array([squares[ids].sum() / max(1, len(ids)) + 1 for ids in rows])
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids = rows[i]
            v = ratio[ids] / np.sqrt(max(1, len(ids)))
            slope = y[i] * (w[ids] @ v + w[-1]) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[ids] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def _curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton's method with a small ridge."""
    x, beta = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    target = np.where(y > 0, (weight[y > 0].sum() + 1) / (weight[y > 0].sum() + 2), 1 / (weight[y < 0].sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * np.array([beta[0] - 1, 0])
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(rows: list[tuple[str, int]], shares: dict[int, int]) -> Model:
    """A model from (text, 0 or 1) rows; shares: labelled rows of each class in all."""
    y = np.array([1.0 if q == 1 else -1.0 for _, q in rows])
    ratio = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
    if len(set(y.tolist())) < 2:
        ratio = ratio if len(rows) else 0.5
        return Model(np.zeros(WIDTH), 0.0, 1.0, float(np.log(ratio / (1 - ratio))))
    found = [np.unique(ids).astype(np.uint16) for ids in feature_rows(pa.array([t for t, _ in rows], pa.string()))]
    back = np.arange(len(rows)) % 5 == 4
    if len(set(y[back].tolist())) < 2 or len(set(y[~back].tolist())) < 2:
        back[:] = True

    def train(use: np.ndarray) -> tuple[np.ndarray, float]:
        counts = {s: np.full(WIDTH, SMOOTHING) for s in (1.0, -1.0)}
        for i in np.flatnonzero(use):
            counts[y[i]][found[i]] += 1
        r = np.log(counts[1.0] / ((y[use] > 0).sum() + 2 * SMOOTHING)) - np.log(counts[-1.0] / ((y[use] < 0).sum() + 2 * SMOOTHING))
        w = dual_descent([found[i] for i in np.flatnonzero(use)], r, y[use], COST, EPOCHS)
        return w[:-1] * r, float(w[-1])

    weight, bias = train(~back if not back.all() else back)
    margin = np.array([bias + weight[found[i]].sum() / np.sqrt(max(1, len(found[i]))) for i in np.flatnonzero(back)])
    yb = y[back]
    factor = np.where(yb > 0, shares.get(1, 1) / max(1, (yb > 0).sum()), shares.get(0, 1) / max(1, (yb < 0).sum()))
    slope, shift = _curve(margin, yb, factor * len(yb) / factor.sum())
    return Model(weight, bias, slope, shift)


def fit_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, held_out: bool = True) -> Model:
    """A model fitted on labelled documents outside the held-out fold (held_out False: on all labelled documents)."""
    marks = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_label")).where("_label in (0, 1)").distinct()
    if held_out:
        marks = marks.where(fold(id_col, FOLDS) != HELD_OUT_FOLD)
    shares = {r["_label"]: r["n"] for r in marks.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    return fit(sample(texts, per_class, SAMPLE_BYTES, marks.withColumnRenamed(id_col, "_id")), shares)


def add_scores(docs: DataFrame, model: Model, out: str = "score", text_col: str = "text") -> DataFrame:
    """docs with the score of each text; a column of that name is replaced."""
    docs = docs.drop(out)
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def kernel(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(batch.column(place)), pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(kernel, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    scored = add_scores(docs.select(id_col, text_col), fit_from(docs, labels, id_col, text_col), text_col=text_col)
    return scored.select(
        id_col, F.coalesce(fold(id_col, FOLDS) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose score reaches the threshold."""
    out = fresh(docs.columns, "_score")
    return add_scores(docs, fit_from(docs, labels, id_col, text_col), out, text_col).where(F.col(out) >= threshold).select(*docs.columns)
