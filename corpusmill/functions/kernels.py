"""Arrow kernels where no built-in says it: word error counts, NFKC, pluggable per-row backends with error capture."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.hashing import SPLITMIX_A, SPLITMIX_B, SPLITMIX_STEP

_BACKENDS: dict[str, Callable[[], Callable]] = {}


def backend(name: str):
    """Registers a factory that makes a function of one value; it is called once in each task."""

    def add(factory: Callable[[], Callable]):
        _BACKENDS[name] = factory
        return factory

    return add


@backend("upper")
def _upper():
    return lambda x: x.upper()


@backend("peak")
def _peak():
    return lambda x: str(np.abs(np.array(x.split(","), np.float64)).max())


@backend("base64")
def _base64():
    return lambda x: base64.b64decode(x, validate=True).decode()


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` in all, or of one row that has more by itself."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + most, "right")))
        yield first, last
        first = last


def mapped(df: DataFrame, key: str, value: str, name: str, most: int = 4 << 20) -> DataFrame:
    """(key, result, error) of a backend over a column; a row that fails has its error and no result. Values of `most` bytes are worked
    on at once, whatever the rows of a batch."""
    factory, kind = _BACKENDS[name], df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("result", T.StringType()), T.StructField("error", T.StringType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = factory()
        for batch in batches:
            column = batch.column(1)
            sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else np.full(len(column), 64)
            for first, last in _runs(sizes.astype(np.int64), most):
                results, errors = [], []
                for x in column.slice(first, last - first):
                    try:
                        results.append(work(x.as_py()))
                        errors.append(None)
                    except Exception as e:
                        results.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(results, pa.string()), pa.array(errors, pa.string())], [key, "result", "error"])

    return df.select(key, value).mapInArrow(kernel, schema)


def codepoint_counts(df: DataFrame, text: str) -> DataFrame:
    """(ch, n): how often each code point occurs in a batch of texts, a row for each batch and code point."""

    def kernel(batches):
        for batch in batches:
            joined = "".join(x for x in batch.column(0).to_pylist() if x)
            points, n = np.unique(np.frombuffer(joined.encode("utf-32-le"), np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([chr(p) for p in points], pa.string()), pa.array(n, pa.int64())], ["ch", "n"])

    return df.select(text).mapInArrow(kernel, "ch string, n long")


def word_errors(reference: str, spoken: str) -> int:
    """Least number of words inserted, deleted and replaced."""
    a, b = reference.split(), spoken.split()
    row = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        swap = row[:-1] + np.array([w != x for x in b], np.int64)
        best = np.minimum(np.append(i, swap), np.append(i, row[1:] + 1))
        row = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
    return int(row[-1])


@F.pandas_udf(T.LongType())
def word_errors_udf(reference: pd.Series, spoken: pd.Series) -> pd.Series:
    return pd.Series([word_errors(a or "", b or "") for a, b in zip(reference, spoken, strict=True)], dtype="int64")


def corpus_word_error_rate(df: DataFrame, reference: str, spoken: str, group: list[str]) -> DataFrame:
    """Errors over words, pooled, and the mean of the rows' own rates."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(reference), F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    rows = df.select(*group, word_errors_udf(reference, spoken).alias("_e"), n.alias("_n"))
    return rows.groupBy(*group).agg((F.sum("_e") / F.greatest(F.sum("_n"), F.lit(1))).alias("pooled"), F.avg(F.col("_e") / F.greatest(F.col("_n"), F.lit(1))).alias("mean"))


def _word_hash(word: str) -> int:
    """SplitMix64 of the first 32 bits of sha1(word)."""
    z = (int.from_bytes(hashlib.sha1(word.encode(), usedforsecurity=False).digest()[:4], "big") + SPLITMIX_STEP) & (1 << 64) - 1
    for shift, factor in ((30, SPLITMIX_A), (27, SPLITMIX_B)):
        z = (z ^ z >> shift) * factor & (1 << 64) - 1
    return z ^ z >> 31


def word_simhashes(df: DataFrame, key: str, words: str, out: str = "sig", held: int = 200_000, most: int = 1 << 17) -> DataFrame:
    """(key, out): 64-bit SimHash of each row's array of distinct words; a bit is 1 if more words have it than not. Rows without
    words are left out.

    One pass without a shuffle: a word is hashed once in a worker (which holds up to `held` hashes) and votes as 64 bits. Votes are
    laid out for `most` words at once, whatever the rows of a batch and the words of a row.
    """
    kind = df.schema[key].dataType

    def kernel(batches):
        known: dict[str, int] = {}
        for batch in batches:
            column = batch.column(1)
            sizes, sigs = pc.list_value_length(column).to_numpy(zero_copy_only=False), []
            for first, last in _runs(sizes, most):
                flat, n = column.slice(first, last - first).flatten(), sizes[first:last]
                ones = np.zeros((len(n), 64), np.int64)
                for at in range(0, len(flat), most):  # more than one piece only for a row of more than `most` words
                    coded = flat.slice(at, most).dictionary_encode()
                    if len(known) > held:
                        known.clear()
                    hashes = np.array([known.get(w) or known.setdefault(w, _word_hash(w)) for w in coded.dictionary.to_pylist()], np.uint64)
                    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    votes = bits[coded.indices.to_numpy(zero_copy_only=False)]
                    ones += np.add.reduceat(votes, np.cumsum(n) - n if len(n) > 1 else [0], axis=0, dtype=np.int64)
                sigs.append(np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))], [key, out])

    rows = df.select(key, F.col(words).alias("_words")).where(F.size("_words") > 0)
    return rows.mapInArrow(kernel, T.StructType([T.StructField(key, kind), T.StructField(out, T.LongType())]))


@F.pandas_udf(T.StringType())
def align_form(words: pd.Series) -> pd.Series:
    """NFKC, lower case, and nothing but Latin letters and apostrophes."""
    return words.map(lambda w: None if w is None else "".join(c for c in unicodedata.normalize("NFKC", w).lower() if "a" <= c <= "z" or "À" <= c <= "ɏ" or c == "'"))


def register(spark: SparkSession) -> None:
    """Makes the kernels callable from SQL."""
    spark.udf.register("word_errors", word_errors_udf)
    spark.udf.register("align_form", align_form)
