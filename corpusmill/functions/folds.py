"""Sequential folds as Python table functions over a partitioned and ordered table: a group of any size streams through one state.

A fold whose next value depends on what was made of the one before cannot be a window or an aggregate. As a table function it is
called from SQL after register(),

    SELECT * FROM clamp_spans(TABLE(spans) PARTITION BY song ORDER BY place)

or on a DataFrame by clamped() and the like. Rows come one by one in order, and each gives one row; nothing of a group is held
but the state, and Spark starts a new one for each partition.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

LEAST_SPAN = 0.001


def _with(table: AnalyzeArgument, **columns: T.DataType) -> AnalyzeResult:
    """The table's columns and further ones."""
    if not table.isTable:
        raise ValueError("the argument must be a table")
    return AnalyzeResult(T.StructType([*table.dataType.fields, *[T.StructField(k, v) for k, v in columns.items()]]))


class ClampSpans:
    """Rows with refined (start, end) and own (own_start, own_end) times, either of which may be null: adds a and b, made monotone.

    A refined span starts at or after the end of the one before and lasts LEAST_SPAN or more. A row without one keeps its own span,
    whose end moves the next start as well; a row without either has none and moves nothing.
    """

    def __init__(self):
        self.cursor = 0.0

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _with(table, a=T.DoubleType(), b=T.DoubleType())

    def eval(self, row):
        a, b = row["own_start"], row["own_end"]
        if row["start"] is not None and row["end"] is not None:
            a = max(row["start"], self.cursor)
            b = max(row["end"], a + LEAST_SPAN)
            self.cursor = b
        elif a is not None and b is not None:
            self.cursor = max(self.cursor, b)
        else:
            a = b = None
        yield *row, a, b


class Debounce:
    """Rows with a time (at) and a label: adds run, the number of the run a row is in.

    A label that differs from the run's opens a new one only once it has come `hold` times in a row or has lasted `wait`; until then
    its rows belong to the run before. hold and wait are columns, alike in a partition.
    """

    def __init__(self):
        self.run, self.label, self.other, self.since, self.times = 0, None, None, -math.inf, 0

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _with(table, run=T.LongType())

    def eval(self, row):
        label = row["label"]
        if self.run == 0:
            self.run, self.label = 1, label
        elif label == self.label:
            self.times = 0
        else:
            if self.times == 0 or label != self.other:
                self.other, self.since, self.times = label, row["at"], 0
            self.times += 1
            if self.times >= row["hold"] or row["at"] - self.since >= row["wait"]:
                self.run, self.label, self.times = self.run + 1, label, 0
        yield *row, self.run


FOLDS = {"clamp_spans": ClampSpans, "debounce": Debounce}


def register(spark: SparkSession) -> None:
    """Makes the folds callable from SQL."""
    for name, fold in FOLDS.items():
        spark.udtf.register(name, F.udtf(fold))


def folded(df: DataFrame, name: str, group: list[str], order: list[str]) -> DataFrame:
    """df through a fold, group by group in the order."""
    return F.udtf(FOLDS[name])(df.asTable().partitionBy(*group).orderBy(*order))


def clamped(spans: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    return folded(spans, "clamp_spans", group, order)
