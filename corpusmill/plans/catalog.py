"""Registry of named queries: the operators applied to tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources.tables import table


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


@dataclass(frozen=True)
class Query:
    name: str
    ops: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


CATALOG: dict[str, Query] = {}


def query(ops: str, sql: str | None = None):
    """Registers a function of Tables under its name, with the operators it covers (their inventory ids)."""

    def add(build: Callable[[Tables], DataFrame]):
        CATALOG[build.__name__] = Query(build.__name__, tuple(ops.split()), build, sql)
        return build

    return add
