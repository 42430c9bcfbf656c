"""Incremental ingestion: bounded waves of new files through ordered stages, with resumable status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.sources import stores

Stage = tuple[str, Callable[[SparkSession, DataFrame], DataFrame]]


def ingest_available(spark: SparkSession, folder: str, schema: T.StructType, checkpoint: str, on_batch: Callable[[DataFrame, int], None], files_per_batch: int = 1000, form: str = "parquet") -> int:
    """Hands the files that came since the last call to on_batch, files_per_batch at a time; returns the batches made.

    The checkpoint remembers what has been read. A batch that fails is handed over again next time, with the same number, so
    on_batch must be idempotent (a keyed upsert is).
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(folder)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(on_batch).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return sum(1 for p in query.recentProgress if p["numInputRows"] > 0)


def ingest_upserts(spark: SparkSession, folder: str, schema: T.StructType, checkpoint: str, store: str, key: str = "key", value: str = "value", shards: int = 256) -> int:
    """New files as keyed upserts into a sharded store; within a batch the row with the greatest value order wins a key."""

    def on_batch(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy(key).agg(F.max(F.struct(value)).alias("_v")).select(key, F.col(f"_v.{value}").alias(value))
        if not latest.isEmpty():
            stores.upsert(batch.sparkSession, store, latest, key, value, shards)

    return ingest_available(spark, folder, schema, checkpoint, on_batch)


class StageStatus:
    """A table (wave, stage, status) in a Parquet folder; the last status of a pair holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def done(self, wave: str) -> set[str]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return set()
        rows = self.spark.read.parquet(self.path).where((F.col("wave") == wave) & (F.col("status") == "done"))
        return {r["stage"] for r in rows.select("stage").distinct().collect()}  # one row for each stage

    def mark(self, wave: str, stage: str, status: str = "done") -> None:
        self.spark.createDataFrame([(wave, stage, status)], "wave string, stage string, status string").coalesce(1).write.mode("append").parquet(self.path)


def run_wave(spark: SparkSession, wave: str, inventory: DataFrame, stages: list[Stage], status: StageStatus) -> list[str]:
    """Runs the stages of a wave that are not done, in order, each marked done as it ends; returns those that ran."""
    done, ran = status.done(wave), []
    for name, stage in stages:
        if name not in done:
            stage(spark, inventory)
            status.mark(wave, name)
            ran.append(name)
    return ran


def run_waves(spark: SparkSession, waves: dict[str, DataFrame], stages: list[Stage], status: StageStatus, most_failures: int = 2) -> dict[str, list[str]]:
    """Waves one after the other; complete ones are skipped, and most_failures failures in a row end the run."""
    out, failures = {}, 0
    for wave, inventory in waves.items():
        try:
            out[wave] = run_wave(spark, wave, inventory, stages, status)
            failures = 0
        except Exception:
            failures += 1
            if failures >= most_failures:
                raise
    return out


def sweep(pending: Callable[[], DataFrame], work: Callable[[DataFrame], None], chunk: int = 3000, order: str = "key") -> int:
    """Works off what is pending, chunk rows at a time, until none is left or a round doesn't lower its number; rows left."""
    before = None
    while True:
        rows = pending()
        n = rows.count()
        if n == 0 or before is not None and n >= before:
            return n
        work(rows.orderBy(order).limit(chunk))
        before = n
