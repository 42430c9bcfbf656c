"""Streams matched with streams: interval joins with state that is evicted, de-duplication within a watermark, late rows told.

All functions take streams and tables alike; on a table, watermarks do nothing. Times are timestamps or, without a zone, are taken
in the session's, which must be UTC then.

A row is late once its time is at or below the watermark, the greatest time of all earlier batches less the delay; Spark drops late
rows of operators with state. run() works off what has come and tells from the query's progress how many rows were dropped and how
many are held as state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


UTC = ("UTC", "Etc/UTC", "UCT", "Etc/UCT", "GMT", "Etc/GMT", "Zulu", "Z", "+00:00")


def timed(df: DataFrame, time: str, late: str) -> DataFrame:
    """df with its time as a timestamp under a watermark."""
    if dict(df.dtypes)[time] == "timestamp_ntz" and df.sparkSession.conf.get("spark.sql.session.timeZone") not in UTC:
        raise ValueError("times without a zone need a session in UTC")
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, before: str = "0 seconds", after: str = "30 minutes", late: str = "2 hours", how: str = "inner") -> DataFrame:
    """Pairs of the same key whose right time lies from `before` ahead of the left one up to `after` behind it, both included; how:
    inner, or left_outer, where a left row without a match comes out once none can come any more.

    The bounds on both times let Spark forget rows that no later row can meet, so state holds `late` and the interval, not the
    stream. Columns of both sides must have different names, the key's but once in the result.
    """
    a, b = timed(left, left_time, late), timed(right.withColumnRenamed(key, "_key"), right_time, late)
    near = (F.col(right_time) >= F.col(left_time) - F.expr(f"interval {before}")) & (F.col(right_time) <= F.col(left_time) + F.expr(f"interval {after}"))
    return a.join(b, (F.col(key) == F.col("_key")) & near, how).drop("_key")


def distinct_within(df: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key; copies are dropped as long as they come within `late` of it, as are rows that come late. On a
    table: one row of each key."""
    rows = timed(df, time, late)
    return rows.dropDuplicatesWithinWatermark(keys) if df.isStreaming else rows.dropDuplicates(keys)


@dataclass
class Run:
    batches: int
    rows: int
    dropped: int  # by watermark
    held: int  # rows of state at the end
    most: int  # of state at any time


def run(writer: DataStreamWriter) -> Run:
    """Works off all that is available, to the end."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    progress = [p for p in query.recentProgress if p["batchId"] >= 0]
    state = [[op for op in p["stateOperators"]] for p in progress]
    held = [sum(op["numRowsTotal"] for op in ops) for ops in state]
    return Run(
        sum(1 for p in progress if p["numInputRows"] > 0), sum(p["numInputRows"] for p in progress), sum(op["numRowsDroppedByWatermark"] for ops in state for op in ops),
        held[-1] if held else 0, max(held, default=0),
    )


def replay(spark: SparkSession, arrivals: DataFrame, batch: str, root: str, build, sources: int = 1) -> tuple[DataFrame, list[Run]]:
    """Lets rows arrive batch by batch (numbers in a column, which must be few) and runs a query on the stream after each one, going
    on from its checkpoint; what the query has put out, and each run's figures.

    build: from as many streams of the arrivals as sources says, to the stream that is written.
    """
    schema = arrivals.drop(batch).schema
    numbers = sorted(r[0] for r in arrivals.select(batch).distinct().collect())  # a row for each batch
    runs = []
    for n in numbers:
        arrivals.where(F.col(batch) == n).drop(batch).write.mode("append").parquet(f"{root}/in")
        streams = [spark.readStream.schema(schema).parquet(f"{root}/in") for _ in range(sources)]
        runs.append(run(build(*streams).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append")))
    return spark.read.parquet(f"{root}/out"), runs
