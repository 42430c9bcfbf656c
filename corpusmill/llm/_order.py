"""Positions and running sums over a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm._scratch import cut


def global_prefix(df: DataFrame, order: list[str], value: str, partitions: int | None = None) -> tuple[DataFrame, int, int]:
    """Adds `rank` (from 0) and `before` (sum of value over all earlier rows) in the order of the given columns.

    df is dealt into ranges of the order and written; each range is totalled; the totals' running sums (one row a range) give
    each range its offsets; the rows of a range are then numbered by themselves. Ties in all order columns may swap places,
    which only swaps equal rows if the order has every column that matters. Also returns the row count and the sum.
    df must be small columns only: it is shuffled twice. partitions: ranges, as many as shuffle partitions by default.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = sorted(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v")).collect(), key=lambda r: r["_part"])
    offsets, rows, total = [], 0, 0
    for r in totals:  # one row for each range
        offsets.append((r["_part"], rows, total))
        rows, total = rows + r["n"], total + (r["v"] or 0)
    at = F.broadcast(spark.createDataFrame(offsets or [(0, 0, 0)], "_part int, _rows long, _sum long"))
    here = Window.partitionBy("_part").orderBy(*order)
    out = (
        ranged.join(at, "_part")
        .withColumn("rank", F.col("_rows") + F.row_number().over(here) - 1)
        .withColumn("before", F.col("_sum") + F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    )
    return out.drop("_part", "_rows", "_sum"), rows, total


def grouped_before(df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the earlier rows of the same group.

    bucket must never fall as the order rises; a group of any size is then summed bucket by bucket, with the buckets' totals
    (group x buckets rows) giving each its offset. Rows of one group and bucket meet in one task, so choose bounded buckets.
    """
    with_bucket = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        with_bucket.groupBy(*group, "_bucket").agg(F.sum(value).alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    )
    keys = [*group, "_bucket"]
    renamed = offsets.select(*[F.col(k).alias(f"_o_{k}") for k in keys], "_offset")
    match = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    joined = with_bucket.join(renamed, match).drop(*[f"_o_{k}" for k in keys])
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_offset") + F.sum(value).over(here) - F.col(value)).drop("_offset", "_bucket")


def following(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds out: value of the next row of the same group in the order, null for the last one.

    Rows are dealt into ranges of group and order, so that a group of any size is spread over tasks; the first row of each
    range (one row a range) is handed to the last row of the one before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("_part").orderBy(*group, *order)
    entry = F.struct(*[F.col(g).alias(f"g{k}") for k, g in enumerate(group)], F.col(value).alias("v"))
    first = ranged.withColumn("_n", F.row_number().over(here)).where("_n = 1").select("_part", entry.alias("_e"))
    handed = first.select(F.col("_part").alias("_p"), F.lead("_e").over(Window.orderBy("_part")).alias("_handed"))  # one row a range
    led = ranged.withColumn("_next", F.lead(entry).over(here)).join(F.broadcast(handed), F.col("_part") == F.col("_p"))
    led = led.withColumn("_next", F.coalesce("_next", "_handed"))
    same = F.col("_next").isNotNull()
    for k, g in enumerate(group):
        same = same & F.col(f"_next.g{k}").eqNullSafe(F.col(g))
    return led.withColumn(out, F.when(same, F.col("_next.v"))).drop("_part", "_p", "_next", "_handed")
