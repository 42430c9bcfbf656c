"""Positional operators: global numbering, packing, keepers, prefixes under a cap, nucleus and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.scratch import written


def _ranged(df: DataFrame, order: list[str] | list[Column]) -> DataFrame:
    """df dealt into ranges of the order, _part their number from low to high; written, so that it stays as dealt."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def global_row_number(df: DataFrame, order: list[str] | list[Column], out: str) -> DataFrame:
    """Adds a row number over the whole table without sorting it in one task.

    Rows are dealt into ranges of all order columns, so that neither a common beginning nor a frequent value of the first one
    gathers them in one task; each range is counted, and rows are numbered within their range plus the rows of earlier ones.
    """
    ranged = _ranged(df, order)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_local")).drop("_part", "_before", "_local")


def handed_on(df: DataFrame, key: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Adds out: the last value that is not null among the earlier rows of the same key in the order.

    Rows are dealt into ranges of key and order, so that a key of any size is spread over tasks. What a range's last key has
    last (a row for each range) is handed to the next range; a range without a value of that key hands on what it got.
    """
    whole = [*[F.col(k).asc_nulls_first() for k in key], *order]
    own = F.struct(F.lit(0).alias("_0"), *key)
    ranged = _ranged(df, whole).withColumn("_pos", F.row_number().over(Window.partitionBy("_part").orderBy(*whole)))
    ends = ranged.groupBy("_part").agg(
        F.max_by(own, "_pos").alias("_key"), F.max_by(F.struct(own.alias("k"), F.col(value).alias("v")), F.when(F.col(value).isNotNull(), F.col("_pos"))).alias("_last")
    )
    held = F.when(F.col("_last.k").eqNullSafe(F.col("_key")), F.col("_last.v"))
    carried = ends.select(
        F.lead("_part").over(Window.orderBy("_part")).alias("_to"), F.col("_key").alias("_of"),  # one row a range
        F.last(held, ignorenulls=True).over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)).alias("_carry"),
    ).where("_to is not null and _carry is not null")
    here = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumn("_here", F.last(value, ignorenulls=True).over(here))
    joined = found.join(F.broadcast(carried), (F.col("_part") == F.col("_to")) & own.eqNullSafe(F.col("_of")), "left")
    return joined.withColumn(out, F.coalesce("_here", "_carry")).drop("_part", "_pos", "_here", "_to", "_of", "_carry")


def grouped_row_number(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds the row number (from 1) within each group, by a numbering of the whole table: a group of any size is spread over tasks."""
    numbered = global_row_number(df, [*group, *order], "_rn")
    first = numbered.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.min("_rn").alias("_first"))
    match = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    return numbered.join(first, match).withColumn(out, F.col("_rn") - F.col("_first") + 1).drop("_rn", "_first", *[f"_g_{g}" for g in group])


def contiguous_shards(df: DataFrame, order: list[str], value: str, per_shard: int) -> DataFrame:
    """shard, local_idx and offset: rows in order, per_shard to a shard, with the values of the shard's earlier rows summed."""
    out = global_row_number(df, order, "_rn").withColumn("shard", F.floor((F.col("_rn") - 1) / per_shard).cast("long")).withColumn("local_idx", F.pmod(F.col("_rn") - 1, F.lit(per_shard)))
    here = Window.partitionBy("shard").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum(value).over(here), F.lit(0))).drop("_rn")


def running_sum(df: DataFrame, order: list[str] | list[Column], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over all earlier rows of the table, range by range of the order. order must be unique."""
    ranged = _ranged(df, order)
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))  # one row a range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(here), F.lit(0))).drop("_part", "_before")


def decayed_mean(df: DataFrame, group: str, order: list[str], value: str, keep: float, out: str) -> DataFrame:
    """(group, out): exponential moving average, keep * average + (1 - keep) * value, from the first value on; null if a value is.

    Rows are dealt into ranges of group and order, whatever a group's size. Each range of a group gives its decayed sum and
    number of rows; a group's ranges (as many as partitions at most) are then combined, each decayed by the rows after it.
    """
    ranged = _ranged(df.select(group, *order, value), [group, *order])
    newer = F.row_number().over(Window.partitionBy("_part", group).orderBy(*[F.col(c).desc() for c in order])) - 1
    pieces = ranged.withColumn("_newer", newer).groupBy("_part", group).agg(
        F.sum(F.col(value) * F.pow(F.lit(keep), F.col("_newer"))).alias("_sum"), F.max_by(value, "_newer").alias("_first"),
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_known"),
    )
    later = Window.partitionBy(group).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    summed = placed.groupBy(group).agg(
        F.sum(F.col("_sum") * F.pow(F.lit(keep), F.col("_after"))).alias("_sum"), F.min_by("_first", "_part").alias("_first"),
        F.sum("_n").alias("_n"), F.sum("_known").alias("_known"),
    )
    total = (1 - keep) * F.col("_sum") + keep * F.pow(F.lit(keep), F.col("_n") - 1) * F.col("_first")
    return summed.select(group, F.when(F.col("_n") == F.col("_known"), total).alias(out))


def keeper(df: DataFrame, group: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Rank of each row in its group; the keeper has 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def capped_prefix(df: DataFrame, group: list[str], order: str, cost: Column, cap: int, header: int = 0) -> DataFrame:
    """Rows up to the first one whose running cost (with the header's) passes cap; costs are 0 or more. Adds used."""
    here = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.lit(header) + F.sum(cost).over(here)).where(F.col("used") <= cap)


def nucleus(df: DataFrame, group: list[str], weight: str, tie: str, top_p: float) -> DataFrame:
    """Rows by falling share until the shares before a row reach top_p; the one that crosses it stays. Adds share, before."""
    every = Window.partitionBy(*group)
    order = every.orderBy(F.col(weight).desc(), tie).rowsBetween(Window.unboundedPreceding, -1)
    shared = df.withColumn("share", F.col(weight) / F.sum(weight).over(every))
    return shared.withColumn("before", F.coalesce(F.sum("share").over(order), F.lit(0.0))).where(F.col("before") <= top_p)


def top_k_with_ties(df: DataFrame, group: list[str], by: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*group).orderBy(F.col(by).desc()))).where(F.col("rank") <= k)


def strided(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Every (n div k)-th row in order, k at most."""
    n = df.count()
    step = max(1, n // k)
    numbered = global_row_number(df, order, "_rn")
    return numbered.where((F.pmod(F.col("_rn") - 1, F.lit(step)) == 0) & (F.col("_rn") <= step * k)).drop("_rn")


def repeat_rate(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Per group: rows that have one before them, and how many of those repeat its value."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_before", before).where("_before is not null").groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_before") == F.col(value)).cast("long")).alias("repeats"))


def rank_partition(df: DataFrame, order: list[str], ways: int) -> DataFrame:
    """Deals rows i, i + ways, ... to worker i and drops the incomplete last round. Adds worker and step."""
    n = df.count() // ways * ways
    numbered = global_row_number(df, order, "_rn").where(F.col("_rn") <= n)
    return numbered.withColumn("worker", F.pmod(F.col("_rn") - 1, F.lit(ways))).withColumn("step", F.floor((F.col("_rn") - 1) / ways)).drop("_rn")
