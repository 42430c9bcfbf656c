"""Sharding: contiguous shards of near-equal bytes from global prefix sums.

Rows are put in a global order, dealt into ranges of it, and each range is totalled; running sums of those totals give each
range its byte offset, so every row knows how many bytes stand before it without any task seeing all rows. A row goes to the
shard in which its middle byte falls when all bytes are cut at equal targets, which keeps shards contiguous and within one
row's size of the target. Sizes and order columns alone are shuffled; texts move only in write_shards.

Null text counts as no bytes (each row still has a size of 1), a null id sorts first, equal ids are told apart by size and
checksum, and rows equal in all of these are interchangeable. A text of any length is one row in one shard. An empty table gives
an empty result. Only id_col and text_col are read; write_shards keeps all columns of docs and refuses one called shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm._order import global_prefix
from corpusmill.llm._scratch import cut, fresh

LAW = "bytes"


def text_bytes(text: str = "text"):
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def text_crc(text: str = "text"):
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def assign_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard (0 to n_shards - 1), slot (gapless from 0 in each shard), and the
    global rank and first byte. Shards are contiguous in the order (id, size, text_crc32)."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    sizes = cut(
        docs.select(
            F.col(id_col).alias(id_col),
            (text_bytes(text_col) + 1).alias("size"),
            text_crc(text_col).alias("text_crc32"),
        ),
        "sizes",
    )
    placed, _, total = global_prefix(sizes, [id_col, "size", "text_crc32"], "size")
    # The middle byte in half bytes, so that all arithmetic is on integers; decimals because bytes x shards may pass 2**63.
    middle = f"(cast(before as decimal(28,0)) * 2 + size) * {n_shards}"
    shard = F.expr(f"cast(least({middle} div cast('{2 * max(total, 1)}' as decimal(38,0)), {n_shards - 1}) as int)")
    placed = cut(placed.withColumn("shard", shard), "placed")
    counts = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))  # n_shards rows at most
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "shard")
        .select(id_col, "size", "text_crc32", "shard", (F.col("rank") - F.col("_start")).alias("slot"), "rank", F.col("before").alias("first_byte"))
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all columns of docs as Parquet, one folder `shard=k` a shard, rows of a shard in order over its files.

    Rows find their place by id, size and checksum, nulls included. Rows equal in all three go where the first of them is, so
    that none is written twice. Each shard is cut into ranges of the order, so that no task holds a whole shard.
    """
    if "shard" in [c.lower() for c in docs.columns]:
        raise ValueError("a column of docs is called shard")
    keys = [fresh(docs.columns, f"_{k}") for k in ("id", "size", "crc")]
    rank, shard = fresh(docs.columns, "_rank"), "shard"
    at = (
        assign_shards(docs, n_shards, id_col, text_col)
        .groupBy(F.col(id_col).alias(keys[0]), F.col("size").alias(keys[1]), F.col("text_crc32").alias(keys[2])).agg(F.min("rank").alias(rank), F.min("shard").alias(shard))
    )
    match = F.col(id_col).eqNullSafe(F.col(keys[0])) & (text_bytes(text_col) + 1 == F.col(keys[1])) & (text_crc(text_col) == F.col(keys[2]))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs.join(at, match).repartitionByRange(max(n, n_shards), rank).sortWithinPartitions(rank).drop(*keys, rank).write.partitionBy(shard).parquet(path)
