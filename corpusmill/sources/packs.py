"""Packs: songs in contiguous shards with running offsets, written, appended to and read back.

A pack is a Parquet table in which shard_id is a column: neighbouring shards lie together in one file, each shard in one piece and in
order, so the number of files follows the tasks of a write, not the shards, and a filter on shard_id skips by the files' statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.stores import append_shards

FORMAT_VERSION = 2
#: Songs of neighbouring shards that lie together, unless one shard has more.
TOGETHER = 32_000


def int16(codes: Column) -> Column:
    """Codes [K][T] as 16-bit integers; a value that does not fit raises."""
    return codes.cast("array<array<smallint>>")


def write_pack(songs: DataFrame, path: str, per_shard: int, name: str = "name", codes: str = "codes", append: bool = False) -> None:
    """Writes songs (name, codes [K][T] and sidecar columns) in order of name, per_shard to a shard, with local_idx and offset.

    append: shards are numbered on from the greatest one there, which stay as they are; a pack with other columns is refused.
    """
    spark, first = songs.sparkSession, 0
    if append:
        old = spark.read.parquet(path)
        if set(old.columns) - {"shard_id", "local_idx", "offset", "n_frames"} != set(songs.columns):
            raise ValueError("the pack has other columns than the songs that are appended")
        last = old.agg(F.max("shard_id")).first()[0]
        first = 0 if last is None else last + 1
    rows = songs.withColumn(codes, int16(F.col(codes))).withColumn("n_frames", F.coalesce(F.size(F.try_element_at(codes, F.lit(1))), F.lit(0)))
    placed = append_shards(rows, name, "n_frames", per_shard, first, max(1, TOGETHER // per_shard))
    placed.write.mode("append" if append else "errorifexists").parquet(path)


def read_pack(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Songs of a pack."""
    songs = spark.read.parquet(path)
    return songs if names is None else songs.where(F.col("name").isin(names))


def pack_index(songs: DataFrame, name: str = "name") -> DataFrame:
    """One row a shard: format_version, shard_id, names, offsets (one more), total_T and n_songs. A shard has a bounded number of songs."""
    rows = F.array_sort(F.collect_list(F.struct("local_idx", F.col(name).alias("name"), "offset", "n_frames")))
    shards = songs.groupBy("shard_id").agg(rows.alias("s"))
    last = F.element_at("s", -1)
    total = (last["offset"] + last["n_frames"]).cast("long")
    return shards.select(
        F.lit(FORMAT_VERSION).alias("format_version"), "shard_id", F.col("s.name").alias("names"), F.concat(F.col("s.offset").cast("array<bigint>"), F.array(total)).alias("offsets"),
        total.alias("total_T"), F.size("s").alias("n_songs"),
    )


def or_zeros(xs: Column, n: int) -> tuple[Column, Column]:
    """A sidecar's values and whether they are there: an array that is missing or has another length is n zeros."""
    good = F.coalesce(F.size(xs) == n, F.lit(False)) & xs.isNotNull()
    return F.when(good, xs.cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), n)), good


def required(songs: DataFrame, flag: str) -> DataFrame:
    """songs, failing where none of them has a stream that is needed."""
    return songs.where(F.when(F.max(flag).over(Window.partitionBy("shard_id")), F.lit(True)).otherwise(F.raise_error(F.lit(f"{flag} is false in a whole shard")).isNull()))


def move_plan(members: DataFrame, folder: str, name: str, target: int, overflow: str) -> DataFrame:
    """(src, dst, name, i): the i-th row beyond `target` of its folder, in order of the folder's number and name, goes to the
    folder whose free places, counted on from folder to folder, hold i, or to overflow once none is left.

    A row finds its folder as the last one whose free places begin at or before i.
    """
    from corpusmill.operators.joins import allocate_spill, as_of, folder_number
    from corpusmill.operators.windows import global_row_number, grouped_row_number

    sizes = members.groupBy(folder).agg(F.count(F.lit(1)).alias("_n"))
    numbered = grouped_row_number(members.select(folder, name), [folder], [name], "_rn")
    spilled = numbered.where(F.col("_rn") > target).select(folder, name, folder_number(F.col(folder)).alias("_w"))
    pool = global_row_number(spilled, [F.col("_w").asc_nulls_last(), F.col(folder).asc_nulls_last(), F.col(name)], "_i").select(folder, name, (F.col("_i") - 1).alias("i"))
    _, free = allocate_spill(sizes.where(F.col(folder) != overflow), folder, "_n", target)
    held = as_of(pool, free.select(F.col(folder).alias("_to"), "lo", "hi"), [], "i", "lo", ["_to", "hi"])
    dst = F.when(F.col("i") < F.col("hi"), F.col("_to")).otherwise(F.lit(overflow))
    return held.select(F.col(folder).alias("src"), dst.alias("dst"), F.col(name).alias("name"), "i")


def collisions(moves: DataFrame, members: DataFrame, folder: str, name: str) -> DataFrame:
    """(dst, name, problem): moves whose name is in the folder they go to already, or that another move takes there too."""
    there = members.select(F.col(folder).alias("dst"), F.col(name).alias("name")).distinct()
    exists = moves.select("dst", "name").join(there, ["dst", "name"], "left_semi").distinct().withColumn("problem", F.lit("exists"))
    twice = moves.groupBy("dst", "name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("dst", "name", F.lit("repeated").alias("problem"))
    return exists.union(twice)


def wave_moves(objects: DataFrame, key: str, size: int, prefix: str = "waves/wave_") -> DataFrame:
    """(base, wave, status, source, n_copies): where each file belongs, by the name that its key ends in. Names in order fill waves of
    size; a name is already placed if one of its copies lies in its wave, else its first key moves there, from flat or from another
    folder. Other copies are left where they are."""
    from corpusmill.operators.windows import global_row_number

    named = objects.select(F.col(key).alias("_key"), F.element_at(F.split(key, "/"), -1).alias("base"))
    bases = global_row_number(named.select("base").distinct(), ["base"], "_rn").select("base", F.floor((F.col("_rn") - 1) / size).cast("long").alias("wave"))
    target = F.concat(F.lit(prefix), F.col("wave").cast("string"), F.lit("/"), F.col("base"))
    placed = named.join(bases, "base").groupBy("base", "wave").agg(F.min("_key").alias("source"), F.max(F.col("_key") == target).alias("_there"), F.count(F.lit(1)).alias("n_copies"))
    status = F.when(F.col("_there"), "already").when(F.contains("source", F.lit("/")), "from folder").otherwise("from flat")
    return placed.select("base", "wave", status.alias("status"), "source", "n_copies")
