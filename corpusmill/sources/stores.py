"""Writers: keyed upserts that rewrite touched shards alone, packs in append mode, quarantine and delete plans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.hashing import shard_of


def merged(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with new rows over old ones; a null value of a new row wins as well."""
    n = new.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_has"))
    both = old.select(key, value).join(n, key, "full_outer")
    return both.select(key, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(value)).alias(value))


def upsert(spark, path: str, new: DataFrame, key: str = "key", value: str = "value", shards: int = 256) -> None:
    """Merges new rows into a store of Parquet folders shard=k and rewrites the shards they fall in, others stay as they are.

    The merged rows are written beside the store first, in a folder of this run alone, since a folder can't be overwritten while it
    is read. Doing it again changes nothing. Readers may see some shards new and others old while folders are put in place; put()
    and current() have no such moment.
    """
    new = new.withColumn("shard", shard_of(F.col(key), shards).cast("int"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        touched = new.select("shard").distinct()
        old = spark.read.parquet(path).join(F.broadcast(touched), "shard", "left_semi")  # shards rows at most
        rows = merged(old, new, key, value).withColumn("shard", shard_of(F.col(key), shards).cast("int"))
    else:
        rows = new.select(key, value, "shard")
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(staged)
        spark.read.parquet(staged).repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)


def _versions(spark, path: str) -> list[tuple[str, bool, list[str]]]:
    """(name, whether it is committed, its shard folders) of a store's versions, oldest first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    out = []
    for v in fs.listStatus(root):
        if v.getPath().getName().startswith("version="):
            names = [f.getPath().getName() for f in fs.listStatus(v.getPath())]
            out.append((v.getPath().getName(), "_SUCCESS" in names, [n for n in names if n.startswith("shard=")]))
    return sorted(out)


def current(spark, path: str, schema=None) -> DataFrame:
    """The rows of a versioned store: each shard as the latest committed version that holds it has it. Without one, an empty table
    of the schema."""
    latest = {shard: name for name, committed, held in _versions(spark, path) if committed for shard in held}
    if not latest:
        return spark.createDataFrame([], schema or "key string, value string")
    return spark.read.option("basePath", path).parquet(*[f"{path}/{name}/{shard}" for shard, name in sorted(latest.items())]).drop("version", "shard")


def put(new: DataFrame, path: str, key: str = "key", value: str = "value", shards: int = 256, merge: bool = True) -> None:
    """Merges new rows into a versioned store: the shards they fall in are written anew as a version of their own.

    Nothing that is there is touched, and readers take a version once Spark has put its _SUCCESS down, so a write that fails
    leaves the store as it was. A null of a new row wins as well. One writer at a time; vacuum() frees what is superseded. merge False
    writes the new rows without those that their shards had.
    """
    spark = new.sparkSession
    number = 1 + max((int(name[8:16]) for name, _, _ in _versions(spark, path)), default=0)
    placed = new.select(key, value).withColumn("shard", shard_of(F.col(key), shards).cast("int"))
    touched = placed.select("shard").distinct()
    old = current(spark, path, new.select(key, value).schema)
    old = old.withColumn("shard", shard_of(F.col(key), shards).cast("int")).join(F.broadcast(touched), "shard", "left_semi")  # shards rows at most
    rows = merged(old, placed, key, value) if merge else new.select(key, value)
    rows.withColumn("shard", shard_of(F.col(key), shards).cast("int")).repartition("shard").write.partitionBy("shard").parquet(f"{path}/version={number:08d}-{uuid.uuid4().hex[:8]}")


def vacuum(spark, path: str) -> int:
    """Deletes shard folders that a later version has, and versions that were never committed; how many folders went."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    versions, gone = _versions(spark, path), 0
    latest = {shard: name for name, committed, held in versions if committed for shard in held}
    for name, committed, held in versions:
        for shard in held if committed else [""]:
            if not committed or latest[shard] != name:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/{shard}".rstrip("/")), True)
                gone += 1
    return gone


def renamed(spark, path: str, prefix: str, to: str) -> None:
    """Moves the folders of a partitioned write to another folder, without the column's name before their own. A folder for each
    value."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = root.getFileSystem(conf)
    fs.mkdirs(target)
    for f in fs.listStatus(root):
        if f.getPath().getName().startswith(prefix):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(target, f.getPath().getName()[len(prefix) :]))


def write_keyed_json(rows: DataFrame, path: str, key: str, value: str, shards: int) -> None:
    """Writes rows as keyed JSON shards, one object of keys a file: shard=<k>/part-*.txt. Each entry is a line, so a shard of any
    size is written row by row; a shard is one file, so one task writes it. Null values are written as null."""
    entry = F.concat(F.to_json(F.array(F.col(key).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key).cast("string")))) - 2), F.lit(": "), F.coalesce(F.to_json(F.col(value)), F.lit("null")))
    placed = rows.select(shard_of(F.col(key), shards).cast("int").alias("shard"), F.col(key).cast("string").alias("_k"), entry.alias("_e"), F.lit(1).alias("_o"))
    first = placed.groupBy("shard").agg(F.min("_k").alias("_first"))  # a row a shard
    lines = placed.join(F.broadcast(first), "shard").select("shard", "_o", "_k", F.concat(F.when(F.col("_k") == F.col("_first"), F.lit("")).otherwise(F.lit(",")), "_e").alias("value"))
    ends = first.select("shard", F.explode(F.array(F.struct(F.lit(0).alias("_o"), F.lit("{").alias("value")), F.struct(F.lit(2).alias("_o"), F.lit("}").alias("value")))).alias("_x"))
    every = lines.unionByName(ends.select("shard", "_x._o", F.lit("").alias("_k"), "_x.value"))
    every.repartition("shard").sortWithinPartitions("shard", "_o", "_k").select("shard", "value").write.partitionBy("shard").text(path)


def append_shards(songs: DataFrame, name: str, frames: str, per_shard: int, first_shard: int = 0, together: int = 1) -> DataFrame:
    """songs with shard_id (from first_shard, per_shard songs each in order of name), local_idx and offset (frames before it). Songs of
    `together` neighbouring shards come to one task, in order."""
    from corpusmill.operators.windows import global_row_number

    placed = global_row_number(songs, [name], "_rn").withColumn("shard_id", (F.lit(first_shard) + F.floor((F.col("_rn") - 1) / per_shard)).cast("long"))
    dealt = placed.withColumn("_run", F.floor(F.col("shard_id") / together)).repartition("_run")
    here = Window.partitionBy("_run", "shard_id").orderBy("_rn")
    return (
        dealt.withColumn("local_idx", F.pmod(F.col("_rn") - 1, F.lit(per_shard)))
        .withColumn("offset", F.coalesce(F.sum(frames).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rn", "_run")
    )


def quarantine(previous: DataFrame, bad: DataFrame) -> DataFrame:
    """Names that could not be read, earlier and now."""
    return previous.union(bad).distinct()


def record_failures(results: DataFrame, path: str, key: str, error: str = "error", union: bool = True, shards: int = 16) -> DataFrame:
    """Writes the rows that have an error into the manifest of failed items under path and returns it as it is then: united with what
    earlier runs left, whose errors are replaced where an item fails again (union), or this run's alone in place of it."""
    spark = results.sparkSession
    failed = results.where(F.col(error).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(error).alias("value"))
    if not union and (earlier := _versions(spark, path)):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
        put(failed, path, shards=shards, merge=False)
        for name, _, _ in earlier:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    else:
        put(failed, path, shards=shards)
    return current(spark, path)


def delete_plan(rows: DataFrame, key: str, per_request: int = 1000) -> DataFrame:
    """Keys to delete with the request each goes in; nothing is deleted here."""
    from corpusmill.operators.windows import global_row_number

    return global_row_number(rows.select(key).distinct(), [key], "_rn").select(key, F.floor((F.col("_rn") - 1) / per_request).cast("long").alias("request"))


def copy_differences(source: DataFrame, copy: DataFrame, key: str = "key", size: str = "size") -> DataFrame:
    """Keys whose copy is missing or of another size."""
    c = copy.select(F.col(key), F.col(size).alias("copy_size"))
    return source.select(key, size).join(c, key, "left").where(~F.col(size).eqNullSafe(F.col("copy_size")))


def guarded_count(deletes: DataFrame, most: int = 2000) -> int:
    """Number of deletes of a plan; raises if it passes `most`."""
    n = deletes.count()
    if n > most:
        raise ValueError(f"{n} deletes planned, {most} allowed")
    return n


def cleanup_plan(present: DataFrame, index: DataFrame, key: str | None = None) -> DataFrame:
    """Files that may go: those whose key the index of what is packed holds (all of them without a key); raises while the index is
    empty. Nothing is deleted here."""
    if index.isEmpty():
        raise ValueError("the packed index is empty: nothing may be cleaned up")
    return present if key is None else present.join(index.select(key).distinct(), key, "left_semi")


def status_plan(present: DataFrame, manifest: DataFrame, key: str, bad: Column) -> DataFrame:
    """Files that are there and whose status in the manifest is bad."""
    return present.join(manifest.where(bad), key)


def copy_missing(source: DataFrame, path: str, key: str) -> DataFrame:
    """Appends to the copy under path the rows whose keys it lacks and returns it; raises if a key is missing afterwards."""
    spark = source.sparkSession
    held = spark.read.parquet(path).select(key)
    source.join(held, key, "left_anti").write.mode("append").parquet(path)
    copy = spark.read.parquet(path)
    if not source.join(copy.select(key), key, "left_anti").isEmpty():
        raise RuntimeError("the copy lacks keys of its source")
    return copy


def snapshot(counts: DataFrame, path: str, run: str) -> None:
    """Writes counts as the snapshot of a run; writing a run again replaces it."""
    counts.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def changes(snapshots: DataFrame, key: str, value: str) -> DataFrame:
    """snapshots with delta, the change of a key's value since the run before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy("run"))
    return snapshots.select("run", key, value, (F.col(value) - before).alias("delta"))
