"""Tables written to the folder that every executor shares, and deleted once nothing reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []  # scratch folders of this process that have not been dropped


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a local master (tests, one machine) gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """The path of a new folder."""
    return f"{shared_root(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes df and reads it again: lineage ends there and nothing is computed twice."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    _made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once what was made from them has been written itself."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            drop_path(t.sparkSession, path)


def mark() -> int:
    """Number of scratch tables there are."""
    return len(_made)


def drop_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Deletes the scratch tables made since there were mark of them, but for those of keep."""
    held = {getattr(k, "_scratch", None) for k in keep}
    for path in [p for p in _made[mark:] if p not in held]:
        drop_path(spark, path)


def settled(df: DataFrame, since: int, label: str = "table") -> DataFrame:
    """df written, with all scratch tables made since there were so many deleted: it alone is left to read."""
    out = written(df, label)
    drop_since(df.sparkSession, since, out)
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system of that path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _made:
        _made.remove(path)
