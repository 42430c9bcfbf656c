"""Tables written to the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []  # scratch folders of this process that have not been dropped


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a local master (tests, one machine) gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
            current = spark.sparkContext.getCheckpointDir()
        root = current
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there and nothing is computed twice."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    _made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once what was made from them has been written itself."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            drop_path(t.sparkSession, path)


def drop_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Deletes the scratch tables made since there were mark of them, but for keep."""
    for path in [p for p in _made[mark:] if p != getattr(keep, "_scratch", None)]:
        drop_path(spark, path)


def mark() -> int:
    """Number of scratch tables there are."""
    return len(_made)


def fresh(columns: list[str], name: str) -> str:
    """name, or name with underscores before it until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system of that path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _made:
        _made.remove(path)
