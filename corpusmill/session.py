"""A local session for tests and trials."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 4, partitions: int = 4) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("corpusmill").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
