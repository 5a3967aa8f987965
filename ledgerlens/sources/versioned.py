"""Publish a rewritten table without overwriting what the job reads.

Each publication is a new folder ``v=N``; readers take the highest complete one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        done = hadoop.Path(status.getPath(), "_SUCCESS")
        if re.fullmatch(r"v=\d+", name) and fs.exists(done):
            found.append(int(name[2:]))
    return sorted(found)


def publish(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write ``df`` as the next version and return its number."""
    known = versions(df.sparkSession, root)
    number = known[-1] + 1 if known else 1
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{root}/v={number}")
    return number


def current(spark: SparkSession, root: str) -> DataFrame:
    """The latest published version."""
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"no published version under {root}")
    return spark.read.parquet(f"{root}/v={known[-1]}")
