"""Ids that were stored once, for good: a table bucketed and sorted by the id.

A micro-batch's few ids are dealt into the same buckets and joined bucket by
bucket, so history is neither shuffled nor bound to a look-back. Generations fold
the files of many micro-batches into one per bucket.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS, FOLD_EVERY = 64, 64


class KnownIds:
    """The ids under ``root``, one row per id and micro-batch that stored it."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "string", buckets: int = BUCKETS, fold_every: int = FOLD_EVERY):
        self.spark, self.root, self.kind, self.buckets, self.fold_every = spark, root.rstrip("/"), kind, buckets, fold_every

    def _table(self, generation: int) -> str:
        """Name of a generation's table; the catalog entry is made anew where a session lacks it, the files stay."""
        name = f"known_ids_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}_{generation}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (id {self.kind}, batch BIGINT) USING parquet CLUSTERED BY (id) SORTED BY (id) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.root}/generation={generation}'")
        return name

    def before(self, batch: int) -> DataFrame:
        """(id) of what earlier micro-batches stored. A batch that is repeated does not see its own first try."""
        table = self.spark.table(self._table(batch // self.fold_every))
        return table.filter(F.col("batch") < batch).select("id")

    def add(self, ids: DataFrame, batch: int) -> None:
        """Remember the ids (column ``id``, nulls left out) of a micro-batch; a repeated batch may add them again."""
        rows = ids.filter(F.col("id").isNotNull()).select(F.col("id").cast(self.kind).alias("id"), F.lit(batch).cast("long").alias("batch"))
        rows.distinct().repartition(self.buckets, "id").write.insertInto(self._table(batch // self.fold_every))

    def fold(self, batch: int) -> None:
        """Before the first batch of a generation: all earlier ids, each once, as one sorted file per bucket."""
        generation = batch // self.fold_every
        if batch % self.fold_every or not generation:
            return
        old = self.spark.table(self._table(generation - 1)).groupBy("id").agg(F.min("batch").alias("batch"))
        old.repartition(self.buckets, "id").write.insertInto(self._table(generation), overwrite=True)

