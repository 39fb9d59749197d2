"""Stored tables bucketed by a key, appended to batch by batch.

A bucketed table of the session's catalog lies already where a join on its key
wants it: a batch is dealt to the table's buckets, and the stored rows are
neither shuffled nor sorted. An append writes the batch's files only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from propcube.session import freed_shuffles
from propcube.sources.buckets import buckets_for


class StoredTable:
    """A bucketed table by its name in the catalog."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def create(cls, df: DataFrame, key: str, path: str, name: str | None = None, buckets: int | None = None) -> StoredTable:
        """Write ``df`` as a new table at ``path`` with ``buckets`` buckets
        (default: from its rows, no fewer than the session's shuffle partitions,
        so that a join needs no other dealing)."""
        spark = df.sparkSession
        name = name or f"stored_{uuid.uuid4().hex[:12]}"
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n = buckets or max(least, buckets_for(df.count()))
        # dealt to the buckets first: one file for each, not one of each from every task
        with freed_shuffles(spark):
            (df.repartition(n, key).write.format("parquet").option("path", path).option("compression", "zstd")
             .bucketBy(n, key).sortBy(key).saveAsTable(name))
        return cls(spark, name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        with freed_shuffles(self.spark):
            rows.select(self.read().columns).write.insertInto(self.name)
