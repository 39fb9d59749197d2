"""Plain Parquet tables partitioned by a column, changed a partition at a time.

A change rewrites only the partitions that its rows fall into, by Spark's
dynamic partition overwrite; reading names the partitions wanted, so the others
are not opened. Rewriting a partition with the same rows again changes nothing,
which is what makes a repeated micro-batch harmless.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a bucket should hold, and the most buckets of a table.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 4096


def buckets_for(rows: int) -> int:
    """Number of buckets of a table: from its rows, bounded."""
    return max(1, min(MOST_BUCKETS, math.ceil(rows / BUCKET_ROWS)))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def write_partitions(df: DataFrame, path: str, by: list[str], within: tuple[str, ...] = ()) -> None:
    """Replace the partitions that ``df`` has rows for; others stay. One task
    writes a partition, or several do, by the columns ``within``."""
    (df.repartition(*by, *within).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


def read_partitions(spark: SparkSession, path: str, schema: StructType, wanted: Column | None = None) -> DataFrame:
    df = spark.read.schema(schema).parquet(path)
    return df if wanted is None else df.where(wanted)


def touched(df: DataFrame, column: str) -> list:
    """Distinct values of a partition column (a bounded number)."""
    return [r[0] for r in df.select(column).distinct().collect()]
