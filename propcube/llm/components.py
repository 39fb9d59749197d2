"""Connected components of an edge table by alternating large and small stars.

Every round moves each node's larger neighbours, then its smaller ones, to its
least neighbour; the number of rounds grows with the logarithm of the longest
path. Only minima are gathered by node (combined in the map tasks); a node
with very many neighbours meets them in a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propcube.llm.common import written


def _least(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b), the component being
    its least node. Null ends and loops are ignored."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("m", "u").alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = written(large, "edges")
        least = _least(large)
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        nxt = written(small, "edges")
        moved = nxt.exceptAll(now).limit(1).count() + now.exceptAll(nxt).limit(1).count()
        now = nxt
        if not moved:
            break
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).distinct()
