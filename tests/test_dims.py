"""Dense ids over many partitions."""
from pyspark.sql import functions as F

from propcube.operators import dims as D


def test_ids_are_dense_distinct_and_ordered_over_many_partitions(spark):
    n = 1_000_000
    rows = spark.range(n, numPartitions=16).select(
        F.hash("id").alias("k"), F.col("id").alias("row"), F.repeat(F.lit("x"), 40).alias("pad"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for coalesce in ("true", "false"):
            spark.conf.set("spark.sql.shuffle.partitions", "32")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            got = D.assign_ids(rows, "new_id", 7, ["k", "row"])
            a = got.agg(F.count("*").alias("n"), F.countDistinct("new_id").alias("d"), F.min("new_id").alias("lo"),
                        F.max("new_id").alias("hi"), F.countDistinct("row").alias("r")).first()
            assert (a.n, a.d, a.lo, a.hi, a.r) == (n, n, 8, n + 7, n)
            # in order: ids and keys rise together in samples of neighbours
            pairs = got.where("new_id % 1000 IN (0, 1)").select("new_id", "k", "row").orderBy("new_id").collect()
            assert [(p.k, p.row) for p in pairs] == sorted((p.k, p.row) for p in pairs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ids_of_an_empty_frame(spark):
    assert D.assign_ids(spark.range(0).withColumnRenamed("id", "k"), "new_id", 0, ["k"]).count() == 0
