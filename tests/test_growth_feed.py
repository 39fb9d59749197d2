"""A backlog of many files costs a few batches."""
from pyspark.sql import functions as F

from propcube.session import scratch_path
from propcube.streaming import changefeed as CF

TS = "2024-06-01 00:00:00"


def test_a_backlog_of_many_files_is_drained_in_few_batches(spark, tables):
    root = scratch_path(spark, "feed-growth")
    few = tables.listings.where("listing_id < 90")
    changes = few.select(F.lit("update").alias("op"), (F.col("listing_id") * 10).alias("seq"), F.array(F.lit("price_inr")).alias("set_cols"),
                         "listing_id", (F.col("price_inr") + 1).cast("decimal(18,2)").alias("price_inr"))
    changes.repartitionByRange(9, "seq").write.parquet(f"{root}/in")
    CF.init_state(few, f"{root}/state")
    CF.run_change_feed(spark, f"{root}/in", f"{root}/state", f"{root}/ck", tables.cities, tables.localities, TS)
    state = CF.State(spark, f"{root}/state")
    assert 1 < state.written("images", CF.IMAGES).select("batch").distinct().count() <= CF.MOST_BATCHES
    got = CF.read_state(spark, f"{root}/state").select("listing_id", "price_inr")
    assert sorted(got.collect()) == sorted(changes.select("listing_id", "price_inr").collect())
    assert CF.files_per_trigger(3, 2) == 2 and CF.files_per_trigger(432, 1) * CF.MOST_BATCHES == 432
