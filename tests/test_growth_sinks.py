"""What a bucketed table and the batches appended to it write."""
import os

from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.operators import changes as C
from propcube.session import scratch_path, storage_root
from propcube.sources.stored import StoredTable

TS = "2024-02-01 00:00:00"


def test_a_sink_has_one_file_for_each_bucket(spark):
    rows = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("t"), "id").alias("k"), "id")
    table = StoredTable.create(rows, "k", scratch_path(spark, "sink-files"), buckets=6)
    assert len(table.read().inputFiles()) <= 6
    assert table.read().count() == 4000


def _deals(spark, ids):
    table = spark.createDataFrame([(i, 1) for i in ids], "txn_id string, listing_id long")
    for f in S.TRANSACTIONS.fields[2:]:
        table = table.withColumn(f.name, F.lit(None).cast(f.dataType))
    return table


def _batch(spark):
    rows = [("d", 1, 5.0, "b4", None), ("a", 2, 6.0, "b1", "Pending"), ("b", 3, 0.0, "no price", None),
            ("c", 2, 7.0, "b3", "Refunded"), ("e", 9, 8.0, "no listing", None), ("f", None, 8.0, "no id", None),
            ("g", 1, 9.0, "b7", "Cancelled")]
    return spark.createDataFrame(rows, "seq string, listing_id long, price double, buyer_name string, status string").select(
        "seq", "listing_id", F.col("price").cast(S.MONEY).alias("sale_price"),
        F.lit("2024-01-02").cast("date").alias("transaction_date"), "buyer_name", "status")


WANT = [("X-1", 2, "b1", "Pending"), ("X-2", 1, "b4", "Completed"), ("X-3", 1, "b7", "Cancelled")]


def _found(table):
    return sorted(map(tuple, table.read().where("created_at IS NOT NULL").select("txn_id", "listing_id", "buyer_name", "status").collect()))


def _scratch(spark):
    return {f for f in os.listdir(storage_root(spark).removeprefix("file:")) if f.startswith("ids-")}


def test_a_batch_leaves_neither_scratch_files_nor_shuffles(spark):
    listings = spark.createDataFrame([(1,), (2,), (None,)], "listing_id long")
    table = StoredTable.create(_deals(spark, ["T1", None]), "txn_id", scratch_path(spark, "sink-left"), buckets=3)
    before = _scratch(spark)
    for _ in range(2):
        rejects = C.append_transactions(table, listings, _batch(spark), "X-", batch_ts=TS)
        assert _found(table) == WANT
        assert _scratch(spark) == before
    assert sorted((r.seq, r.reasons) for r in rejects.collect()) == [
        ("b", ["listing_unknown", "sale_price_required"]), ("c", ["status_domain"]),
        ("e", ["listing_unknown"]), ("f", ["listing_unknown"])]


def test_a_batch_that_is_stored_in_part_is_completed(spark):
    listings = spark.createDataFrame([(1,), (2,)], "listing_id long")
    for held in (["X-2", "X-2", "X-03", "X-", "X-4", "X-99999999999999999999", "X-1x"], ["X-1", "X-3", "Y-2"]):
        table = StoredTable.create(_deals(spark, held), "txn_id", scratch_path(spark, "sink-part"), buckets=2)
        C.append_transactions(table, listings, _batch(spark), "X-", batch_ts=TS)
        assert _found(table) == [w for w in WANT if w[0] not in held]


def test_a_batch_that_is_stored_is_not_numbered_again(spark, monkeypatch):
    listings = spark.createDataFrame([(1,), (2,), (2,), (None,)], "listing_id long")  # 2 is there twice: b1 counts twice
    table = StoredTable.create(_deals(spark, ["X-3", "X-1", "X-2", "X-4", "X-7"]), "txn_id", scratch_path(spark, "sink-again"), buckets=2)
    monkeypatch.setattr(C, "assign_ids", None)
    C.append_transactions(table, listings, _batch(spark), "X-", batch_ts=TS)
    assert _found(table) == [] and table.read().count() == 5


def test_deals_are_dealt_to_the_listings_without_what_a_field_rule_rejects(spark):
    listings = spark.createDataFrame([(1,), (2,), (2,)], "listing_id long")
    valid, _ = C.check_transactions(listings, _batch(spark).withColumn("extra", F.lit("x")))
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    outer = plan[plan.index("LeftOuter"):]
    # the rows that go into the join have passed the field rules and hold nothing else
    assert "extra" not in plan and "sale_price_required" in outer and "status_domain" in outer
    # a listing that is there twice counts twice, as ever
    assert sorted(r._seq for r in valid.collect()) == ["a", "a", "d", "g"]
