"""SNK1 / SNK2: appends to bucketed tables."""
import re

from pyspark.sql import functions as F

from propcube.operators import changes as C
from propcube.operators import dims as D
from propcube.plans import batches as B
from propcube.session import scratch_path
from propcube.sources.stored import StoredTable
from tests.conftest import SF_SMALL

TS = "2024-02-01 00:00:00"


def _batch(tables, lo, hi):
    """Resolved rows: known and new prop_ids."""
    l = tables.listings.where(F.col("listing_id").between(lo, hi))
    return l.drop("listing_id").withColumn("prop_id", F.when(F.col("city_id") % 2 == 0, F.concat(F.lit("N-"), "prop_id"))
                                           .otherwise(F.col("prop_id"))).withColumn("source_rank", F.lit(0)) \
        .withColumn("row_id", F.xxhash64("prop_id"))


def test_two_batches_are_appended_and_a_rerun_adds_nothing(spark, tables):
    table = StoredTable.create(tables.listings, "prop_id", scratch_path(spark, "sink-listings"))
    n, top = (tables.listings.agg(F.count("*"), F.max("listing_id")).first()[i] for i in (0, 1))
    sizes = []
    for lo, hi in ((0, 500), (0, 3000), (0, 3000)):
        D.append_listings(table, _batch(tables, lo, hi), TS)
        sizes.append(table.read().count())
    new = table.read().where(F.col("prop_id").startswith("N-"))
    assert n < sizes[0] < sizes[1] == sizes[2] == n + new.count()
    ids = sorted(r[0] for r in new.select("listing_id").collect())
    assert ids == list(range(top + 1, top + 1 + len(ids)))
    assert table.read().groupBy("prop_id").count().where("count > 1").count() == 0
    old = table.read().where(~F.col("prop_id").startswith("N-")).select(tables.listings.columns)
    assert old.exceptAll(tables.listings).count() == 0


def test_the_stored_side_is_not_shuffled(spark, tables):
    table = StoredTable.create(tables.listings, "prop_id", scratch_path(spark, "sink-plan"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = _batch(tables, 0, 3000)
        plan = batch.join(table.read().select("prop_id"), "prop_id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(prop_id", plan)) == 1
    assert "Bucketed: true" in plan


def test_deals_are_appended_once(spark, tables):
    table = StoredTable.create(tables.transactions, "txn_id", scratch_path(spark, "sink-deals"))
    changes = B.txn_creates(spark, SF_SMALL)
    want, want_rejects = C.create_transactions(tables.transactions, tables.listings, changes, "X-", batch_ts=TS)
    for _ in range(2):
        rejects = C.append_transactions(table, tables.listings, changes, "X-", batch_ts=TS)
        assert rejects.count() == want_rejects.count()
    got = table.read().select(want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
