"""Deals that are looked up are dealt by id once."""
import re

from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.operators import search as Q
from propcube.session import REQUIRED_CONF


def test_deals_that_are_looked_up_are_dealt_by_id_once(spark, tables):
    deals = tables.transactions.where("listing_id < 60")
    twice = tables.with_tables(transactions=deals.unionByName(deals.limit(3)))
    keys = deals.select("txn_id").unionByName(spark.sql("SELECT 'none' AS txn_id UNION ALL SELECT 'none' UNION ALL SELECT null"))
    got = Q.lookup_transactions(twice, keys)
    assert got.where("found").count() == deals.count() + 3
    assert [(r.requested_key, r.txn_id, r.city_name) for r in got.where("NOT found").collect()] == [("none", None, None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.lookup_transactions(twice, keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the enriched deals are not dealt by id again, to be joined to the keys
    assert not re.search(r"\[requested_key#\d+\], \[txn_id#\d+\], LeftOuter", plan)


def _small(spark, tables):
    """Deals without, with an unknown and with a listing that is there twice; a deal that is there twice."""
    deals = spark.createDataFrame([("a", 1), ("b", None), ("c", 9), ("c", 9), ("d", 2), ("e", 3), (None, 1), ("z", 1)],
                                  "txn_id string, listing_id long")
    for f in S.TRANSACTIONS.fields[2:]:
        deals = deals.withColumn(f.name, F.concat(F.lit("n "), "txn_id") if f.name == "notes" else F.lit(None).cast(f.dataType))
    listings = spark.createDataFrame([(1, "x", 0, 0), (2, "y", 1, None), (3, "u", None, 1), (3, "v", 77, 1), (None, "w", 0, 0)],
                                     "listing_id long, property_type string, city_id long, locality_id long")
    return tables.with_tables(transactions=deals, listings=listings)


def test_a_lookup_finds_what_is_there_and_names_what_is_not(spark, tables):
    keys = spark.sql("SELECT explode(array('a', 'a', 'b', 'c', 'd', 'e', 'none', 'm', 'none', null)) AS txn_id")
    got = Q.lookup_transactions(_small(spark, tables), keys)
    assert got.columns == ["requested_key", "found", *S.TRANSACTIONS.fieldNames(), "property_type", "city_name", "locality_name"]
    city = {r.city_id: r.city_name for r in tables.cities.collect()}
    place = {r.locality_id: r.locality_name for r in tables.localities.collect()}
    want = [("a", True, "a", 1, "n a", "x", city[0], place[0]), ("b", True, "b", None, "n b", None, None, None),
            ("c", True, "c", 9, "n c", None, None, None), ("c", True, "c", 9, "n c", None, None, None),
            ("d", True, "d", 2, "n d", "y", city[1], None), ("e", True, "e", 3, "n e", "u", None, place[1]),
            ("e", True, "e", 3, "n e", "v", None, place[1]),
            ("m", False, None, None, None, None, None, None), ("none", False, None, None, None, None, None, None)]
    rows = got.select("requested_key", "found", "txn_id", "listing_id", "notes", "property_type", "city_name", "locality_name")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)


def test_a_large_lookup_deals_keys_and_deals_by_id_once_and_by_listing_once(spark, tables):
    t = _small(spark, tables)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Q.lookup_transactions(t, t.transactions.select("txn_id"))
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in re.findall(r"[- ] Exchange hashpartitioning\((.*?), \d+\)", plan) if "city_id" not in x and "locality_id" not in x]
    by_id = [x for x in dealt if x.startswith(("txn_id", "requested_key"))]
    # keys and deals by id, then the deals and the listings by listing; keys that miss are spread
    assert len(by_id) == 2 and len(dealt) == 4, dealt
    assert sum("coalesce(listing_id" in x and "xxhash64(requested_key" in x for x in dealt) == 1
    assert "ReusedExchange" in plan


def test_deals_are_not_dealt_to_a_few_keys(spark, tables):
    keys = spark.sql("SELECT explode(array('1-1', 'none')) AS txn_id")
    got = Q.lookup_transactions(_small(spark, tables).with_tables(transactions=tables.transactions), keys)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[txn_id#\d+\], \[requested_key#\d+\], LeftSemi, BuildRight", plan)


def test_a_task_sorts_no_more_than_fits():
    assert int(REQUIRED_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"].removesuffix("m")) <= 64
