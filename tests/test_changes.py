"""Change batches: the reference's CRUD assertions, as batch operations."""
from decimal import Decimal

from pyspark.sql import functions as F

from propcube.operators import changes as C
from propcube.operators import search as Q

TS = "2024-06-01 00:00:00"


def _create(spark, rows):
    schema = ("seq long, prop_id string, property_type string, transact_type smallint, "
              "bedroom_num smallint, bathroom_num smallint, min_area_sqft decimal(12,4), "
              "max_area_sqft decimal(12,4), price_inr decimal(18,2), price_sqft decimal(12,2), "
              "city_id long, prop_name string, furnish_id smallint, verified boolean, locality_id long")
    return spark.createDataFrame(rows, schema)


def _row(seq, prop_id, price, city=0, locality=None, furnish=1):
    return (seq, prop_id, "Apartment", 1, 2, 2, Decimal("900"), Decimal("1000"), Decimal(price),
            Decimal("9444.44"), city, "Test Residency", furnish, True, locality)


def test_create_keeps_scale_and_rejects_duplicates_and_bad_prices(spark, tables):
    ch = _create(spark, [
        _row(1, "TEST_ABC_1", "8500000"),
        _row(2, "P0", "8500000"),             # prop_id 'P0' exists (and is too short)
        _row(3, "P123", "8500000"),           # existing prop_id
        _row(4, "TEST_NEG", "-500"),          # price must be > 0
        _row(5, "TEST_ABC_1", "9000000"),     # same new prop_id again in the batch
        _row(6, "TEST_BADCITY", "100", city=99),
        _row(7, "TEST_LOC0", "100", locality=0),  # locality id 0 exists: accepted
        _row(8, "TEST_FURN", "100", furnish=3),
    ])
    new, rej = C.create_listings(tables.listings, ch, tables.cities, tables.localities, TS)
    created = {r.prop_id: r for r in new.where(F.col("created_at") == F.lit(TS).cast("timestamp")).collect()}
    assert set(created) == {"TEST_ABC_1", "TEST_LOC0"}
    assert str(created["TEST_ABC_1"].price_inr) == "8500000.00"
    assert created["TEST_ABC_1"].is_active is True
    reasons = {r.seq: set(r.reasons) for r in rej.collect()}
    assert "prop_id_exists" in reasons[3]
    assert reasons[4] == {"price_required"}
    assert reasons[5] == {"prop_id_duplicate_in_batch"}
    assert reasons[6] == {"city_unknown"}
    assert reasons[8] == {"furnish_id_domain"}
    # ids are new and dense after the current maximum
    top = tables.listings.agg(F.max("listing_id")).first()[0]
    assert sorted(r.listing_id for r in created.values()) == [top + 1, top + 2]


def test_update_partial_and_unknown_id(spark, tables):
    upd = spark.createDataFrame(
        [("a", 5, ["price_inr", "verified"], Decimal("9000000"), True, None),
         ("b", 9999999, ["price_inr"], Decimal("1"), None, None),
         ("c", 6, ["description"], None, None, None),           # explicit NULL is written
         ("d", 7, ["price_inr"], Decimal("-1"), None, None)],    # rule failure
        "seq string, listing_id long, set_cols array<string>, price_inr decimal(18,2), "
        "verified boolean, description string")
    new, rej = C.update_listings(tables.listings, upd, TS)
    got = {r.listing_id: r for r in new.where(F.col("listing_id").isin(5, 6, 7)).collect()}
    assert str(got[5].price_inr) == "9000000.00" and got[5].verified is True
    assert got[6].description is None
    before = {r.listing_id: r for r in tables.listings.where(F.col("listing_id").isin(5, 6, 7)).collect()}
    assert got[6].price_inr == before[6].price_inr      # not sent -> unchanged
    assert got[7].price_inr == before[7].price_inr      # rejected
    assert {r.seq: r.reasons for r in rej.collect()} == {"b": ["not_found"], "d": ["price_inr_positive"]}


def test_soft_delete_hides_from_active_search_and_hard_delete_cascades(spark, tables):
    ids = spark.createDataFrame([(3,), (123456789,)], "listing_id long")
    soft, tx, rej = C.delete_listings(tables.listings, tables.transactions, ids, "soft", TS)
    active = Q.filter_listings(soft, Q.ListingFilters(is_active=True))
    assert active.where("listing_id = 3").count() == 0
    assert soft.where("listing_id = 3").count() == 1
    assert [r.listing_id for r in rej.collect()] == [123456789]
    hard_l, hard_t, _ = C.delete_listings(tables.listings, tables.transactions, ids, "hard", TS)
    assert hard_l.where("listing_id = 3").count() == 0
    assert hard_t.where("listing_id = 3").count() == 0
    assert tables.transactions.where("listing_id = 3").count() > 0


def test_create_then_hard_delete_is_identity(spark, tables):
    ch = _create(spark, [_row(1, "TEST_ROUNDTRIP_1", "100"), _row(2, "TEST_ROUNDTRIP_2", "200")])
    new, _ = C.create_listings(tables.listings, ch, tables.cities, tables.localities, TS)
    made = new.where(F.col("prop_id").startswith("TEST_ROUNDTRIP")).select("listing_id")
    back, _, _ = C.delete_listings(new, tables.transactions, made, "hard", TS)
    cols = ["listing_id", "prop_id", "price_inr"]
    assert sorted(back.select(cols).collect()) == sorted(tables.listings.select(cols).collect())


def test_transaction_status_update_and_invalid_status(spark, tables):
    tx = tables.transactions
    some = tx.orderBy("txn_id").select("txn_id").limit(2).collect()
    upd = spark.createDataFrame(
        [("1", some[0].txn_id, ["status", "notes"], "Completed", "Deal closed"),
         ("1", some[1].txn_id, ["status"], "InvalidStatus", None)],
        "seq string, txn_id string, set_cols array<string>, status string, notes string")
    new, rej = C.update_transactions(tx, upd)
    got = {r.txn_id: r for r in new.where(F.col("txn_id").isin(some[0].txn_id, some[1].txn_id)).collect()}
    assert got[some[0].txn_id].status == "Completed" and got[some[0].txn_id].notes == "Deal closed"
    assert [r.reasons for r in rej.collect()] == [["status_domain"]]


def test_city_delete_blocked_while_referenced(spark, tables):
    ids = spark.createDataFrame([(0,)], "city_id long")
    cities, _, buildings, rej = C.delete_cities(tables.cities, tables.localities, tables.buildings, tables.listings, ids)
    assert cities.where("city_id = 0").count() == 1
    assert [r.reasons for r in rej.collect()] == [["referenced_by_listings"]]
    assert sorted(buildings.collect()) == sorted(tables.buildings.collect())


def test_city_delete_clears_buildings_of_its_localities(spark, tables):
    ids = spark.createDataFrame([(0,)], "city_id long")
    _, locs, buildings, rej = C.delete_cities(tables.cities, tables.localities, tables.buildings,
                                              tables.listings.where("city_id <> 0"), ids)
    assert rej.count() == 0 and locs.where("city_id = 0").count() == 0
    gone = {r.locality_id for r in tables.localities.where("city_id = 0").collect()}
    before = {r.building_id: r.locality_id for r in tables.buildings.collect()}
    after = {r.building_id: r.locality_id for r in buildings.collect()}
    assert after == {b: None if x in gone else x for b, x in before.items()}


def test_foreign_keys_are_checked_on_create_and_update(spark, tables):
    ch = _create(spark, [_row(1, "TEST_AGENT", "100"), _row(2, "TEST_BUILDING", "100"), _row(3, "TEST_GOOD", "100")])
    ch = ch.withColumn("agent_id", F.expr("CASE seq WHEN 1 THEN 987654321 ELSE 1 END")) \
        .withColumn("building_id", F.expr("CASE seq WHEN 2 THEN 987654321 END"))
    new, rej = C.create_listings(tables.listings, ch, tables.cities, tables.localities, TS,
                                 buildings=tables.buildings, agents=tables.agents)
    assert {r.seq: r.reasons for r in rej.collect()} == {1: ["agent_unknown"], 2: ["building_unknown"]}
    assert new.where("prop_id = 'TEST_GOOD'").count() == 1
    upd = spark.createDataFrame([("a", 5, ["locality_id"], 999, None, None), ("b", 6, ["agent_id"], None, 987654321, None),
                                 ("c", 7, ["furnish_id"], None, None, 3), ("d", 8, ["locality_id"], 0, None, None)],
                                "seq string, listing_id long, set_cols array<string>, locality_id long, agent_id long, "
                                "furnish_id smallint")
    new, rej = C.update_listings(tables.listings, upd, TS, localities=tables.localities, agents=tables.agents)
    assert {r.seq: r.reasons for r in rej.collect()} == {
        "a": ["locality_unknown"], "b": ["agent_unknown"], "c": ["furnish_id_domain"]}
    assert new.where("listing_id = 8").first().locality_id == 0
