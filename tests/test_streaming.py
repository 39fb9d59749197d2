"""S1 idempotence and S2 = AGG7."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.operators import views as V
from propcube.plans import batches as B
from propcube.session import materialize, scratch_path
from propcube.streaming import changefeed as CF
from propcube.streaming import incremental as INC
from tests.conftest import SF_SMALL

TS = "2024-06-01 00:00:00"


def test_incremental_trends_equal_full_recompute(spark, tables):
    root = scratch_path(spark, "inc-test")
    tables.listings.repartition(3).write.parquet(f"{root}/in")
    INC.run_incremental(spark, f"{root}/in", S.LISTINGS, f"{root}/state", f"{root}/ck", tables.cities)
    got = INC.finalize(INC.read_partials(spark, f"{root}/state"))
    want = V.mv_price_trends(tables)
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def _run(spark, tables, changes, files, per_trigger, trends=False, key="coalesce(listing_id, hash(prop_id))"):
    root = scratch_path(spark, "feed-test")
    changes.repartition(files, F.expr(key)).sortWithinPartitions("seq").write.parquet(f"{root}/in")
    CF.init_state(tables.listings, f"{root}/state")
    if trends:
        INC.init_partials(tables.listings, tables.cities, f"{root}/trends")
    CF.run_change_feed(spark, f"{root}/in", f"{root}/state", f"{root}/ck", tables.cities, tables.localities, TS,
                       max_files_per_trigger=per_trigger, trends_dir=f"{root}/trends" if trends else None)
    return root


COLS = ["prop_id", "price_inr", "verified", "is_active"]


def test_change_feed_replay_and_new_checkpoint(spark, tables):
    changes = B.feed_changes(spark, SF_SMALL)
    root = _run(spark, tables, changes, 2, 1, trends=True, key="seq div 10")
    state = f"{root}/state"
    seen = lambda: (sorted(CF.read_state(spark, state).collect()), sorted(CF.read_rejects(spark, state).collect(), key=repr),
                    sorted(INC.finalize(INC.read_partials(spark, f"{root}/trends")).collect()))
    first = seen()
    args = (tables.cities, tables.localities, TS)
    CF.run_change_feed(spark, f"{root}/in", state, f"{root}/ck", *args)  # same checkpoint: nothing new
    assert seen() == first
    # a batch that is repeated finds its images; a partition that it had not reached is written then
    stream = INC.stream_id(spark, f"{root}/ck")
    lost = CF.State(spark, state)
    before = tables.listings.withColumn("_deleted", F.lit(False)).withColumn("bucket", CF.bucket_of("listing_id", lost.buckets))
    CF.write_partitions(before, f"{state}/listings", ["bucket"])
    for n in (0, 1):
        images = CF.apply_batch(lost, changes, stream, n, *args)
        INC.apply_signed(spark, f"{root}/trends", INC.signed_images(images.where("NOT _after"), images.where("_after AND NOT _deleted")),
                         tables.cities, stream, n)
    assert seen() == first
    batch, rejects = CF.apply_changes(tables.listings, changes, *args)
    assert sorted(batch.select(COLS).collect()) == sorted(CF.read_state(spark, state).select(COLS).collect())
    # a new checkpoint over an old state does not skip its first batches
    more = scratch_path(spark, "feed-more")
    spark.createDataFrame([("update", 1, ["price_inr"], 5, 77)], "op string, seq long, set_cols array<string>, "
                          "listing_id long, price_inr long").selectExpr(
        "op", "seq", "set_cols", "listing_id", "CAST(price_inr AS decimal(18,2)) AS price_inr").write.parquet(f"{more}/in")
    listing = CF.read_state(spark, state).where("listing_id = 5")
    assert listing.count() == 1
    CF.run_change_feed(spark, f"{more}/in", state, f"{more}/ck", *args)
    assert CF.read_state(spark, state).where("listing_id = 5").first().price_inr == 77


def _trends(spark, state_dir):
    return sorted(INC.finalize(INC.read_partials(spark, state_dir)).collect())


def _recomputed(tables, listings):
    want = V.mv_price_trends(tables.with_tables(listings=listings))
    return sorted(want.select("city_name", "month", "listing_count", "avg_price_sqft", "avg_price_inr",
                              "min_price_inr", "max_price_inr").collect())


def test_trends_of_a_second_stream_and_a_repeated_batch(spark, tables):
    """A new checkpoint over the same state counts on; a replay does not."""
    root = scratch_path(spark, "inc-two")
    odd, even = (tables.listings.where(F.col("listing_id") % 2 == i) for i in (1, 0))
    odd.repartition(2).write.parquet(f"{root}/in1")
    even.repartition(1).write.parquet(f"{root}/in2")
    state = f"{root}/state"
    for part in ("1", "2"):
        INC.run_incremental(spark, f"{root}/in{part}", S.LISTINGS, state, f"{root}/ck{part}", tables.cities)
    want = _recomputed(tables, tables.listings)
    assert _trends(spark, state) == want
    rows = spark.read.schema(S.LISTINGS).parquet(f"{root}/in2")
    INC.apply_signed(spark, state, rows, tables.cities, INC.stream_id(spark, f"{root}/ck2"), 0)
    assert _trends(spark, state) == want


def test_trends_follow_updates_and_deletes_until_extremes_run_dry(spark, tables, monkeypatch):
    monkeypatch.setattr(INC, "TAIL", 2)
    root = scratch_path(spark, "inc-signed")
    base = materialize(tables.listings, "inc-base")
    INC.init_partials(base, tables.cities, f"{root}/state")
    asked = []

    def step(n, before, after, left):
        def listings():
            asked.append(n)
            return left
        INC.apply_signed(spark, f"{root}/state", INC.signed_images(before, after), tables.cities, "s", n, listings)
        assert _trends(spark, f"{root}/state") == _recomputed(tables, left)

    up = base.where("listing_id % 97 = 0")
    dearer = up.withColumn("price_inr", (F.col("price_inr") + 1).cast(S.MONEY)).withColumn("city_id", F.lit(1).cast("long"))
    now = materialize(base.where("listing_id % 97 <> 0").unionByName(dearer), "inc-now")
    step(0, up, dearer, now)
    w = Window.partitionBy("city_id", F.trunc("register_date", "MM")).orderBy("price_inr")
    ranked = now.where("transact_type = 1").withColumn("r", F.row_number().over(w))
    cheap = materialize(ranked.where("r <= 4").drop("r"), "inc-cheap")  # more than a list holds
    now = materialize(now.join(cheap.select("listing_id"), "listing_id", "left_anti").select(base.columns), "inc-left")
    step(1, cheap, now.limit(0), now)
    assert 1 in asked and 0 not in asked
    step(2, now, now.limit(0), now.limit(0))  # all gone
    assert _trends(spark, f"{root}/state") == []


def test_a_batch_does_not_read_the_listings(spark, tables):
    """The plan of a merge reads the batch's prices and the state only."""
    root = scratch_path(spark, "inc-plan")
    INC.init_partials(tables.listings, tables.cities, f"{root}/state")
    delta = materialize(INC.by_price(tables.listings.limit(10), tables.cities), "ten")
    plan = INC.merge(INC._state(spark, f"{root}/state"), delta, "x", 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "listing_id" not in plan


def _changes(spark, rows):
    return spark.createDataFrame(rows, "op string, seq long, set_cols array<string>, listing_id long, prop_id string, "
                                 "price long, verified boolean, city_id long").selectExpr(
        "op", "seq", "set_cols", "listing_id", "prop_id", "CAST(price AS decimal(18,2)) AS price_inr", "verified", "city_id")


def test_changes_of_one_key_fold_in_order_for_any_batching(spark, tables):
    rows = [
        ("update", 1, ["price_inr"], 5, None, 111, None, None), ("update", 2, ["verified"], 5, None, None, True, None),
        ("delete", 3, None, 6, None, None, None, None), ("update", 4, ["price_inr"], 6, None, 5, None, None),
        ("update", 5, ["price_inr"], 7, None, 222, None, None), ("update", 6, ["price_inr"], 7, None, -1, None, None),
        ("create", 7, None, None, "NEW-1", 10, None, 0), ("create", 8, None, None, "NEW-1", 20, None, 0),
        ("create", 9, None, None, None, 10, None, 0), ("create", 10, None, None, None, 10, None, 0),
        ("upsert", 11, None, 8, None, 10, None, 0), ("delete", 12, None, 999999999, None, None, None, None),
    ]
    got = {}
    for files, per in ((1, 1), (4, 1), (4, 4)):
        root = _run(spark, tables, _changes(spark, rows), files, per)
        state = CF.read_state(spark, f"{root}/state")
        l5, l7 = (state.where(f"listing_id = {i}").first() for i in (5, 7))
        assert (l5.price_inr, l5.verified, l7.price_inr) == (111, True, 222)
        assert state.where("listing_id = 6").count() == 0
        assert [r.price_inr for r in state.where("prop_id = 'NEW-1'").collect()] == [10]
        assert state.count() == tables.listings.count()  # one gone, one new
        got[files, per] = {r.seq: r.reasons for r in CF.read_rejects(spark, f"{root}/state").collect()}
    assert got[1, 1] == got[4, 1] == got[4, 4] == {
        4: ["not_found"], 6: ["price_inr_positive"], 8: ["prop_id_exists"], 9: ["prop_id_length"],
        10: ["prop_id_length"], 11: ["unknown_op"], 12: ["not_found"]}


def test_create_may_use_the_prop_id_of_a_deleted_listing(spark, tables):
    prop = tables.listings.where("listing_id = 6").first().prop_id
    prop = prop if len(prop) >= 3 else tables.listings.where("listing_id = 100").first().prop_id
    lid = int(prop[1:])
    rows = [("create", 1, None, None, prop, 10, None, 0), ("delete", 2, None, lid, None, None, None, None),
            ("create", 3, None, None, prop, 30, None, 0)]
    new, rej = CF.apply_changes(tables.listings, _changes(spark, rows), tables.cities, tables.localities, TS)
    assert [r.price_inr for r in new.where(F.col("prop_id") == prop).collect()] == [30]
    assert {r.seq: r.reasons for r in rej.collect()} == {1: ["prop_id_exists"]}


def test_trends_follow_a_mixed_feed(spark, tables):
    root = _run(spark, tables, B.feed_changes(spark, SF_SMALL), 3, 1, trends=True, key="seq div 10")
    got = INC.finalize(INC.read_partials(spark, f"{root}/trends"))
    want = V.mv_price_trends(tables.with_tables(listings=CF.read_state(spark, f"{root}/state")))
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
