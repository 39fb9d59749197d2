"""Change batches derived from the driver's tables (every row of the source
table becomes one change, so batch size grows with the data). Each batch
mixes valid changes with ones the validation must reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.sources.tables import read_table

MISS = 1_000_000_000  # added to a key to make it unknown


def _lpad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def line_seq(with_order: bool = False) -> Column:
    """Unique, sortable text key of a lineitem row."""
    parts = [_lpad(F.col("l_linenumber"), 3), _lpad(F.col("l_partkey"), 12), _lpad(F.col("l_suppkey"), 12),
             _lpad((F.col("l_extendedprice").cast(S.MONEY) * 100).cast("bigint"), 15)]
    if with_order:
        parts = [_lpad(F.col("l_orderkey"), 12)] + parts
    return F.concat(*parts)


def listing_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    m = k % 10
    return o.select(
        k.alias("seq"),
        F.when(m == 0, F.concat(F.lit("P"), k.cast("string"))).when(m == 1, F.lit("N"))
         .when(m == 9, F.concat(F.lit("N"), (k - 1).cast("string")))
         .otherwise(F.concat(F.lit("N"), k.cast("string"))).alias("prop_id"),
        F.when(m == 2, F.lit(-500)).otherwise(F.col("o_totalprice")).cast(S.MONEY).alias("price_inr"),
        F.when(m == 3, F.lit(99)).otherwise(k % 5).cast("bigint").alias("city_id"),
        F.when(m == 4, F.lit(999)).when(m == 5, F.lit(None)).otherwise(k % 25).cast("bigint").alias("locality_id"),
        F.when(m == 6, F.lit(3)).otherwise(F.lit(1)).cast("smallint").alias("furnish_id"),
        F.when(m == 7, F.lit(25)).otherwise(k % 6).cast("smallint").alias("bedroom_num"),
        F.when(m == 8, F.lit(None)).otherwise(k % 2 + 1).cast("smallint").alias("transact_type"),
        F.concat(F.lit("New "), k.cast("string")).alias("prop_name"),
        F.lit(None).cast("boolean").alias("verified"),
        F.to_date("o_orderdate").alias("register_date"),
        F.lit(500).cast(S.AREA).alias("min_area_sqft"),
    )


def listing_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    m = F.col("l_linenumber") % 4
    arr = lambda *c: F.array(*[F.lit(x) for x in c])
    return li.select(
        line_seq().alias("seq"),
        F.when(F.col("l_linenumber") == 7, F.col("l_orderkey") + MISS).otherwise(F.col("l_orderkey")).alias("listing_id"),
        F.when(m == 0, arr("price_inr")).when(m == 1, arr("price_inr", "verified"))
         .when(m == 2, arr("description")).otherwise(arr("is_active", "bedroom_num")).alias("set_cols"),
        F.col("l_extendedprice").cast(S.MONEY).alias("price_inr"),
        (F.col("l_returnflag") == "R").alias("verified"),
        F.lit(None).cast("string").alias("description"),
        (F.col("l_linestatus") == "O").alias("is_active"),
        F.col("l_quantity").cast("smallint").alias("bedroom_num"),
    )


def returned_listing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    hits = li.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("listing_id"))
    misses = li.where(F.col("l_linenumber") == 7).select((F.col("l_orderkey") + MISS).alias("listing_id"))
    return hits.unionByName(misses)


def txn_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        line_seq(True).alias("seq"),
        F.when(F.col("l_linenumber") == 7, F.col("l_orderkey") + MISS).otherwise(F.col("l_orderkey")).alias("listing_id"),
        (F.col("l_extendedprice").cast(S.MONEY) - 1000).cast(S.MONEY).alias("sale_price"),
        F.to_date("l_shipdate").alias("transaction_date"),
        F.concat(F.lit("Buyer "), F.col("l_suppkey").cast("string")).alias("buyer_name"),
        F.lit(None).cast("string").alias("ownership_type"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("string"))
         .when(F.col("l_returnflag") == "A", F.lit("Pending")).otherwise(F.lit("Refunded")).alias("status"),
        F.lit(None).cast("string").alias("notes"),
    )


def bridged_txn_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       (F.col("l_extendedprice").cast(S.MONEY) * 100).cast("bigint"))


def txn_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    m = F.col("l_linenumber") % 3
    arr = lambda *c: F.array(*[F.lit(x) for x in c])
    return li.select(
        F.lit("1").alias("seq"),
        F.when(F.col("l_linenumber") == 7, F.concat(bridged_txn_id(), F.lit("-x")))
         .otherwise(bridged_txn_id()).alias("txn_id"),
        F.when(m == 0, arr("status")).when(m == 1, arr("notes")).otherwise(arr("sale_price")).alias("set_cols"),
        F.when(F.col("l_returnflag") == "N", "Cancelled").when(F.col("l_returnflag") == "A", "Completed")
         .otherwise("Bogus").alias("status"),
        F.concat(F.lit("checked "), F.col("l_partkey").cast("string")).alias("notes"),
        F.when(F.col("l_quantity") > 45, F.lit(-1)).otherwise(F.col("l_extendedprice").cast(S.MONEY) + 1)
         .cast(S.MONEY).alias("sale_price"),
    )


def returned_txn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    hits = li.where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).select(
        bridged_txn_id().alias("txn_id"))
    misses = li.where(F.col("l_linenumber") == 7).select(
        F.concat(F.lit("none-"), F.col("l_orderkey").cast("string")).alias("txn_id"))
    return hits.unionByName(misses)


def agent_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("seq"),
        F.when(k % 10 == 0, F.lit("X")).otherwise(F.concat(F.lit("New "), F.col("c_name"))).alias("contact_name"),
        F.col("c_mktsegment").alias("company_name"),
        F.concat(F.lit("+91-"), k.cast("string")).alias("phone"),
        F.when(k % 7 == 0, F.lit("bad-email"))
         .otherwise(F.concat(F.lit("new"), k.cast("string"), F.lit("@agents.example"))).alias("email"),
    )


def agent_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    m = k % 3
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    return c.select(
        F.lit(1).alias("seq"),
        F.when(k % 13 == 0, k + MISS).otherwise(k).alias("agent_id"),
        F.when(m == 0, arr("phone")).when(m == 1, arr("email")).otherwise(arr("is_active")).alias("set_cols"),
        F.concat(F.lit("+91-99"), k.cast("string")).alias("phone"),
        F.when(k % 2 == 0, F.lit("oops")).otherwise(F.concat(F.lit("upd"), k.cast("string"),
                                                             F.lit("@agents.example"))).alias("email"),
        (F.col("c_acctbal") > 1000).alias("is_active"),
    )


def low_balance_agent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.where(F.col("c_acctbal") < 100).select(F.col("c_custkey").alias("agent_id")).unionByName(
        c.where(F.col("c_custkey") % 13 == 0).select((F.col("c_custkey") + MISS).alias("agent_id")))


def feed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-feed records: two changes for every order, by key class.

    0: two creates of one prop_id (the first invalid for every 40th key);
    1: two partial updates; 2: a delete, then an update; 3: a valid update,
    then an invalid one; 4: an update, then a delete; 5: updates of an unknown
    listing; 6: two deletes; 7: a create of an existing prop_id, then an
    update of its listing."""
    o = read_table(spark, sf_dir, "orders")
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 8
    price = F.col("o_totalprice").cast(S.MONEY)
    kinds = {0: ("create", "create"), 1: ("update", "update"), 2: ("delete", "update"), 3: ("update", "update"),
             4: ("update", "delete"), 5: ("update", "update"), 6: ("delete", "delete"), 7: ("create", "update")}
    none = F.lit(None)

    def change(i: int) -> Column:
        op = F.element_at(F.array(*[F.lit(kinds[c][i]) for c in range(8)]), (m + 1).cast("int"))
        cols = {n: none.cast(t) for n, t in S.LISTING_COLUMNS if n not in ("created_at", "updated_at")}
        create = op == "create"
        value = {0: F.when((m == 0) & (k % 40 == 0), F.lit(-1)).when(m == 0, price).otherwise(price + 1),
                 1: F.when(m == 3, F.lit(-1)).when(m == 0, price + 5).otherwise(price + 2)}[i]
        cols |= {
            "listing_id": F.when(create, none).when(m == 5, k + MISS).otherwise(k).cast("bigint"),
            "prop_id": F.when(m == 0, F.concat(F.lit("S"), _lpad(k, 12)))
                        .when(create, F.concat(F.lit("P"), k.cast("string"))),
            "price_inr": value.cast(S.MONEY),
            "verified": F.lit(True),
            "city_id": F.when(create, k % 5).cast("bigint"),
            "transact_type": F.when(create, F.lit(1)).cast("smallint"),
        }
        sets = F.when(op == "update", F.when((m == 1) & F.lit(i == 1), F.array(F.lit("verified")))
                      .otherwise(F.array(F.lit("price_inr"))))
        return F.struct(op.alias("op"), (k * 10 + i).alias("seq"), sets.alias("set_cols"),
                        *[c.alias(n) for n, c in cols.items()])

    return o.select(F.explode(F.array(change(0), change(1))).alias("c")).select("c.*")
