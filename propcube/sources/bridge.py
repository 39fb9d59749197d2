"""Domain tables derived from the driver's source tables.

cities <- region, localities <- nation, agents <- customer,
buildings <- part, listings <- orders (+ nation), transactions <- lineitem.
Every column is a narrow projection of one source row (plus the 25-row
nation lookup for listings), so the whole bridge is a single scan stage per
table with no shuffle. The oracle SQL in ``propcube.plans.oracle`` states the
same mapping in DuckDB.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.sources.tables import read_table


def _geo(key, offset: int = 0):
    """NULL when key % 5 = 0, else key + offset as decimal(10,7)."""
    return F.when(key % 5 == 0, F.lit(None).cast(S.GEO)).otherwise((key + offset).cast(S.GEO))


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "region")
    return r.select(
        F.col("r_regionkey").cast("bigint").alias("city_id"),
        F.col("r_name").alias("city_name"),
        F.substring("r_name", 1, 3).alias("city_code"),
    )


def localities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("bigint").alias("locality_id"),
        F.col("n_name").alias("locality_name"),
        F.col("n_regionkey").cast("bigint").alias("city_id"),
        _geo(k).alias("latitude"),
        _geo(k, 70).alias("longitude"),
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("agent_id"),
        F.col("c_name").alias("contact_name"),
        F.col("c_mktsegment").alias("company_name"),
        F.concat(F.lit("+91-"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("phone"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@agents.example")).alias("email"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.date_add(F.lit("1992-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int"))
         .cast("timestamp").alias("created_at"),
    )


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("building_id"),
        F.col("p_name").alias("building_name"),
        F.col("p_brand").alias("society_name"),
        (F.col("p_partkey") % 25).alias("locality_id"),
        F.col("p_size").cast("smallint").alias("total_floors"),
    )


_COLUMNS: dict[tuple, list] = {}


def _cached_columns(spark: SparkSession, name: str, build) -> list:
    """Select lists are unresolved Columns: build once per session, reuse
    for every query (saves hundreds of driver round trips per plan)."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _COLUMNS:
        _COLUMNS[key] = build()
    return _COLUMNS[key]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = o.join(nation, (F.col("o_orderkey") % 25).cast("int") == F.col("n_nationkey"), "inner")
    return joined.select(*_cached_columns(spark, "listings", _listing_columns))


def _listing_columns() -> list:
    k = F.col("o_orderkey")
    area = F.lit(400) + (k % 37) * 50
    price = F.col("o_totalprice").cast(S.MONEY)
    cents = (price * 100).cast("bigint")
    sqft = (F.when(k % 53 == 0, F.lit(150000).cast(S.PRICE_SQFT))
            .when(k % 59 == 0, F.lit(0).cast(S.PRICE_SQFT))
            .otherwise((F.call_function("div", cents, area).cast("decimal(20,0)")
                        * F.lit(Decimal("0.01"))).cast(S.PRICE_SQFT)))
    reg = F.when(k % 97 == 0, F.lit(None).cast("date")).otherwise(F.to_date("o_orderdate"))
    furnish = F.when(k % 4 == 3, F.lit(4)).otherwise(k % 4)
    nk = F.col("n_nationkey")
    return [
        k.alias("listing_id"),
        F.concat(F.lit("P"), k.cast("string")).alias("prop_id"),
        F.substr("o_orderpriority", F.lit(3)).alias("property_type"),
        F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).cast("smallint").alias("transact_type"),
        (k % 8).cast("smallint").alias("bedroom_num"),
        (k % 5).cast("smallint").alias("bathroom_num"),
        (k % 4).cast("smallint").alias("balcony_num"),
        furnish.cast("smallint").alias("furnish_id"),
        (k % 30).cast("smallint").alias("age"),
        (k % 21).cast("smallint").alias("floor_num"),
        F.lit(20).cast("smallint").alias("total_floor"),
        area.cast(S.AREA).alias("min_area_sqft"),
        (area + (k % 3) * 100).cast(S.AREA).alias("max_area_sqft"),
        price.alias("price_inr"),
        sqft.alias("price_sqft"),
        F.concat(F.lit("Status "), F.col("o_orderstatus"), F.lit(", priority "),
                 F.col("o_orderpriority")).alias("description"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Tower "), F.col("o_custkey").cast("string"))).alias("prop_name"),
        _geo(nk).alias("latitude"),
        _geo(nk, 70).alias("longitude"),
        reg.alias("register_date"),
        F.date_add(reg, 365).alias("expiry_date"),
        (k % 7 == 0).alias("verified"),
        (k % 11 != 0).alias("is_active"),
        F.when(k % 3 == 0, F.lit(None).cast("bigint")).otherwise(k % 200).alias("building_id"),
        F.col("o_custkey").alias("agent_id"),
        F.col("n_regionkey").cast("bigint").alias("city_id"),
        F.when(k % 31 == 0, F.lit(None).cast("bigint")).otherwise(nk.cast("bigint")).alias("locality_id"),
        F.when(k % 3 == 0, F.lit("Lift, Parking")).when(k % 3 == 1, F.lit("Gym, Pool"))
         .otherwise(F.lit(None).cast("string")).alias("amenities"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    ]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(*_cached_columns(spark, "transactions", _transaction_columns))


def _transaction_columns() -> list:
    price = F.col("l_extendedprice").cast(S.MONEY)
    own = F.element_at(F.array(*[F.lit(x) for x in S.OWNERSHIP_TYPES]),
                       (F.col("l_linenumber") % 4 + 1).cast("int"))
    return [
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    (price * 100).cast("bigint")).alias("txn_id"),
        F.col("l_orderkey").alias("listing_id"),
        price.alias("sale_price"),
        F.to_date("l_shipdate").alias("transaction_date"),
        F.concat(F.lit("Buyer "), F.col("l_suppkey").cast("string")).alias("buyer_name"),
        own.alias("ownership_type"),
        F.when(F.col("l_returnflag") == "N", "Completed")
         .when(F.col("l_returnflag") == "A", "Pending")
         .otherwise("Cancelled").alias("status"),
        F.lit(None).cast("string").alias("notes"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
    ]


class Tables:
    """The six domain tables of one dataset, built lazily.

    Joins carry no hints: Catalyst and AQE broadcast a side by its size in
    bytes and shuffle it otherwise.
    """

    _builders = {
        "cities": cities, "localities": localities, "agents": agents,
        "buildings": buildings, "listings": listings, "transactions": transactions,
    }

    def __init__(self, spark: SparkSession, sf_dir: str, overrides: dict | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = dict(overrides or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._builders[name](self.spark, self.sf_dir)
        return self._frames[name]

    def with_tables(self, **frames: DataFrame) -> "Tables":
        merged = dict(self._frames)
        merged.update(frames)
        return Tables(self.spark, self.sf_dir, merged)


def load(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
