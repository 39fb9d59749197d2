"""AGG1 from daily partials: exact distinct counts by mergeable bitmaps.

Three small tables hold, for each day, the sums of the listings, the ids of the
cities and localities that had an active listing (as bitmaps: one for each
32,768 consecutive ids) and the sums of the completed deals. Sums add and bitmaps
are or-ed, so the figures of any range of days, and of tables appended to, come
from the partials alone and equal those of the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.functions import exprs as X
from propcube.operators.analytics import SUM_MONEY, _date_preds
from propcube.sources.bridge import Tables

LISTINGS = ("day date, n long, n_active long, u_price decimal(38,0), c_price long, u_sqft decimal(38,0), c_sqft long")
PLACES = "day date, kind string, bucket long, ids binary"
DEALS = "day date, n long, total decimal(38,2)"


def listing_days(listings: DataFrame) -> DataFrame:
    return listings.where("price_inr > 0").groupBy(F.col("register_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_active").alias("n_active"),
        F.sum(X.units("price_inr", 2)).alias("u_price"), F.count("price_inr").alias("c_price"),
        F.sum(X.units("price_sqft", 2)).alias("u_sqft"), F.count("price_sqft").alias("c_sqft"))


def place_days(listings: DataFrame) -> DataFrame:
    """Bitmaps of the active cities and localities of each day."""
    active = listings.where("price_inr > 0 AND is_active")
    ids = active.select(F.col("register_date").alias("day"), F.explode(F.map_from_arrays(
        F.array(F.lit("city"), F.lit("locality")), F.array("city_id", "locality_id"))).alias("kind", "id"))
    return ids.where("id IS NOT NULL").groupBy("day", "kind", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("ids"))


def deal_days(transactions: DataFrame) -> DataFrame:
    return transactions.where("status = 'Completed'").groupBy(F.col("transaction_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), X.exact_sum("sale_price", SUM_MONEY).alias("total"))


def append_partials(listings: DataFrame, transactions: DataFrame, root: str) -> None:
    """Add the days of new listings and deals to the partials below ``root``."""
    for name, rows in (("listings", listing_days(listings)), ("places", place_days(listings)), ("deals", deal_days(transactions))):
        rows.write.mode("append").parquet(f"{root}/{name}")


def summary_of(spark: SparkSession, root: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The one-row summary (AGG1) of a range of days."""
    def of(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{root}/{name}").where(X.all_of(_date_preds("day", date_from, date_to)))

    merged = of("places", PLACES).groupBy("kind", "bucket").agg(F.bitmap_or_agg("ids").alias("ids"))
    places = merged.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.bitmap_count("ids"))), F.lit(0)).alias(k)
                          for k in ("city", "locality")])
    deals = of("deals", DEALS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").cast(SUM_MONEY).alias("total"))

    def one(df: DataFrame) -> Column:  # both figures from one scan
        return df.select(F.struct(*df.columns)).scalar()

    p, d = one(places), one(deals)
    return of("listings", LISTINGS).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_listings"),
        F.coalesce(F.sum("n_active"), F.lit(0)).cast("bigint").alias("active_listings"),
        X.exact_mean_of(F.sum("u_price"), F.sum("c_price"), 2, S.MONEY).alias("avg_price_inr"),
        X.exact_mean_of(F.sum("u_sqft"), F.sum("c_sqft"), 2, S.MONEY).alias("avg_price_sqft"),
    ).select("*", p["city"].alias("cities_covered"), p["locality"].alias("localities_covered"),
             d["n"].alias("total_transactions"), d["total"].alias("total_sales_value"))


def build_partials(t: Tables, root: str) -> None:
    append_partials(t.listings, t.transactions, root)
