"""Dashboard roll-ups (WIN1-WIN5) and display columns (FN3-FN5).

These regroup the analytics outputs, which are bounded by dimension sizes
(cities x months, cities x types, top-n rows). Grand totals use scalar
subqueries rather than joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propcube import schemas as S
from propcube.functions import exprs as X
from propcube.operators import analytics as A
from propcube.sources.bridge import Tables

def _city_names(t: Tables, cities: list[str] | None) -> list[str]:
    """Pivot columns: the cities asked for, else every city. A matrix is as
    wide as its city list; the long form (AGG2, AGG6) has no such width."""
    if cities is not None:
        return sorted(cities)
    return sorted(r[0] for r in t.cities.select("city_name").distinct().collect())


def price_trend_matrix(t: Tables, cities: list[str] | None = None, **filters) -> DataFrame:
    """WIN3: month rows x city columns of avg price/sqft; missing or 0 -> NULL."""
    pt = A.price_trends(t, **filters)
    v = F.when(F.col("avg_price_sqft") != 0, F.col("avg_price_sqft"))
    return (pt.groupBy("month").pivot("city_name", _city_names(t, cities))
              .agg(F.max(v)).orderBy("month"))


def bedroom_matrix(t: Tables, cities: list[str] | None = None, **filters) -> DataFrame:
    """WIN4: '1 BHK'..'6 BHK' rows x city columns; 0 -> NULL; every row present."""
    bp = A.bedroom_price(t, **filters)
    v = F.when(F.col("avg_price_sqft") != 0, F.col("avg_price_sqft"))
    wide = bp.groupBy("bedroom_num").pivot("city_name", _city_names(t, cities)).agg(F.max(v))
    rows = t.spark.range(1, 7).select(F.col("id").cast("smallint").alias("bedroom_num"))
    return (rows.join(wide, "bedroom_num", "left")
                .select(X.bhk_label("bedroom_num").alias("bedrooms"), "bedroom_num",
                        *[c for c in wide.columns if c != "bedroom_num"])
                .orderBy("bedroom_num"))


def property_share(t: Tables, **filters) -> DataFrame:
    """WIN2: per property type: listings summed over cities, share of the
    grand total in percent (1 dp, half-up), and the unweighted mean of the
    per-city average price/sqft (2 dp). NULL type -> 'Unknown'."""
    pd_ = A.property_distribution(t, **filters)
    g = pd_.groupBy(F.coalesce("property_type", F.lit("Unknown")).alias("property_type")).agg(
        F.sum("listing_count").alias("listing_count"),
        # a zero average counts as missing, like the dashboard does
        F.sum(F.when(F.col("avg_price_sqft") != 0, X.units("avg_price_sqft", 2))).alias("_u"),
        F.count(F.when(F.col("avg_price_sqft") != 0, F.lit(1))).alias("_n"),
    )
    # one row per property type: the grand total comes from these rows
    total = F.sum("listing_count").over(Window.partitionBy())
    share = X.exact_round_div(F.col("listing_count").cast("decimal(38,0)") * 1000, total)
    return (g.select(
        "property_type", "listing_count",
        X.scaled(share, 1, T.DecimalType(5, 1)).alias("share_pct"),
        X.exact_mean_of(F.col("_u"), F.col("_n"), 2, S.MONEY).alias("mean_city_price_sqft"),
    ).orderBy(F.col("listing_count").desc(), "property_type"))


def locality_rollup(t: Tables, top_n: int = 15, label_len: int = 22, **filters) -> DataFrame:
    """WIN5 over the top-n locality-demand rows: sum per locality name
    (same-named localities of different cities merge), unweighted mean of
    the non-null averages rounded to an integer, top 15, short label."""
    ld = A.locality_demand(t, top_n=top_n, **filters)
    g = ld.groupBy("locality_name").agg(
        F.sum("listing_count").alias("listing_count"),
        F.sum(F.when(F.col("avg_price_sqft") != 0, X.units("avg_price_sqft", 2))).alias("_u"),
        F.count(F.when(F.col("avg_price_sqft") != 0, F.lit(1))).alias("_n"),
    )
    mean = F.coalesce(X.exact_round_div(F.col("_u"), F.col("_n") * 100), F.lit(0)).cast("bigint")
    label = F.when(F.length("locality_name") > label_len,
                   F.concat(F.substring("locality_name", 1, label_len), F.lit("…"))
                   ).otherwise(F.col("locality_name"))
    return (g.select(label.alias("label"), "locality_name", "listing_count",
                     mean.alias("avg_price_sqft"))
             .orderBy(F.col("listing_count").desc(), "locality_name").limit(15))


def agent_leaderboard(t: Tables, top_n: int = 10, **filters) -> DataFrame:
    """WIN1: rank #1..n in agent-performance order (window over <= 50 rows)."""
    ap = A.agent_performance(t, top_n=top_n, **filters)
    w = Window.orderBy(*A.agent_order())
    return ap.select(F.row_number().over(w).alias("rank"), "agent_id", "contact_name",
                     "company_name", "city_name", "total_listings", "total_sales_value",
                     X.format_price("total_sales_value").alias("sales_label"))


def price_labels(listings: DataFrame) -> DataFrame:
    """FN3 over a listing set."""
    return listings.select("listing_id", "price_inr", X.format_price("price_inr").alias("price_label"))


def display_labels(listings: DataFrame) -> DataFrame:
    """FN4/FN5 + JN11: code labels and formatted numbers per listing."""
    return listings.select(
        "listing_id",
        X.transact_label("transact_type").alias("transact_label"),
        X.furnish_label("furnish_id").alias("furnish_label"),
        X.bhk_label("bedroom_num").alias("bhk_label"),
        X.date_label("register_date").alias("register_label"),
        F.when(F.col("price_sqft").isNull() | (F.col("price_sqft") == 0), F.lit("—"))
         .otherwise(F.concat(F.lit("₹"), X.format_number("price_sqft"), F.lit("/sqft"))).alias("sqft_label"),
    )
