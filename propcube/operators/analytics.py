"""Market analytics (AGG1-AGG6) and dimension listings (SRT4).

Plan shape used throughout: filter the listings fact at the scan, aggregate
on integer ids first (map-side partial aggregation, so a hot city or agent
never lands in one task), and only then join the bounded dimensions for
names. Averages use the exact integer rounding of ``exprs.exact_avg``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propcube import schemas as S
from propcube.functions import exprs as X
from propcube.sources.bridge import Tables

SUM_MONEY = T.DecimalType(38, 2)
AVG_AREA = T.DecimalType(18, 1)


def _date_preds(c: str, date_from: str | None, date_to: str | None) -> list[Column]:
    """Inclusive date range; NULL dates drop out once a bound is given."""
    preds = []
    if date_from is not None:
        preds.append(F.col(c) >= F.lit(date_from).cast("date"))
    if date_to is not None:
        preds.append(F.col(c) <= F.lit(date_to).cast("date"))
    return preds


def market_band() -> list[Column]:
    """FIL7: 0 < price_sqft < 100000."""
    return [F.col("price_sqft") > 0, F.col("price_sqft") < S.PRICE_SQFT_MAX]


def _cities_named(t: Tables, city_name: str | None) -> DataFrame:
    c = t.cities.select("city_id", "city_name")
    return c if city_name is None else c.where(F.col("city_name") == city_name)


def _restrict_city(l: DataFrame, t: Tables, city_name: str | None) -> DataFrame:
    """Keep listings of one named city (broadcast semi-join at the scan)."""
    if city_name is None:
        return l
    return l.join(_cities_named(t, city_name).select("city_id"), "city_id", "left_semi")


def _avg_cols() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("listing_count"),
        X.exact_avg("price_sqft").alias("avg_price_sqft"),
        X.exact_avg("price_inr").alias("avg_price_inr"),
    ]


# -- AGG1 --------------------------------------------------------------------

def summary(t: Tables, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """One-row KPI summary. Takes no city filter (by design of the source)."""
    l = (t.listings
         .where(X.all_of([F.col("price_inr") > 0] + _date_preds("register_date", date_from, date_to)))
         .select("city_id", "locality_id", "is_active", "price_inr", "price_sqft"))
    # Stage 1: partial sums per (city, locality) -> a tiny frame.
    per_geo = l.groupBy("city_id", "locality_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_active")).alias("n_active"),
        F.sum(X.units("price_inr", 2)).alias("u_price"), F.count("price_inr").alias("c_price"),
        F.sum(X.units("price_sqft", 2)).alias("u_sqft"), F.count("price_sqft").alias("c_sqft"),
    )
    tx = t.transactions.where(X.all_of(
        [F.col("status") == "Completed"] + _date_preds("transaction_date", date_from, date_to)))
    # One scalar subquery (one scan of the deals) carrying both figures.
    txn = tx.select(F.struct(F.count(F.lit(1)).alias("n"),
                             X.exact_sum("sale_price", SUM_MONEY).alias("s"))).scalar()
    txn_count, txn_sum = txn.getField("n"), txn.getField("s")
    active = F.col("n_active") > 0
    return per_geo.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_listings"),
        F.coalesce(F.sum("n_active"), F.lit(0)).cast("bigint").alias("active_listings"),
        X.exact_mean_of(F.sum("u_price"), F.sum("c_price"), 2, S.MONEY).alias("avg_price_inr"),
        X.exact_mean_of(F.sum("u_sqft"), F.sum("c_sqft"), 2, S.MONEY).alias("avg_price_sqft"),
        F.count_distinct(F.when(active, F.col("city_id"))).alias("cities_covered"),
        F.count_distinct(F.when(active, F.col("locality_id"))).alias("localities_covered"),
    ).select("*", txn_count.alias("total_transactions"), txn_sum.alias("total_sales_value"))


# -- AGG2 --------------------------------------------------------------------

def price_trends(t: Tables, city_name: str | None = None, date_from: str | None = None,
                 date_to: str | None = None) -> DataFrame:
    """Monthly sale-listing prices per city, ordered by month, city."""
    l = t.listings.where(X.all_of(
        market_band() + [F.col("register_date").isNotNull(), F.col("transact_type") == 1]
        + _date_preds("register_date", date_from, date_to)))
    l = _restrict_city(l, t, city_name)
    g = (l.groupBy("city_id", F.trunc("register_date", "MM").alias("month_start"))
          .agg(*_avg_cols()))
    return (g.join(_cities_named(t, city_name), "city_id")
             .select("city_name", F.date_format("month_start", "yyyy-MM").alias("month"),
                     "listing_count", "avg_price_sqft", "avg_price_inr")
             .orderBy("month", "city_name"))


# -- AGG3 --------------------------------------------------------------------

def _locality_groups(t: Tables, city_name: str | None, property_type: str | None,
                     date_from: str | None, date_to: str | None) -> DataFrame:
    l = t.listings.where(X.all_of(
        market_band() + [F.col("is_active"), F.col("locality_id").isNotNull()]
        + ([X.contains_ci("property_type", property_type)] if property_type is not None else [])
        + _date_preds("register_date", date_from, date_to)))
    l = _restrict_city(l, t, city_name)
    g = l.groupBy("city_id", "locality_id", "property_type").agg(
        *_avg_cols(), X.exact_avg("min_area_sqft", 4, 1, AVG_AREA).alias("avg_area_sqft"))
    loc = t.localities.select("locality_id", "locality_name", "latitude", "longitude")
    return (g.join(_cities_named(t, city_name), "city_id").join(loc, "locality_id")
             .select("city_name", "locality_name", "locality_id", "property_type",
                     "listing_count", "avg_price_sqft", "avg_price_inr", "avg_area_sqft",
                     "latitude", "longitude"))


def locality_order() -> list[Column]:
    return [F.col("listing_count").desc(), F.col("city_name").asc(),
            F.col("locality_id").asc(), F.col("property_type").asc_nulls_last()]


def locality_demand(t: Tables, city_name: str | None = None, property_type: str | None = None,
                    top_n: int = 20, date_from: str | None = None,
                    date_to: str | None = None) -> DataFrame:
    """Top-n (city, locality, type) groups by listing count."""
    if not 5 <= top_n <= 100:
        raise ValueError("top_n must be within 5..100")
    g = _locality_groups(t, city_name, property_type, date_from, date_to)
    return g.orderBy(*locality_order()).limit(top_n)


# -- AGG4 --------------------------------------------------------------------

def property_distribution(t: Tables, city_name: str | None = None, date_from: str | None = None,
                          date_to: str | None = None) -> DataFrame:
    l = t.listings.where(X.all_of(
        market_band() + [F.col("is_active"), F.col("property_type").isNotNull()]
        + _date_preds("register_date", date_from, date_to)))
    l = _restrict_city(l, t, city_name)
    g = l.groupBy("city_id", "property_type").agg(*_avg_cols())
    return (g.join(_cities_named(t, city_name), "city_id")
             .select("city_name", "property_type", "listing_count", "avg_price_sqft", "avg_price_inr")
             .orderBy(F.col("listing_count").desc(), "city_name", "property_type"))


# -- AGG5 --------------------------------------------------------------------

def _txn_stats_per_listing(t: Tables, date_from: str | None, date_to: str | None) -> tuple[DataFrame, list]:
    """Transactions pre-aggregated to one row per listing.

    With a date filter the row predicate mixes a transaction column and a
    listing column, so the sums are kept per class of
    (transaction_date >= from, transaction_date <= to); the listing side
    then decides per class. This keeps the result exact while no shuffle
    ever carries more than one row per listing, however skewed the deals.
    """
    td = F.col("transaction_date")
    a = td >= F.lit(date_from).cast("date") if date_from is not None else F.lit(True)
    b = td <= F.lit(date_to).cast("date") if date_to is not None else F.lit(True)
    classes = [(x, y) for x in ((True, False) if date_from is not None else (True,))
               for y in ((True, False) if date_to is not None else (True,))]
    aggs = []
    for x, y in classes:
        cond = (a == F.lit(x)) & (b == F.lit(y))
        tag = f"{int(x)}{int(y)}"
        aggs += [
            # txn_id is a non-null primary key: counting rows == COUNT(DISTINCT txn_id),
            # without materialising the key.
            F.count_if(cond).alias(f"n_{tag}"),
            F.sum(F.when(cond, F.col("sale_price"))).alias(f"s_{tag}"),
            F.sum(F.when(cond, X.units("sale_price", 2))).alias(f"u_{tag}"),
            F.count(F.when(cond, F.col("sale_price"))).alias(f"c_{tag}"),
        ]
    stats = t.transactions.select("listing_id", "sale_price", "transaction_date") \
        .groupBy("listing_id").agg(*aggs)
    return stats, classes


def _agent_listing_rows(t: Tables, city_name: str | None, date_from: str | None,
                        date_to: str | None, keep_unmatched_city: bool) -> DataFrame:
    """Per listing: agent, city and the deal sums that pass the filters."""
    l = t.listings.select("listing_id", "agent_id", "city_id", "register_date") \
        .where(F.col("agent_id").isNotNull())
    cities = _cities_named(t, city_name)
    how = "left" if (city_name is None and keep_unmatched_city) else "inner"
    l = l.join(cities, "city_id", how)
    stats, classes = _txn_stats_per_listing(t, date_from, date_to)
    j = l.join(stats, "listing_id", "left")
    rd = F.col("register_date")

    def passes(x: bool, y: bool) -> Column:
        p1 = F.lit(True) if date_from is None else (F.lit(x) | (rd >= F.lit(date_from).cast("date")))
        p2 = F.lit(True) if date_to is None else (F.lit(y) | (rd <= F.lit(date_to).cast("date")))
        return F.coalesce(p1 & p2, F.lit(False))

    def total(prefix: str, only_passing: bool) -> Column:
        parts = []
        for x, y in classes:
            v = F.coalesce(F.col(f"{prefix}_{int(x)}{int(y)}"), F.lit(0))
            parts.append(F.when(passes(x, y), v).otherwise(F.lit(0)) if only_passing else v)
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    def total_nullable(prefix: str) -> Column:
        # SUM over passing classes, NULL when no passing class has a value.
        vals = [F.when(passes(x, y), F.col(f"{prefix}_{int(x)}{int(y)}")) for x, y in classes]
        any_value = vals[0].isNotNull()
        summed = F.coalesce(vals[0], F.lit(0))
        for v in vals[1:]:
            any_value = any_value | v.isNotNull()
            summed = summed + F.coalesce(v, F.lit(0))
        return F.when(any_value, summed.cast(SUM_MONEY))

    n_all = total("n", False)
    n_pass = total("n", True)
    # A listing with deals is kept if one of its deal rows passes; one
    # without deals is a single NULL-deal row judged on register_date alone.
    no_deal_pass = F.coalesce(
        X.all_of(_date_preds("register_date", date_from, date_to)), F.lit(False))
    keep = F.when(n_all > 0, n_pass > 0).otherwise(no_deal_pass)
    return j.select(
        "agent_id", "listing_id", "city_name", keep.alias("keep"),
        n_pass.alias("n_txn"), total_nullable("s").alias("s_sale"),
        total("u", True).alias("u_sale"), total("c", True).alias("c_sale"),
    ).where("keep")


def agent_performance(t: Tables, city_name: str | None = None, top_n: int = 15,
                      date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Top agents by deal count then deal value (every deal status counts)."""
    if not 5 <= top_n <= 50:
        raise ValueError("top_n must be within 5..50")
    rows = _agent_listing_rows(t, city_name, date_from, date_to, keep_unmatched_city=True)
    per_agent = rows.groupBy("agent_id").agg(
        F.max("city_name").alias("city_name"),
        F.count(F.lit(1)).alias("total_listings"),
        F.sum("n_txn").cast("bigint").alias("total_transactions"),
        F.sum("s_sale").cast(SUM_MONEY).alias("total_sales_value"),
        X.exact_mean_of(F.sum("u_sale"), F.sum("c_sale"), 2, S.MONEY).alias("avg_sale_price"),
    )
    agents = t.agents.where(F.col("is_active")).select("agent_id", "contact_name", "company_name")
    out = per_agent.join(agents, "agent_id")  # HAVING total_listings > 0 is implied
    return (out.select("agent_id", "contact_name", "company_name", "city_name", "total_listings",
                       "total_transactions", "total_sales_value", "avg_sale_price")
               .orderBy(*agent_order()).limit(top_n))


def agent_order() -> list[Column]:
    return [F.coalesce(F.col("total_transactions"), F.lit(0)).desc(),
            F.coalesce(F.col("total_sales_value"), F.lit(0)).desc(),
            F.col("agent_id").asc()]


# -- AGG6 --------------------------------------------------------------------

def bedroom_price(t: Tables, city_name: str | None = None, date_from: str | None = None,
                  date_to: str | None = None) -> DataFrame:
    l = t.listings.where(X.all_of(
        market_band() + [F.col("bedroom_num").between(1, 6), F.col("is_active")]
        + _date_preds("register_date", date_from, date_to)))
    l = _restrict_city(l, t, city_name)
    g = l.groupBy("city_id", "bedroom_num").agg(*_avg_cols())
    return (g.join(_cities_named(t, city_name), "city_id")
             .select("city_name", "bedroom_num", "listing_count", "avg_price_sqft", "avg_price_inr")
             .orderBy("city_name", "bedroom_num"))


# -- SRT4 --------------------------------------------------------------------

def list_cities(t: Tables) -> DataFrame:
    return t.cities.select("city_id", "city_name").orderBy("city_name", "city_id")


def list_localities(t: Tables, city_id: int | None = None, limit: int = 500) -> DataFrame:
    loc = t.localities
    if city_id is not None:
        loc = loc.where(F.col("city_id") == city_id)
    return (loc.join(t.cities.select("city_id", "city_name"), "city_id")
               .select("locality_id", "locality_name", "city_id", "city_name", "latitude", "longitude")
               .orderBy(F.col("locality_name").asc_nulls_last(), "locality_id")
               .limit(limit))
