"""Stored aggregates (AGG7-AGG9), their refresh (MV1) and sink (SNK3).

A view is a parquet table written under ``<root>/views/<name>/v-<stamp>``.
Spark's commit protocol writes ``_SUCCESS`` last, so readers pick the newest
version that has it; a failed or running refresh never exposes partial
data and readers of the old version are never disturbed (no path is ever
overwritten while being read).
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.functions import exprs as X
from propcube.operators import analytics as A
from propcube.sources.bridge import Tables

VIEW_NAMES = ("mv_price_trends", "mv_locality_demand", "mv_agent_performance")


def mv_price_trends(t: Tables) -> DataFrame:
    """AGG7: monthly sale-listing prices per city with min/max, unfiltered."""
    l = t.listings.where(X.all_of(
        A.market_band() + [F.col("register_date").isNotNull(), F.col("transact_type") == 1]))
    g = l.groupBy("city_id", F.trunc("register_date", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("listing_count"),
        X.exact_avg("price_sqft").alias("avg_price_sqft"),
        X.exact_avg("price_inr").alias("avg_price_inr"),
        F.min("price_inr").cast(S.MONEY).alias("min_price_inr"),
        F.max("price_inr").cast(S.MONEY).alias("max_price_inr"),
    )
    return (g.join(t.cities.select("city_id", "city_name"), "city_id")
             .select("city_name", "month", "listing_count", "avg_price_sqft", "avg_price_inr",
                     "min_price_inr", "max_price_inr")
             .orderBy("city_name", "month"))


def mv_locality_demand(t: Tables) -> DataFrame:
    """AGG8: locality demand without the top-n cut."""
    return A._locality_groups(t, None, None, None, None)


def mv_agent_performance(t: Tables) -> DataFrame:
    """AGG9: every agent (active or not) x city of its listings.

    Agents without listings keep one row with a NULL city and zero counts.
    Deals are pre-aggregated per listing and listings per (agent, city)
    before the agent join, so no shuffle key carries more than one row per
    listing or per (agent, city) pair.
    """
    rows = A._agent_listing_rows(t, None, None, None, keep_unmatched_city=True)
    per_agent_city = rows.groupBy("agent_id", "city_name").agg(
        F.count(F.lit(1)).alias("total_listings"),
        F.sum("n_txn").cast("bigint").alias("total_transactions"),
        F.sum("s_sale").cast(A.SUM_MONEY).alias("total_sales_value"),
        F.sum("u_sale").alias("u_sale"), F.sum("c_sale").alias("c_sale"),
    )
    agents = t.agents.select("agent_id", "contact_name", "company_name")
    j = agents.join(per_agent_city, "agent_id", "left")
    return j.select(
        "agent_id", "contact_name", "company_name", "city_name",
        F.coalesce("total_listings", F.lit(0)).cast("bigint").alias("total_listings"),
        F.coalesce("total_transactions", F.lit(0)).cast("bigint").alias("total_transactions"),
        "total_sales_value",
        X.exact_mean_of(F.col("u_sale"), F.col("c_sale"), 2, S.MONEY).alias("avg_sale_price"),
    )


VIEW_BUILDERS = {
    "mv_price_trends": mv_price_trends,
    "mv_locality_demand": mv_locality_demand,
    "mv_agent_performance": mv_agent_performance,
}


# -- storage -----------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def view_dir(root: str, name: str) -> str:
    return f"{root}/views/{name}"


def write_view(df: DataFrame, root: str, name: str) -> str:
    """SNK3: write a new version; readers switch when ``_SUCCESS`` lands."""
    version = f"v-{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    path = f"{view_dir(root, name)}/{version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def current_version(spark: SparkSession, root: str, name: str) -> str | None:
    fs, base = _fs(spark, view_dir(root, name))
    if not fs.exists(base):
        return None
    done = []
    for st in fs.listStatus(base):
        p = st.getPath()
        if st.isDirectory() and p.getName().startswith("v-") and \
                fs.exists(p.suffix("/_SUCCESS")):
            done.append(p.toString())
    return max(done, key=lambda s: s.rsplit("/", 1)[-1]) if done else None


def read_view(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = current_version(spark, root, name)
    if path is None:
        raise FileNotFoundError(f"view {name} has no committed version under {root}")
    return spark.read.parquet(path)


def refresh_views(t: Tables, root: str, names: tuple[str, ...] = VIEW_NAMES) -> dict[str, list]:
    """MV1: recompute each view independently; one failure does not stop
    the others. Returns ``{"refreshed": [...], "failed": [...]}``."""
    refreshed, failed = [], []
    for name in names:
        try:
            write_view(VIEW_BUILDERS[name](t), root, name)
            refreshed.append(name)
        except Exception as e:  # reported, never swallowed silently
            failed.append(f"{name}: {type(e).__name__}: {e}")
    return {"refreshed": refreshed, "failed": failed}


def view_row_counts(spark: SparkSession, root: str, names: tuple[str, ...] = VIEW_NAMES) -> DataFrame:
    """Row count of each committed view, read back from storage."""
    frames = [read_view(spark, root, n).agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(n).alias("view_name"), "row_count") for n in names]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
