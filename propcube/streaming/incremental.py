"""S2: monthly price trends (AGG7) kept up to date by signed changes.

A change of a listing is its old image with ``sign`` -1 and its new one with
+1. Counts and exact sums of a (city, month) take signed rows as they are.
Extremes do too as long as they are known: a group keeps its ``TAIL`` smallest
and largest prices with their counts and, if there are more, the price up to
which the list is complete. A price beyond that is counted but not listed; a
deleted price is taken from the list. Only when a list has run dry are that
group's prices counted anew from the listings, so a batch reads its own rows
and the small state, never the table.

The state is a plain table partitioned by city, one row for each city and
month; a batch rewrites the partitions of its cities. Each row notes the last
batch that it took from each stream (by the id in the stream's checkpoint), so
a repeated batch changes nothing, whichever partitions it had reached, and a new
checkpoint or a second stream counts on its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propcube import schemas as S
from propcube.functions import exprs as X
from propcube.operators import analytics as A
from propcube.session import exists, materialize
from propcube.sources.buckets import read_partitions, touched, write_partitions

KEYS = ["city_name", "month"]
TAIL = 16
_PRICES = T.ArrayType(T.StructType([T.StructField("price", S.MONEY), T.StructField("n", T.LongType())]))
_SUM = T.DecimalType(38, 0)
STATE = T.StructType([
    T.StructField("month", T.DateType()), T.StructField("listing_count", T.LongType()), T.StructField("u_sqft", _SUM),
    T.StructField("c_sqft", T.LongType()), T.StructField("u_price", _SUM),
    T.StructField("lows", _PRICES), T.StructField("lows_to", S.MONEY),
    T.StructField("highs", _PRICES), T.StructField("highs_to", S.MONEY),
    T.StructField("applied", T.MapType(T.StringType(), T.LongType())), T.StructField("city_name", T.StringType())])
SUMS = ["listing_count", "u_sqft", "c_sqft", "u_price"]
#: stream name of a starting snapshot
SNAPSHOT = "snapshot"


def signed_images(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old and new images of changed listings as signed rows."""
    return before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))


def by_price(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Signed counts and sums of AGG7's rows by (city, month, price)."""
    sign = F.col("sign").cast("long") if "sign" in rows.columns else F.lit(1).cast("long")
    kept = rows.withColumn("sign", sign).where(X.all_of(
        A.market_band() + [F.col("register_date").isNotNull(), F.col("transact_type") == 1]))
    g = kept.groupBy("city_id", F.trunc("register_date", "MM").alias("month"), F.col("price_inr").cast(S.MONEY).alias("price")).agg(
        F.sum("sign").alias("n"), F.sum(X.units("price_sqft", 2) * F.col("sign")).cast(_SUM).alias("u_sqft"),
        F.sum(F.when(F.col("price_sqft").isNotNull(), F.col("sign"))).alias("c_sqft"))
    return g.join(cities.select("city_id", "city_name"), "city_id").groupBy(*KEYS, "price").agg(
        *[F.sum(c).cast(t).alias(c) for c, t in (("n", "long"), ("u_sqft", _SUM), ("c_sqft", "long"))])


def _tail(known: DataFrame, delta: DataFrame, side: str) -> DataFrame:
    """(keys, side, side_to) after the signed prices of ``delta``."""
    order = F.asc("price") if side == "lows" else F.desc("price")
    to = f"{side}_to"
    inside = F.col(to).isNull() | ((F.col("price") <= F.col(to)) if side == "lows" else (F.col("price") >= F.col(to)))
    listed = known.select(*KEYS, F.explode(side).alias("e")).select(*KEYS, "e.price", "e.n")
    rows = (listed.unionByName(delta.select(*KEYS, "price", "n")).groupBy(*KEYS, "price").agg(F.sum("n").alias("n"))
            .where("n <> 0").join(known.select(*KEYS, to), KEYS, "left").where(inside))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(order))).where(F.col("r") <= TAIL + 1)
    got = first.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("r", "price", "n"))).alias("t"), F.max(to).alias("_to"))
    return got.select(*KEYS, F.transform(F.slice("t", 1, TAIL), lambda e: F.struct(e["price"], e["n"])).cast(_PRICES).alias(side),
                      F.when(F.size("t") > TAIL, F.get("t", F.lit(TAIL - 1))["price"]).otherwise(F.col("_to")).alias(to))


def merge(state: DataFrame, delta: DataFrame, stream: str, batch: int) -> DataFrame:
    """State rows of all keys of ``state`` and ``delta``; a row that has taken
    this batch of this stream already stays as it is."""
    taken = F.coalesce(F.element_at("applied", F.lit(stream)) >= batch, F.lit(False))
    fresh = delta.join(state.where(taken).select(*KEYS), KEYS, "left_anti")
    add = fresh.groupBy(*KEYS).agg(
        F.sum("n").alias("d_listing_count"), F.sum("u_sqft").alias("d_u_sqft"), F.sum("c_sqft").alias("d_c_sqft"),
        F.sum(X.units("price", 2) * F.col("n")).cast(_SUM).alias("d_u_price"))
    known = state.join(add.select(*KEYS), KEYS, "left_semi")
    out = state.withColumnsRenamed({c: f"o_{c}" for c in ("lows", "lows_to", "highs", "highs_to")}).join(add, KEYS, "full")
    for side in ("lows", "highs"):
        out = out.join(_tail(known, fresh, side), KEYS, "left")
    hit = F.col("d_listing_count").isNotNull()
    sums = [(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"d_{c}"), F.lit(0))).cast(STATE[c].dataType).alias(c) for c in SUMS]
    sides = [F.when(hit, F.coalesce(F.col(s), F.array().cast(_PRICES))).otherwise(F.col(f"o_{s}")).alias(s) for s in ("lows", "highs")]
    # a list without rows left keeps its limit: what lies beyond is not known
    ends = [F.when(hit & F.col(s).isNotNull(), F.col(f"{s}_to")).otherwise(F.col(f"o_{s}_to")).alias(f"{s}_to") for s in ("lows", "highs")]
    old = F.coalesce("applied", F.create_map().cast(STATE["applied"].dataType))
    note = F.map_concat(F.map_filter(old, lambda k, _: k != stream), F.create_map(F.lit(stream), F.lit(batch).cast("long")))
    return out.select("city_name", "month", *sums, *sides, *ends, F.when(hit, note).otherwise(old).alias("applied")).select(
        *STATE.fieldNames())


def _extreme(side: str):
    return F.get(F.filter(side, lambda e: e["n"] > 0), F.lit(0))["price"]


def apply_signed(spark: SparkSession, state_dir: str, rows: DataFrame, cities: DataFrame, stream: str, batch: int,
                 listings: Callable[[], DataFrame] | None = None) -> None:
    """Take one batch of signed listing rows into the state. ``listings`` gives
    the listings after the batch; it is asked only for groups whose list of
    extremes has run dry."""
    delta = materialize(by_price(rows, cities), "trend-changes")
    names = touched(delta, "city_name")
    if not names:
        return
    state = _state(spark, state_dir).where(F.col("city_name").isin(names))
    merged = materialize(merge(state, delta, stream, batch), "trend-state")
    dry = merged.where("listing_count > 0").where(_extreme("lows").isNull() | _extreme("highs").isNull()).select(*KEYS)
    if dry.limit(1).count():
        if listings is None:
            raise ValueError("the known extremes of a group are used up; give the listings to count them anew")
        merged = _recounted(merged, dry, listings(), cities)
    write_partitions(merged, state_dir, ["city_name"])


def _recounted(merged: DataFrame, dry: DataFrame, listings: DataFrame, cities: DataFrame) -> DataFrame:
    """``merged`` with the extremes of the ``dry`` groups counted anew."""
    ids = dry.join(cities.select("city_id", "city_name"), "city_name").select("city_id", "month")
    rows = listings.withColumn("month", F.trunc("register_date", "MM")).join(ids, ["city_id", "month"], "left_semi").drop("month")
    prices = materialize(by_price(rows, cities), "trend-recount")
    none = merged.limit(0)
    new = _tail(none, prices, "lows").join(_tail(none, prices, "highs"), KEYS)
    sides = ["lows", "lows_to", "highs", "highs_to"]
    kept = merged.join(dry, KEYS, "left_anti")
    return kept.unionByName(merged.join(dry, KEYS, "left_semi").drop(*sides).join(new, KEYS).select(*STATE.fieldNames()))


def _state(spark: SparkSession, state_dir: str) -> DataFrame:
    if not exists(spark, state_dir):
        return spark.createDataFrame([], STATE)
    return read_partitions(spark, state_dir, STATE)


def read_partials(spark: SparkSession, state_dir: str) -> DataFrame:
    """Counts, sums and extremes of each city and month that has listings."""
    if not exists(spark, state_dir):
        raise FileNotFoundError(f"no partials under {state_dir}")
    return _state(spark, state_dir).where("listing_count > 0").select(
        *KEYS, *SUMS, F.col("listing_count").alias("c_price"), _extreme("lows").alias("min_price_inr"),
        _extreme("highs").alias("max_price_inr"))


def finalize(p: DataFrame) -> DataFrame:
    """Partials -> the AGG7 row shape."""
    return p.select(
        *KEYS, F.col("listing_count").cast("bigint").alias("listing_count"),
        X.exact_mean_of(F.col("u_sqft"), F.col("c_sqft"), 2, S.MONEY).alias("avg_price_sqft"),
        X.exact_mean_of(F.col("u_price"), F.col("c_price"), 2, S.MONEY).alias("avg_price_inr"),
        F.col("min_price_inr").cast(S.MONEY).alias("min_price_inr"),
        F.col("max_price_inr").cast(S.MONEY).alias("max_price_inr"))


def init_partials(listings: DataFrame, cities: DataFrame, state_dir: str) -> None:
    """The partials of a starting snapshot."""
    apply_signed(listings.sparkSession, state_dir, listings, cities, SNAPSHOT, 0)


def stream_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """The id that Spark gave the stream of a checkpoint."""
    return json.loads("".join(r[0] for r in spark.read.text(f"{checkpoint_dir}/metadata").collect()))["id"]


def run_incremental(spark: SparkSession, source_dir: str, schema, state_dir: str, checkpoint_dir: str, cities: DataFrame,
                    max_files_per_trigger: int = 1, listings: Callable[[], DataFrame] | None = None) -> None:
    """Drain a stream of listing rows into the partials. Rows are inserts, or
    signed images where ``schema`` has a column ``sign``."""
    def take(batch: DataFrame, batch_id: int) -> None:
        apply_signed(spark, state_dir, batch, cities, stream_id(spark, checkpoint_dir), batch_id, listings)

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    q = (stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
