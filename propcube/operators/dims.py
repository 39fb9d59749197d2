"""Dimension and fact maintenance for ingest (DIM1-DIM6, JN8, SNK1).

Each operator takes the current table(s) plus the cleaned ingest frame and
returns the new table; nothing is updated in place. Surrogate ids (DIM5)
are dense and ordered without a global window: rows are range-partitioned
by the ordering key, numbered within their partition, and shifted by the
sizes of the partitions before them (a frame with one row per partition).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.functions.exprs import hash_u32
from propcube.session import materialize
from propcube.sources.stored import StoredTable


# -- DIM5 --------------------------------------------------------------------

def assign_ids(df: DataFrame, id_col: str, start: Column | int, order: list[str], keep_order: bool = True,
               path: str | None = None) -> DataFrame:
    """Dense ids ``start + 1, start + 2, ...`` following ``order``.

    ``start`` may be a scalar Column (e.g. the current max id). One range
    shuffle; rows are numbered within their partition where they lie, and
    written with partition and number, so that the counts and the rows read
    afterwards are the same ones however often they are read. They are written
    at ``path``, if given (the caller removes it), and without the columns of
    ``order`` unless ``keep_order``.
    """
    cols = [F.col(c) for c in order]
    # the lower 33 bits of the monotonic id count rows within a partition
    numbered = (df.repartitionByRange(*cols).sortWithinPartitions(*cols)
                .withColumn("_mid", F.monotonically_increasing_id())
                .withColumn("_pid", F.shiftright("_mid", 33))
                .withColumn("_rn", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_mid"))
    numbered = materialize(numbered if keep_order else numbered.drop(*order), "ids", path, "zstd")
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per shuffle partition, whatever the number of rows
    offsets = counts.select("_pid", F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"))
    start_col = start if isinstance(start, Column) else F.lit(start)
    return (numbered.join(F.broadcast(offsets), "_pid")
                    .withColumn(id_col, (start_col + F.coalesce(F.col("_off"), F.lit(0)) + F.col("_rn")).cast("bigint"))
                    .drop("_pid", "_rn", "_off"))


def _max_id(df: DataFrame, id_col: str) -> Column:
    return F.coalesce(df.select(F.max(id_col)).scalar(), F.lit(0))


# -- DIM1 --------------------------------------------------------------------

def upsert_cities(cities: DataFrame, names: DataFrame) -> DataFrame:
    """DIM1: add configured city names that are not present yet."""
    new = (names.select(F.col("city_name")).where(F.col("city_name").isNotNull()).distinct()
                .join(cities.select("city_name"), "city_name", "left_anti"))
    new = assign_ids(new, "city_id", _max_id(cities, "city_id"), ["city_name"])
    new = new.select("city_id", "city_name", F.substring("city_name", 1, 3).alias("city_code"))
    return cities.select("city_id", "city_name", "city_code").unionByName(new)


# -- DIM2 --------------------------------------------------------------------

def upsert_localities(localities: DataFrame, clean: DataFrame, cities: DataFrame) -> DataFrame:
    """DIM2: (locality_name, city) first seen; insert new, and for existing
    keys fill lat/lng from the batch: ``coalesce(new, old)``. Blank names
    and unknown cities are skipped."""
    first = (clean.where((F.col("locality_name").isNotNull()) & (F.col("locality_name") != ""))
                  .groupBy("locality_name", "city_name")
                  .agg(F.min_by(F.struct("latitude", "longitude", "source_rank", "row_id"),
                                F.struct("source_rank", "row_id")).alias("_f")))
    cand = (first.join(cities.select("city_id", "city_name"), "city_name")
                 .select("locality_name", "city_id", F.col("_f.latitude").alias("n_lat"),
                         F.col("_f.longitude").alias("n_lng"), F.col("_f.source_rank").alias("_sr"),
                         F.col("_f.row_id").alias("_ri")))
    old = localities.select("locality_id", "locality_name", "city_id", "latitude", "longitude")
    merged = old.join(cand, ["locality_name", "city_id"], "full")
    kept = merged.where(F.col("locality_id").isNotNull()).select(
        "locality_id", "locality_name", "city_id",
        F.coalesce("n_lat", "latitude").alias("latitude"),
        F.coalesce("n_lng", "longitude").alias("longitude"))
    new = merged.where(F.col("locality_id").isNull()).select(
        "locality_name", "city_id", F.col("n_lat").alias("latitude"), F.col("n_lng").alias("longitude"),
        "_sr", "_ri")
    new = assign_ids(new, "locality_id", _max_id(localities, "locality_id"), ["_sr", "_ri"]).drop("_sr", "_ri")
    return kept.unionByName(new.select(*kept.columns))


# -- DIM3 --------------------------------------------------------------------

def insert_buildings(buildings: DataFrame, clean: DataFrame, localities: DataFrame,
                     cities: DataFrame) -> DataFrame:
    """DIM3: buildings with a positive id, first row per id wins, locality
    resolved through (name, city); existing ids are kept as they are."""
    first = (clean.where(F.col("building_id").isNotNull())
                  .groupBy("building_id")
                  .agg(F.min_by(F.struct("building_name", "society_name", "locality_name", "city_name",
                                         "total_floors_bld"),
                                F.struct("source_rank", "row_id")).alias("_f"))
                  .select("building_id", "_f.*"))
    cid = first.join(cities.select("city_id", "city_name"), "city_name", "left")
    loc = localities.select("locality_id", "locality_name", "city_id")
    resolved = cid.join(loc, ["locality_name", "city_id"], "left")
    new = resolved.join(buildings.select("building_id"), "building_id", "left_anti").select(
        "building_id", "building_name", "society_name", "locality_id",
        F.col("total_floors_bld").alias("total_floors"))
    return buildings.select(*S.BUILDINGS.fieldNames()).unionByName(new)


# -- DIM4 --------------------------------------------------------------------

def upsert_agents(agents: DataFrame, clean: DataFrame) -> DataFrame:
    """DIM4: trimmed names; blank / 'nan' / 'none' skipped; one agent per
    case-insensitive (name, company), first seen; existing keys not re-added."""
    name = F.col("contact_name")
    company = F.coalesce(F.col("company_name"), F.lit(""))
    cand = (clean.where(name.isNotNull() & ~F.lower(name).isin("", "nan", "none"))
                 .select(name.alias("contact_name"), F.nullif(company, F.lit("")).alias("company_name"),
                         F.lower(name).alias("_kn"), F.lower(company).alias("_kc"), "source_rank", "row_id")
                 .groupBy("_kn", "_kc")
                 .agg(F.min_by(F.struct("contact_name", "company_name", "source_rank", "row_id"),
                               F.struct("source_rank", "row_id")).alias("_f"))
                 .select("_kn", "_kc", "_f.*"))
    existing_keys = agents.select(F.lower("contact_name").alias("_kn"),
                                  F.lower(F.coalesce("company_name", F.lit(""))).alias("_kc"))
    new = cand.join(existing_keys, ["_kn", "_kc"], "left_anti")
    new = assign_ids(new, "agent_id", _max_id(agents, "agent_id"), ["source_rank", "row_id"])
    new = new.select("agent_id", "contact_name", "company_name",
                     F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("email"),
                     F.lit(True).alias("is_active"), F.current_timestamp().alias("created_at"))
    return agents.select(*S.AGENTS.fieldNames()).unionByName(new)


def agent_name_map(agents: DataFrame) -> DataFrame:
    """Exact contact_name -> agent id (deterministic: the highest id)."""
    return agents.where(F.col("contact_name").isNotNull()).groupBy("contact_name") \
        .agg(F.max("agent_id").alias("agent_id"))


# -- JN8 ---------------------------------------------------------------------

def _left_on_known(df: DataFrame, table: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Left join that spreads rows without a key: a NULL or blank key matches
    nothing, so those rows get a random negative partner key instead of all
    meeting in one task."""
    blank = F.lit(False)
    for c in left:
        blank = blank | F.col(c).isNull() | (F.col(c).cast("string") == "")
    salt = F.when(blank, F.xxhash64("source_rank", "row_id")).otherwise(F.lit(0))
    on = F.col("_salt") == F.col("_zero")
    for x, y in zip(left, right):
        on = on & F.when(blank, F.lit(None)).otherwise(F.col(x)).eqNullSafe(F.col(y))
    return df.withColumn("_salt", salt).join(table.withColumn("_zero", F.lit(0).cast("bigint")), on, "left") \
        .drop("_salt", "_zero")


def resolve_fks(clean: DataFrame, cities: DataFrame, localities: DataFrame, buildings: DataFrame,
                agents: DataFrame) -> DataFrame:
    """JN8: names -> ids. No city -> row dropped; other misses -> NULL."""
    c = cities.select("city_id", "city_name")
    loc = localities.select("locality_id", F.col("locality_name").alias("_ln"), F.col("city_id").alias("_lc"))
    b = buildings.select(F.col("building_id").alias("_bid")).where(F.col("_bid").isNotNull())
    a = agent_name_map(agents).withColumnRenamed("contact_name", "_cn")
    j = clean.join(c, "city_name")
    j = _left_on_known(j, loc, ["locality_name", "city_id"], ["_ln", "_lc"])
    j = _left_on_known(j, b, ["building_id"], ["_bid"])
    j = _left_on_known(j, a, ["contact_name"], ["_cn"])
    return j.withColumn("building_id", F.col("_bid")).drop("_bid", "_cn", "_ln", "_lc")


# -- SNK1 / JN10 -----------------------------------------------------------------

def append_listings(table: StoredTable, resolved: DataFrame, batch_ts: str) -> None:
    """SNK1 as a sink: the new rows of a batch are appended to a table that is
    bucketed by ``prop_id``; a batch that is appended again adds nothing."""
    table.append(new_listings(table.read(), resolved, batch_ts))


def insert_if_absent(listings: DataFrame, resolved: DataFrame, batch_ts: str,
                     columns: list[str] | None = None) -> DataFrame:
    """SNK1: the table with the listings whose prop_id is new (existing rows
    win); of its columns those that ``columns`` names, or all."""
    cols = columns or [n for n, _ in S.LISTING_COLUMNS]
    return listings.select(*cols).unionByName(new_listings(listings, resolved, batch_ts, cols))


def new_listings(listings: DataFrame, resolved: DataFrame, batch_ts: str,
                 columns: list[str] | None = None) -> DataFrame:
    """JN10: the rows whose prop_id is not stored yet, with fresh dense listing
    ids in (file, row) order. Of a table bucketed by ``prop_id`` only the
    column itself is read, where it lies. Only the ``columns`` asked for go
    through the numbering, which writes its rows."""
    types = dict(S.LISTING_COLUMNS)
    cols = columns or list(types)
    new = resolved.join(listings.select("prop_id"), "prop_id", "left_anti")
    order = ["source_rank", "row_id"]
    new = new.select(*order, *[c for c in cols if c in new.columns and c not in order])
    new = assign_ids(new, "listing_id", _max_id(listings, "listing_id"), order)
    ts = F.lit(batch_ts).cast("timestamp")
    set_here = {"is_active": F.lit(True), "created_at": ts, "updated_at": ts}
    return new.select(*[set_here.get(n, F.col(n).cast(types[n]) if n in new.columns else F.lit(None).cast(types[n]))
                        .alias(n) for n in cols])


# -- DIM6 --------------------------------------------------------------------

def synth_transactions(listings: DataFrame, rate: float = S.SYNTH_TXN_RATE,
                       minimum: int = S.SYNTH_TXN_MIN) -> DataFrame:
    """DIM6: one synthetic deal for a hash-chosen ~12 % of listings.

    Every draw is a hash of (listing_id, salt), so the result is the same on
    every run and executor. If fewer than ``minimum`` are picked, exactly
    ``min(n, max(minimum, int(n * rate)))`` listings with the smallest pick
    hash are used instead (a distributed top-k, not a collect).
    """
    l = listings.where(F.col("price_inr") > 0).select("listing_id", "price_inr", "register_date")
    u = hash_u32("listing_id", F.lit("pick"))
    picked = l.where(u < F.lit(int(rate * 2 ** 32)))
    n_picked = picked.count()
    if n_picked < minimum:
        n = l.count()
        k = min(n, max(minimum, int(n * rate)))
        picked = l.withColumn("_u", u).orderBy("_u", "listing_id").limit(k).drop("_u")
    h = lambda salt: hash_u32("listing_id", F.lit(salt))
    variance = (F.lit(Decimal("0.92")) + (h("var") % 16001).cast("decimal(10,0)") * F.lit(Decimal("0.00001")))
    offset = (F.lit(S.SYNTH_DAYS_LO) + h("days") % (S.SYNTH_DAYS_HI - S.SYNTH_DAYS_LO + 1)).cast("int")
    fallback_date = F.make_date((F.lit(2022) + h("y") % 2).cast("int"), (F.lit(1) + h("m") % 12).cast("int"),
                                (F.lit(1) + h("d") % 28).cast("int"))
    first = F.element_at(F.array(*[F.lit(x) for x in S.BUYER_FIRST]), (h("first") % 16 + 1).cast("int"))
    last = F.element_at(F.array(*[F.lit(x) for x in S.BUYER_LAST]), (h("last") % 16 + 1).cast("int"))
    own = F.element_at(F.array(*[F.lit(x) for x in S.OWNERSHIP_TYPES]), (h("own") % 4 + 1).cast("int"))
    roll = h("status") % 100
    status = F.when(roll < 80, "Completed").when(roll < 95, "Pending").otherwise("Cancelled")
    return picked.select(
        F.concat(F.lit("S"), F.col("listing_id").cast("string")).alias("txn_id"),
        "listing_id",
        F.round(F.col("price_inr") * variance, 2).cast(S.MONEY).alias("sale_price"),
        F.coalesce(F.date_add("register_date", offset), fallback_date).alias("transaction_date"),
        F.concat(first, F.lit(" "), last).alias("buyer_name"),
        own.alias("ownership_type"),
        status.alias("status"),
        F.lit(None).cast("string").alias("notes"),
    )
