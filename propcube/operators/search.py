"""Listing / transaction / agent search, paging and enrichment.

FIL2-FIL5 compose only the supplied predicates (so parquet pushdown sees
exactly them); SRT1-SRT3 are distributed top-k (TakeOrderedAndProject:
each task keeps offset+limit rows, the driver merges) near the top and range
counts (``paging``) further down; enrichment joins
(JN5-JN7) run after the page cut when a page is requested, so they touch at
most one page of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.functions import exprs as X
from propcube.operators.paging import DEEP, SortKey
from propcube.operators.paging import page as rank_page
from propcube.sources.bridge import Tables


@dataclass(frozen=True)
class ListingFilters:
    """FIL2/FIL3 parameters; ``None`` means "not supplied". Keys may be 0."""
    is_active: bool | None = True
    city_id: int | None = None
    locality_id: int | None = None
    property_type: str | None = None
    transact_type: int | None = None
    bedroom_num: int | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_area: float | None = None
    max_area: float | None = None
    verified: bool | None = None
    search: str | None = None

    def predicates(self) -> list[Column]:
        c = F.col
        p: list[Column] = []
        if self.is_active is not None:
            p.append(c("is_active") == F.lit(self.is_active))
        if self.city_id is not None:
            p.append(c("city_id") == self.city_id)
        if self.locality_id is not None:
            p.append(c("locality_id") == self.locality_id)
        if self.property_type:
            p.append(X.contains_ci("property_type", self.property_type))
        if self.transact_type is not None:
            p.append(c("transact_type") == self.transact_type)
        if self.bedroom_num is not None:
            p.append(c("bedroom_num") == self.bedroom_num)
        if self.min_price is not None:
            p.append(c("price_inr") >= F.lit(self.min_price))
        if self.max_price is not None:
            p.append(c("price_inr") <= F.lit(self.max_price))
        if self.min_area is not None:
            p.append(c("min_area_sqft") >= F.lit(self.min_area))
        if self.max_area is not None:
            p.append(c("max_area_sqft") <= F.lit(self.max_area))
        if self.verified is not None:
            p.append(c("verified") == F.lit(self.verified))
        if self.search:
            p.append(X.contains_ci("prop_name", self.search) | X.contains_ci("description", self.search))
        return p


def filter_listings(listings: DataFrame, f: ListingFilters = ListingFilters()) -> DataFrame:
    """FIL2 + FIL3."""
    return listings.where(X.all_of(f.predicates()))


#: SRT1: newest registration first (NULL dates last), then id desc.
LISTING_KEYS = [SortKey("register_date", True), SortKey("listing_id", True)]


def listing_order() -> list[Column]:
    return [k.order() for k in LISTING_KEYS]


def enrich_listings(listings: DataFrame, t: Tables, bounded: bool = False) -> DataFrame:
    """JN5: + city_name, locality_name, agent_name (all nullable).
    ``bounded``: ``listings`` is a page of a hundred rows at most."""
    cities = t.cities.select("city_id", "city_name")
    locs = t.localities.select("locality_id", "locality_name")
    agents = t.agents.select("agent_id", F.col("contact_name").alias("agent_name"))
    if bounded:
        ids = F.broadcast(listings.select("agent_id").distinct())
        agents = F.broadcast(agents.join(ids, "agent_id", "left_semi"))  # agent_id is unique
    return (listings.join(cities, "city_id", "left")
                    .join(locs, "locality_id", "left")
                    .join(agents, "agent_id", "left")
                    .select(*S.LISTING_OUT))


def listings_page(t: Tables, f: ListingFilters = ListingFilters(), page: int = 1,
                  size: int = 20, deep: int = DEEP) -> DataFrame:
    """SRT1 page of enriched listings. A page far down is found by counting
    (``paging``); ``deep`` is the offset from which that is done."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page >= 1 and size in 1..100")
    cut = rank_page(filter_listings(t.listings, f), LISTING_KEYS, (page - 1) * size, size, deep)
    return enrich_listings(cut, t, bounded=True).orderBy(*listing_order())


def listings_count(t: Tables, f: ListingFilters = ListingFilters(), size: int = 20) -> DataFrame:
    """AGG11: total and page count for a filter (one-row aggregate)."""
    total = filter_listings(t.listings, f).agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", F.lit(size).alias("size"),
                        F.call_function("div", F.col("total") + (size - 1), F.lit(size)).alias("pages"))


def lookup_listings(t: Tables, keys: DataFrame, key: str = "listing_id") -> DataFrame:
    """FIL8: batch lookup by ``listing_id`` or ``prop_id``.

    Returns one row per distinct requested key with ``found`` and the
    enriched listing (NULLs for misses). Keys are de-duplicated map-side
    first, so a repeated hot key costs one row in the shuffle.
    """
    k = keys.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    found = t.listings.join(k, F.col(key) == F.col("_key"), "left_semi")
    hit = enrich_listings(found, t).withColumn("_key", F.col(key))
    return (k.join(hit, "_key", "left")
             .select(F.col("_key").alias("requested_key"),
                     F.col("listing_id").isNotNull().alias("found"), *S.LISTING_OUT))


def lookup_agents(t: Tables, keys: DataFrame) -> DataFrame:
    """FIL8 by ``agent_id``: one row per distinct requested key with ``found``."""
    k = keys.select(F.col("agent_id").alias("requested_key")).where(F.col("requested_key").isNotNull()).distinct()
    return k.join(t.agents, F.col("requested_key") == F.col("agent_id"), "left").select(
        "requested_key", F.col("agent_id").isNotNull().alias("found"), *S.AGENTS.fieldNames())


# -- transactions ------------------------------------------------------------

@dataclass(frozen=True)
class TxnFilters:
    listing_id: int | None = None
    city_id: int | None = None
    status: str | None = None
    date_from: str | None = None
    date_to: str | None = None


def filter_transactions(t: Tables, f: TxnFilters = TxnFilters()) -> DataFrame:
    """FIL5 (+ JN7 when a city is given)."""
    p = []
    if f.listing_id is not None:
        p.append(F.col("listing_id") == f.listing_id)
    if f.status is not None:
        p.append(F.col("status") == f.status)
    if f.date_from is not None:
        p.append(F.col("transaction_date") >= F.lit(f.date_from).cast("date"))
    if f.date_to is not None:
        p.append(F.col("transaction_date") <= F.lit(f.date_to).cast("date"))
    tx = t.transactions.where(X.all_of(p))
    if f.city_id is not None:
        in_city = t.listings.where(F.col("city_id") == f.city_id).select("listing_id")
        tx = tx.join(in_city, "listing_id", "left_semi")
    return tx


def enrich_transactions(tx: DataFrame, t: Tables, bounded: bool = False) -> DataFrame:
    """JN6: + property_type, city_name, locality_name through the listing.
    ``bounded``: ``tx`` is a page of a few hundred rows at most."""
    # semi-join first: the listings are only probed for the page's keys, a
    # bounded side that is sent to them (LIMIT), and never shuffled
    wanted = tx.select("listing_id").distinct()
    if bounded:
        wanted = F.broadcast(wanted)
    l = t.listings.select("listing_id", "property_type", "city_id", "locality_id").join(wanted, "listing_id", "left_semi")
    if bounded:
        l = F.broadcast(l)  # listing_id is unique: no more rows than the page
    return _with_place(tx.join(l, "listing_id", "left"), t).select(
        *S.TRANSACTIONS.fieldNames(), "property_type", "city_name", "locality_name")


def _with_place(df: DataFrame, t: Tables) -> DataFrame:
    """+ city_name, locality_name of the ids (nullable)."""
    cities = t.cities.select("city_id", "city_name")
    locs = t.localities.select("locality_id", "locality_name")
    return df.join(cities, "city_id", "left").join(locs, "locality_id", "left")


TXN_KEYS = [SortKey("transaction_date", True), SortKey("txn_id")]


def txn_order() -> list[Column]:
    return [k.order() for k in TXN_KEYS]


def list_transactions(t: Tables, f: TxnFilters = TxnFilters(), limit: int = 50,
                      offset: int = 0, deep: int = DEEP) -> DataFrame:
    """SRT2: newest first, paged, enriched after the cut."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit in 1..200, offset >= 0")
    cut = rank_page(filter_transactions(t, f), TXN_KEYS, offset, limit, deep)
    return enrich_transactions(cut, t, bounded=True).orderBy(*txn_order())


def lookup_transactions(t: Tables, keys: DataFrame) -> DataFrame:
    """FIL8 by ``txn_id``: one row per distinct requested key with ``found``
    and the enriched deal; only the deals that are asked for are enriched.

    Deals are dealt twice, by id and by listing. Misses go along with a key
    each (they have no listing), and a deal's id goes as the requested one."""
    k = keys.select(F.col("txn_id").alias("requested_key")).where(F.col("requested_key").isNotNull()).distinct()
    rest = [n for n in S.TRANSACTIONS.fieldNames() if n != "txn_id"]
    # where few are asked for, the keys are sent to the deals; otherwise both joins share what is dealt by id
    found = t.transactions.join(k, F.col("txn_id") == F.col("requested_key"), "left_semi")
    asked = found.join(k, F.col("txn_id") == F.col("requested_key"), "right").select(
        "requested_key", F.col("txn_id").isNotNull().alias("found"), *rest)
    l = t.listings.select(F.col("listing_id").alias("_listing"), "property_type", "city_id", "locality_id")
    spread = F.coalesce(F.col("listing_id"), F.xxhash64("requested_key"))
    asked = asked.join(l, (spread == F.col("_listing")) & F.col("listing_id").isNotNull(), "left")
    return _with_place(asked, t).select("requested_key", "found", F.when(F.col("found"), F.col("requested_key")).alias("txn_id"),
                                        *rest, "property_type", "city_name", "locality_name")


AGENT_KEYS = [SortKey("contact_name"), SortKey("agent_id")]


# -- agents --------------------------------------------------------------------

def search_agents(t: Tables, is_active: bool | None = True, search: str | None = None,
                  limit: int = 50, offset: int = 0, deep: int = DEEP) -> DataFrame:
    """FIL4 + SRT3: by contact name (NULLs last), then id."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit in 1..200, offset >= 0")
    p = []
    if is_active is not None:
        p.append(F.col("is_active") == F.lit(is_active))
    if search:
        p.append(X.contains_ci("contact_name", search) | X.contains_ci("company_name", search))
    cut = rank_page(t.agents.where(X.all_of(p)), AGENT_KEYS, offset, limit, deep)
    return cut.orderBy(*[k.order() for k in AGENT_KEYS]).select(*S.AGENTS.fieldNames())
