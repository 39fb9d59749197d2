"""DuckDB oracle SQL for every registered query.

``BRIDGE`` restates the domain-table mapping of ``propcube.sources.bridge``
as DuckDB CTEs over the driver's pre-registered source views; each oracle
query is ``WITH <BRIDGE> <query>``. The queries are written from the operator
definitions, with explicit tie-breaks.
"""

from __future__ import annotations

# Exact ROUND(AVG(x), k) for a scale-s decimal x: integer units, one division,
# half away from zero. Same arithmetic as exprs.exact_avg.


def mean_sql(total: str, n: str, in_scale: int = 2, out_scale: int = 2, typ: str = "DECIMAL(18,2)") -> str:
    """total / n in whole units of the last decimal place, half away from zero."""
    u = f"CAST({total} * {10 ** in_scale} AS HUGEINT)"
    d = f"(NULLIF({n}, 0) * {10 ** (in_scale - out_scale)})"
    q = f"((2 * abs({u}) + {d}) // (2 * {d}))"
    q = f"(CASE WHEN {u} < 0 THEN -{q} ELSE {q} END)"
    step = f"CAST({10 ** -out_scale:.{out_scale}f} AS DECIMAL({out_scale + 1},{out_scale}))"
    return f"CAST(CAST({q} AS DECIMAL(20,0)) * {step} AS {typ})"


def avg_sql(x: str, in_scale: int = 2, out_scale: int = 2, typ: str = "DECIMAL(18,2)") -> str:
    return mean_sql(f"SUM({x})", f"COUNT({x})", in_scale, out_scale, typ)


BRIDGE = """
cities AS (
  SELECT CAST(r_regionkey AS BIGINT) AS city_id, r_name AS city_name,
         substr(r_name, 1, 3) AS city_code
  FROM region),
localities AS (
  SELECT CAST(n_nationkey AS BIGINT) AS locality_id, n_name AS locality_name,
         CAST(n_regionkey AS BIGINT) AS city_id,
         CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey AS DECIMAL(10,7)) END AS latitude,
         CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey + 70 AS DECIMAL(10,7)) END AS longitude
  FROM nation),
agents AS (
  SELECT c_custkey AS agent_id, c_name AS contact_name, c_mktsegment AS company_name,
         '+91-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS phone,
         lower(replace(c_name, '#', '.')) || '@agents.example' AS email,
         c_acctbal > 0 AS is_active,
         CAST(DATE '1992-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS TIMESTAMP) AS created_at
  FROM customer),
buildings AS (
  SELECT p_partkey AS building_id, p_name AS building_name, p_brand AS society_name,
         p_partkey % 25 AS locality_id, CAST(p_size AS SMALLINT) AS total_floors
  FROM part),
listings AS (
  SELECT o_orderkey AS listing_id,
         'P' || CAST(o_orderkey AS VARCHAR) AS prop_id,
         substr(o_orderpriority, 3) AS property_type,
         CAST(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS SMALLINT) AS transact_type,
         CAST(o_orderkey % 8 AS SMALLINT) AS bedroom_num,
         CAST(o_orderkey % 5 AS SMALLINT) AS bathroom_num,
         CAST(o_orderkey % 4 AS SMALLINT) AS balcony_num,
         CAST(CASE WHEN o_orderkey % 4 = 3 THEN 4 ELSE o_orderkey % 4 END AS SMALLINT) AS furnish_id,
         CAST(o_orderkey % 30 AS SMALLINT) AS age,
         CAST(o_orderkey % 21 AS SMALLINT) AS floor_num,
         CAST(20 AS SMALLINT) AS total_floor,
         CAST(400 + (o_orderkey % 37) * 50 AS DECIMAL(12,4)) AS min_area_sqft,
         CAST(400 + (o_orderkey % 37) * 50 + (o_orderkey % 3) * 100 AS DECIMAL(12,4)) AS max_area_sqft,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price_inr,
         CASE WHEN o_orderkey % 53 = 0 THEN CAST(150000 AS DECIMAL(12,2))
              WHEN o_orderkey % 59 = 0 THEN CAST(0 AS DECIMAL(12,2))
              ELSE CAST(CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)
                             // (400 + (o_orderkey % 37) * 50) AS DECIMAL(20,0))
                        * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) END AS price_sqft,
         'Status ' || o_orderstatus || ', priority ' || o_orderpriority AS description,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'Tower ' || CAST(o_custkey AS VARCHAR) END AS prop_name,
         CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey AS DECIMAL(10,7)) END AS latitude,
         CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey + 70 AS DECIMAL(10,7)) END AS longitude,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS register_date,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 365 END AS expiry_date,
         o_orderkey % 7 = 0 AS verified,
         o_orderkey % 11 <> 0 AS is_active,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 200 END AS building_id,
         o_custkey AS agent_id,
         CAST(n_regionkey AS BIGINT) AS city_id,
         CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(n_nationkey AS BIGINT) END AS locality_id,
         CASE o_orderkey % 3 WHEN 0 THEN 'Lift, Parking' WHEN 1 THEN 'Gym, Pool' ELSE NULL END AS amenities,
         CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at
  FROM orders JOIN nation ON n_nationkey = o_orderkey % 25),
transactions AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS txn_id,
         l_orderkey AS listing_id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS sale_price,
         CAST(l_shipdate AS DATE) AS transaction_date,
         'Buyer ' || CAST(l_suppkey AS VARCHAR) AS buyer_name,
         (['Freehold', 'Leasehold', 'Co-operative Society', 'Power of Attorney'])[l_linenumber % 4 + 1] AS ownership_type,
         CASE l_returnflag WHEN 'N' THEN 'Completed' WHEN 'A' THEN 'Pending' ELSE 'Cancelled' END AS status,
         CAST(NULL AS VARCHAR) AS notes,
         CAST(l_shipdate AS TIMESTAMP) AS created_at
  FROM lineitem)
"""


def with_bridge(sql: str, extra_ctes: str = "") -> str:
    ctes = BRIDGE.strip()
    if extra_ctes:
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{sql.strip()}"


A2 = avg_sql


def _within(col: str, f: str | None, t: str | None) -> str:
    """Inclusive date range; NULL dates fall outside a given bound."""
    lo = f"{col} >= DATE '{f}'" if f else "TRUE"
    hi = f"{col} <= DATE '{t}'" if t else "TRUE"
    return f"({lo} AND {hi})"


def summary_sql(f: str | None = None, t: str | None = None) -> str:
    return with_bridge(f"""
SELECT count(*) AS total_listings,
       count(CASE WHEN is_active THEN 1 END) AS active_listings,
       {A2('price_inr')} AS avg_price_inr, {A2('price_sqft')} AS avg_price_sqft,
       count(DISTINCT CASE WHEN is_active THEN city_id END) AS cities_covered,
       count(DISTINCT CASE WHEN is_active THEN locality_id END) AS localities_covered,
       (SELECT count(*) FROM done) AS total_transactions,
       (SELECT CAST(sum(sale_price) AS DECIMAL(38,2)) FROM done) AS total_sales_value
FROM listings WHERE price_inr > 0 AND {_within('register_date', f, t)}
""", f"done AS (SELECT sale_price FROM transactions WHERE status = 'Completed' AND {_within('transaction_date', f, t)})")


def _market(table: str = "listings", f: str | None = None, t: str | None = None, more: str = "TRUE") -> str:
    """Listings with a plausible price per area."""
    return (f"(SELECT * FROM {table} WHERE price_sqft > 0 AND price_sqft < 100000 AND {more} "
            f"AND {_within('register_date', f, t)})")


PRICES = f"count(*) AS listing_count, {A2('price_sqft')} AS avg_price_sqft, {A2('price_inr')} AS avg_price_inr"


def _named(city: str | None) -> str:
    return "SELECT * FROM cities" + (f" WHERE city_name = '{city}'" if city else "")


def _trends_select(table: str = "listings", _date: str = "register_date", city: str | None = None,
                   f: str | None = None, t: str | None = None, extra: bool = True) -> str:
    month = "CAST(first_day AS DATE)" if extra else "strftime(first_day, '%Y-%m')"
    return f"""
SELECT city_name, {month} AS month, listing_count, avg_price_sqft, avg_price_inr
       {', min_price_inr, max_price_inr' if extra else ''}
FROM ({_named(city)}) JOIN (
    SELECT city_id, date_trunc('month', register_date) AS first_day, {PRICES},
           CAST(min(price_inr) AS DECIMAL(18,2)) AS min_price_inr, CAST(max(price_inr) AS DECIMAL(18,2)) AS max_price_inr
    FROM {_market(table, f, t, "transact_type = 1 AND register_date IS NOT NULL")} GROUP BY ALL
) USING (city_id)
"""


def price_trends_sql(city: str | None = None, f: str | None = None, t: str | None = None,
                     extra: bool = False) -> str:
    return with_bridge(_trends_select("listings", "register_date", city, f, t, extra))


def locality_demand_sql(city: str | None = None, ptype: str | None = None, top_n: int | None = 20,
                        f: str | None = None, t: str | None = None) -> str:
    kind = f"contains(lower(property_type), '{ptype.lower()}')" if ptype else "TRUE"
    top = "" if top_n is None else f"""
QUALIFY row_number() OVER (ORDER BY listing_count DESC, city_name, locality_id, property_type NULLS LAST) <= {top_n}"""
    return with_bridge(f"""
SELECT city_name, locality_name, locality_id, property_type, listing_count, avg_price_sqft, avg_price_inr,
       avg_area_sqft, latitude, longitude
FROM (
    SELECT city_id, locality_id, property_type, {PRICES},
           {A2('min_area_sqft', 4, 1, 'DECIMAL(18,1)')} AS avg_area_sqft
    FROM {_market("listings", f, t, f"is_active AND {kind}")} GROUP BY ALL
) JOIN ({_named(city)}) USING (city_id)
  JOIN (SELECT locality_id, locality_name, latitude, longitude FROM localities) USING (locality_id){top}
""")


def property_distribution_sql(city: str | None = None, f: str | None = None, t: str | None = None) -> str:
    return with_bridge(f"""
SELECT city_name, property_type, listing_count, avg_price_sqft, avg_price_inr
FROM ({_named(city)}) JOIN (
    SELECT city_id, property_type, {PRICES}
    FROM {_market("listings", f, t, "is_active AND property_type IS NOT NULL")} GROUP BY ALL
) USING (city_id)
""")


def _deals_by_listing(f: str | None = None, t: str | None = None) -> str:
    """Per listing: its deals that count. A listing and deal count together
    when the later of their dates reaches the range and the earlier one does
    not pass it; a listing without deals is judged by its own date."""
    lo = f"greatest(transaction_date, register_date) >= DATE '{f}'" if f else "TRUE"
    hi = f"least(transaction_date, register_date) <= DATE '{t}'" if t else "TRUE"
    return f"""
deals AS (
  SELECT listing_id, agent_id, city_id, count(DISTINCT txn_id) AS n, sum(sale_price) AS value, count(sale_price) AS priced
  FROM (SELECT listing_id, agent_id, city_id, register_date FROM listings) LEFT JOIN transactions USING (listing_id)
  WHERE {lo} AND {hi} GROUP BY ALL)
"""


SALES = f"""count(*) AS total_listings, CAST(sum(n) AS BIGINT) AS total_transactions,
       CAST(sum(value) AS DECIMAL(38,2)) AS total_sales_value, {mean_sql('sum(value)', 'sum(priced)')} AS avg_sale_price"""


def agent_performance_sql(city: str | None = None, top_n: int = 15, f: str | None = None,
                          t: str | None = None) -> str:
    return with_bridge(f"""
SELECT agent_id, contact_name, company_name, city_name, total_listings, total_transactions, total_sales_value,
       avg_sale_price
FROM (SELECT agent_id, max(city_name) AS city_name, {SALES}
      FROM deals {'JOIN' if city else 'LEFT JOIN'} ({_named(city)}) USING (city_id) GROUP BY agent_id)
JOIN agents USING (agent_id) WHERE is_active
QUALIFY row_number() OVER (ORDER BY total_transactions DESC, coalesce(total_sales_value, 0) DESC, agent_id) <= {top_n}
""", _deals_by_listing(f, t))


def bedroom_price_sql(city: str | None = None, f: str | None = None, t: str | None = None) -> str:
    return with_bridge(f"""
SELECT city_name, bedroom_num, listing_count, avg_price_sqft, avg_price_inr
FROM ({_named(city)}) JOIN (
    SELECT city_id, bedroom_num, {PRICES}
    FROM {_market("listings", f, t, "is_active AND bedroom_num IN (1, 2, 3, 4, 5, 6)")} GROUP BY ALL
) USING (city_id)
""")


CITIES_SQL = with_bridge("SELECT city_id, city_name FROM cities ORDER BY city_name, city_id")


def localities_sql(city_id: int | None = None) -> str:
    where = "" if city_id is None else f"WHERE loc.city_id = {city_id}"
    return with_bridge(f"""
SELECT loc.locality_id, loc.locality_name, loc.city_id, c.city_name, loc.latitude, loc.longitude
FROM localities loc JOIN cities c ON c.city_id = loc.city_id
{where}
ORDER BY loc.locality_name, loc.locality_id LIMIT 500
""")


def mv_agent_performance_sql() -> str:
    return with_bridge(f"""
SELECT agent_id, contact_name, company_name, city_name, coalesce(total_listings, 0) AS total_listings,
       coalesce(total_transactions, 0) AS total_transactions, total_sales_value, avg_sale_price
FROM agents LEFT JOIN (SELECT agent_id, city_id, {SALES} FROM deals GROUP BY ALL) USING (agent_id)
     LEFT JOIN cities USING (city_id)
""", _deals_by_listing())


# -- views -------------------------------------------------------------------

def mv_price_trends_sql() -> str:
    return price_trends_sql(extra=True)


def mv_locality_demand_sql() -> str:
    return locality_demand_sql(top_n=None)


def refresh_views_sql() -> str:
    parts = [("mv_price_trends", mv_price_trends_sql()),
             ("mv_locality_demand", mv_locality_demand_sql()),
             ("mv_agent_performance", mv_agent_performance_sql())]
    return "\nUNION ALL\n".join(
        f"SELECT '{n}' AS view_name, COUNT(*) AS row_count FROM ({q}) v_{i}"
        for i, (n, q) in enumerate(parts))


# -- search ------------------------------------------------------------------

LISTING_OUT_SQL = """l.listing_id, l.prop_id, l.property_type, l.transact_type, l.bedroom_num,
       l.bathroom_num, l.balcony_num, l.furnish_id, l.age, l.floor_num, l.total_floor,
       l.min_area_sqft, l.max_area_sqft, l.price_inr, l.price_sqft, l.description,
       l.prop_name, l.latitude, l.longitude, l.register_date, l.expiry_date, l.verified,
       l.is_active, l.city_id, c.city_name, l.locality_id, loc.locality_name, l.building_id,
       l.agent_id, a.contact_name AS agent_name, l.amenities, l.created_at, l.updated_at"""

ENRICH_JOINS = """LEFT JOIN cities c ON c.city_id = l.city_id
LEFT JOIN localities loc ON loc.locality_id = l.locality_id
LEFT JOIN agents a ON a.agent_id = l.agent_id"""


def listing_filter_sql(f) -> str:
    """SQL text of a ``search.ListingFilters``."""
    p = []
    if f.is_active is not None:
        p.append(f"is_active = {str(f.is_active).upper()}")
    for col, v in (("city_id", f.city_id), ("locality_id", f.locality_id),
                   ("transact_type", f.transact_type), ("bedroom_num", f.bedroom_num)):
        if v is not None:
            p.append(f"{col} = {v}")
    if f.property_type:
        p.append(f"property_type ILIKE '%{f.property_type}%'")
    if f.min_price is not None:
        p.append(f"price_inr >= {f.min_price}")
    if f.max_price is not None:
        p.append(f"price_inr <= {f.max_price}")
    if f.min_area is not None:
        p.append(f"min_area_sqft >= {f.min_area}")
    if f.max_area is not None:
        p.append(f"max_area_sqft <= {f.max_area}")
    if f.verified is not None:
        p.append(f"verified = {str(f.verified).upper()}")
    if f.search:
        p.append(f"(prop_name ILIKE '%{f.search}%' OR description ILIKE '%{f.search}%')")
    return " AND ".join(p) if p else "TRUE"


def listings_page_sql(f, page: int, size: int) -> str:
    return with_bridge(f"""
SELECT {LISTING_OUT_SQL}
FROM (SELECT * FROM listings WHERE {listing_filter_sql(f)}
      ORDER BY register_date DESC NULLS LAST, listing_id DESC
      LIMIT {size} OFFSET {(page - 1) * size}) l
{ENRICH_JOINS}
""")


def listings_search_sql(f) -> str:
    return with_bridge(f"""
SELECT listing_id, prop_id, prop_name, description, property_type, city_id
FROM listings WHERE {listing_filter_sql(f)}
""")


def listings_count_sql(f, size: int) -> str:
    return with_bridge(f"""
SELECT COUNT(*) AS total, {size} AS size, (COUNT(*) + {size - 1}) // {size} AS pages
FROM listings WHERE {listing_filter_sql(f)}
""")


def listings_enriched_sql() -> str:
    return with_bridge(f"SELECT {LISTING_OUT_SQL} FROM listings l {ENRICH_JOINS}")


def listing_lookup_sql(keys_sql: str, key: str) -> str:
    return with_bridge(f"""
SELECT k._key AS requested_key, l.listing_id IS NOT NULL AS found, {LISTING_OUT_SQL}
FROM (SELECT DISTINCT _key FROM ({keys_sql}) kk WHERE _key IS NOT NULL) k
LEFT JOIN listings l ON l.{key} = k._key
{ENRICH_JOINS}
""")


TXN_OUT_SQL = """t.txn_id, t.listing_id, t.sale_price, t.transaction_date, t.buyer_name,
       t.ownership_type, t.status, t.notes, t.created_at, l.property_type, c.city_name, loc.locality_name"""


def transactions_list_sql(status=None, date_from=None, date_to=None, city_id=None,
                          limit: int = 50, offset: int = 0) -> str:
    p = ["TRUE"]
    if status is not None:
        p.append(f"status = '{status}'")
    if date_from:
        p.append(f"transaction_date >= DATE '{date_from}'")
    if date_to:
        p.append(f"transaction_date <= DATE '{date_to}'")
    if city_id is not None:
        p.append(f"listing_id IN (SELECT listing_id FROM listings WHERE city_id = {city_id})")
    return with_bridge(f"""
SELECT {TXN_OUT_SQL}
FROM (SELECT * FROM transactions WHERE {' AND '.join(p)}
      ORDER BY transaction_date DESC NULLS LAST, txn_id ASC
      LIMIT {limit} OFFSET {offset}) t
LEFT JOIN listings l ON l.listing_id = t.listing_id
LEFT JOIN cities c ON c.city_id = l.city_id
LEFT JOIN localities loc ON loc.locality_id = l.locality_id
""")


def agents_search_sql(is_active=True, search=None, limit: int = 50, offset: int = 0) -> str:
    p = ["TRUE"]
    if is_active is not None:
        p.append(f"is_active = {str(is_active).upper()}")
    if search:
        p.append(f"(contact_name ILIKE '%{search}%' OR company_name ILIKE '%{search}%')")
    return with_bridge(f"""
SELECT agent_id, contact_name, company_name, phone, email, is_active, created_at FROM agents
WHERE {' AND '.join(p)}
ORDER BY contact_name ASC NULLS LAST, agent_id LIMIT {limit} OFFSET {offset}
""")


# -- roll-ups and formatting -------------------------------------------------

def indian_int_sql(n: str) -> str:
    """Indian digit grouping of a non-negative integer expression (< 1e11)."""
    s = f"CAST({n} AS BIGINT)"
    return f"""(CASE
  WHEN {s} >= 1000000000 THEN CAST({s} // 1000000000 AS VARCHAR) || ',' || lpad(CAST(({s} // 10000000) % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(({s} // 100000) % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(({s} // 1000) % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({s} % 1000 AS VARCHAR), 3, '0')
  WHEN {s} >= 10000000 THEN CAST({s} // 10000000 AS VARCHAR) || ',' || lpad(CAST(({s} // 100000) % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(({s} // 1000) % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({s} % 1000 AS VARCHAR), 3, '0')
  WHEN {s} >= 100000 THEN CAST({s} // 100000 AS VARCHAR) || ',' || lpad(CAST(({s} // 1000) % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({s} % 1000 AS VARCHAR), 3, '0')
  WHEN {s} >= 1000 THEN CAST({s} // 1000 AS VARCHAR) || ',' || lpad(CAST({s} % 1000 AS VARCHAR), 3, '0')
  ELSE CAST({s} AS VARCHAR) END)"""


def format_price_sql(x: str) -> str:
    ip = f"floor({x})"
    cents = f"CAST(({x} - floor({x})) * 100 AS INTEGER)"
    frac = f"(CASE WHEN {cents} = 0 THEN '' ELSE '.' || rtrim(lpad(CAST({cents} AS VARCHAR), 2, '0'), '0') END)"
    return f"""(CASE WHEN {x} IS NULL OR {x} = 0 THEN '—'
  WHEN {x} >= 10000000 THEN '₹' || CAST(CAST(round({x} * CAST(0.0000001 AS DECIMAL(8,7)), 2) AS DECIMAL(20,2)) AS VARCHAR) || ' Cr'
  WHEN {x} >= 100000 THEN '₹' || CAST(CAST(round({x} * CAST(0.00001 AS DECIMAL(6,5)), 2) AS DECIMAL(20,2)) AS VARCHAR) || ' L'
  ELSE '₹' || {indian_int_sql(ip)} || {frac} END)"""




#: City names of the test tables' city dimension, in the matrices' column order.
MATRIX_CITIES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _city_columns() -> str:
    return ", ".join(f"""max(CASE WHEN city_name = '{c}' AND avg_price_sqft <> 0 THEN avg_price_sqft END) AS "{c}\""""
                     for c in MATRIX_CITIES)


def price_trend_matrix_sql() -> str:
    return f"WITH pt AS ({price_trends_sql()}) SELECT month, {_city_columns()} FROM pt GROUP BY month"


def bedroom_matrix_sql() -> str:
    return f"""WITH bp AS ({bedroom_price_sql()})
SELECT CAST(b AS VARCHAR) || ' BHK' AS bedrooms, CAST(b AS SMALLINT) AS bedroom_num, {_city_columns()}
FROM range(1, 7) r(b) LEFT JOIN bp ON bedroom_num = b GROUP BY b"""


def property_share_sql() -> str:
    return f"""WITH pd AS ({property_distribution_sql()}),
g AS (SELECT COALESCE(property_type, 'Unknown') AS property_type,
             SUM(listing_count) AS listing_count,
             CAST(SUM(CASE WHEN avg_price_sqft <> 0 THEN avg_price_sqft END) * 100 AS HUGEINT) AS u,
             COUNT(CASE WHEN avg_price_sqft <> 0 THEN 1 END) AS n
      FROM pd GROUP BY 1),
tot AS (SELECT SUM(listing_count) AS total FROM pd)
SELECT g.property_type, CAST(g.listing_count AS BIGINT) AS listing_count,
       CAST(CAST((2 * g.listing_count * 1000 + tot.total) // (2 * tot.total) AS DECIMAL(20,0)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(5,1)) AS share_pct,
       CAST(CAST((2 * g.u + NULLIF(g.n, 0)) // (2 * NULLIF(g.n, 0)) AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS mean_city_price_sqft
FROM g, tot
ORDER BY listing_count DESC, property_type"""


def locality_rollup_sql(top_n: int = 15) -> str:
    return f"""WITH ld AS ({locality_demand_sql(top_n=top_n)}),
g AS (SELECT locality_name, SUM(listing_count) AS listing_count,
             CAST(SUM(CASE WHEN avg_price_sqft <> 0 THEN avg_price_sqft END) * 100 AS HUGEINT) AS u,
             COUNT(CASE WHEN avg_price_sqft <> 0 THEN 1 END) AS n
      FROM ld GROUP BY locality_name)
SELECT CASE WHEN length(locality_name) > 22 THEN substr(locality_name, 1, 22) || '…' ELSE locality_name END AS label,
       locality_name, CAST(listing_count AS BIGINT) AS listing_count,
       CAST(COALESCE((2 * u + NULLIF(n, 0) * 100) // (2 * NULLIF(n, 0) * 100), 0) AS BIGINT) AS avg_price_sqft
FROM g ORDER BY listing_count DESC, locality_name LIMIT 15"""


def agent_leaderboard_sql(top_n: int = 10) -> str:
    return f"""WITH ap AS ({agent_performance_sql(top_n=top_n)})
SELECT row_number() OVER (ORDER BY COALESCE(total_transactions, 0) DESC,
                                   COALESCE(total_sales_value, 0) DESC, agent_id) AS rank,
       agent_id, contact_name, company_name, city_name, total_listings, total_sales_value,
       {format_price_sql('total_sales_value')} AS sales_label
FROM ap"""


def format_price_query_sql() -> str:
    return with_bridge(f"SELECT listing_id, price_inr, {format_price_sql('price_inr')} AS price_label FROM listings")


def labels_sql() -> str:
    n = "round(price_sqft)"
    return with_bridge(f"""
SELECT listing_id,
       CASE WHEN transact_type = 2 THEN 'Rent' ELSE 'Buy/Sell' END AS transact_label,
       COALESCE(CASE CAST(furnish_id AS INTEGER) WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Furnished'
                     WHEN 2 THEN 'Semi-Furnished' WHEN 4 THEN 'Unfurnished' END, '—') AS furnish_label,
       CAST(bedroom_num AS VARCHAR) || ' BHK' AS bhk_label,
       COALESCE(strftime(register_date, '%d %b %Y'), '—') AS register_label,
       CASE WHEN price_sqft IS NULL OR price_sqft = 0 THEN '—'
            ELSE '₹' || {indian_int_sql(n)} || '/sqft' END AS sqft_label
FROM listings""")


# -- ingest ------------------------------------------------------------------
# RAW renders every order as a raw city-file row, exactly like
# propcube.sources.raw.raw_rows.

RAW = r"""
raw AS (
  SELECT r_name AS city_name, CAST(r_regionkey AS INTEGER) AS source_rank, o_orderkey AS row_id,
    CASE WHEN k % 50 = 7 THEN 'P' || CAST(k AS VARCHAR)
         WHEN k % 50 = 9 THEN 'R' || CAST(k - 1 AS VARCHAR)
         WHEN k % 50 = 13 THEN NULL
         ELSE 'R' || CAST(k AS VARCHAR) END AS PROP_ID,
    CASE WHEN k % 23 = 0 THEN NULL ELSE substr(o_orderpriority, 3) END AS PROPERTY_TYPE,
    CASE k % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '' WHEN 3 THEN '0' ELSE '2.0' END AS TRANSACT_TYPE,
    CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 = 1 THEN 'abc'
         WHEN k % 9 = 2 THEN CAST(k % 7 AS VARCHAR) || '.0' ELSE CAST(k % 7 AS VARCHAR) END AS BEDROOM_NUM,
    CAST(k % 5 AS VARCHAR) AS BATHROOM_NUM,
    CASE WHEN k % 13 = 0 THEN '-1' ELSE CAST(k % 4 AS VARCHAR) END AS BALCONY_NUM,
    CASE k % 6 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '4' WHEN 4 THEN '3' ELSE 'x' END AS FURNISH,
    CASE WHEN k % 17 = 0 THEN '99999' ELSE CAST(k % 40 AS VARCHAR) END AS AGE,
    CAST(k % 25 AS VARCHAR) AS FLOOR_NUM,
    CAST(k % 30 + 1 AS VARCHAR) AS TOTAL_FLOOR,
    CASE WHEN k % 7 = 0 THEN '0' WHEN k % 7 = 1 THEN '-5'
         ELSE CAST(rupees // (400 + (k % 37) * 50) AS VARCHAR) END AS PRICE_SQFT,
    CAST(400 + (k % 37) * 50 AS VARCHAR) AS MIN_AREA_SQFT,
    CAST(400 + (k % 37) * 50 + 100 AS VARCHAR) AS MAX_AREA_SQFT,
    CAST(400 + (k % 37) * 50 AS VARCHAR) AS AREA,
    CASE k % 10
      WHEN 0 THEN CAST(cents // 1000000 AS VARCHAR) || '.' || lpad(CAST((cents // 10000) % 100 AS VARCHAR), 2, '0') || ' Cr'
      WHEN 1 THEN CAST(cents // 100000 AS VARCHAR) || '.' || lpad(CAST((cents // 1000) % 100 AS VARCHAR), 2, '0') || ' L'
      WHEN 2 THEN format('{:,}', rupees)
      WHEN 3 THEN CAST(rupees // 1000 AS VARCHAR) || ' - ' || CAST(rupees // 1000 + 5 AS VARCHAR) || ' L'
      WHEN 4 THEN 'Price on Request'
      WHEN 5 THEN CAST(rupees // 1000 AS VARCHAR) || ' L Onwards'
      WHEN 6 THEN CAST(rupees % 100 AS VARCHAR) || ',000/Bedroom'
      WHEN 7 THEN CAST(rupees // 1000 AS VARCHAR) || ' Lac'
      WHEN 8 THEN '0 - ' || CAST(rupees // 1000 AS VARCHAR) || ' L'
      ELSE CASE (k // 10) % 4 WHEN 0 THEN 'nan' WHEN 1 THEN '' WHEN 2 THEN '₹5 L'
        ELSE CAST((rupees % 300) // 100 AS VARCHAR) || '.' || lpad(CAST(rupees % 100 AS VARCHAR), 2, '0')
             || '  - ' || CAST(((rupees + 1) % 300) // 100 AS VARCHAR) || '.'
             || lpad(CAST((rupees + 1) % 100 AS VARCHAR), 2, '0') || ' Cr' END
    END AS PRICE,
    CASE k % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'Yes' WHEN 2 THEN '1' WHEN 3 THEN 'N' ELSE '' END AS VERIFIED,
    CASE k % 8
      WHEN 0 THEN CAST(day(od) AS VARCHAR)
                  || CASE WHEN day(od) IN (1, 21, 31) THEN 'st' WHEN day(od) IN (2, 22) THEN 'nd'
                          WHEN day(od) IN (3, 23) THEN 'rd' ELSE 'th' END
                  || ' ' || strftime(od, '%b') || ', ' || CAST(year(od) AS VARCHAR)
      WHEN 1 THEN upper(strftime(od, '%d %b, %Y'))
      WHEN 2 THEN strftime(od, '%Y-%m-%d')
      WHEN 3 THEN CAST(day(od) AS VARCHAR) || '/' || CAST(month(od) AS VARCHAR) || '/' || CAST(year(od) AS VARCHAR)
      WHEN 4 THEN NULL
      WHEN 5 THEN strftime(od, '%Y-%m-%d') || ' 00:00:00'
      WHEN 6 THEN CAST(day(od) AS VARCHAR) || ' ' || strftime(od, '%b') || ', ' || CAST(year(od) % 100 AS VARCHAR)
      ELSE CASE WHEN k % 16 = 7 THEN '31 Feb, ' || CAST(year(od) AS VARCHAR)
                ELSE CAST(day(od) AS VARCHAR) || '  ' || strftime(od, '%b') || ',  ' || CAST(year(od) AS VARCHAR) END
    END AS REGISTER_DATE,
    CASE WHEN k % 3 <> 0 THEN strftime(od + 365, '%Y-%m-%d') END AS EXPIRY_DATE,
    CASE k % 6
      WHEN 0 THEN '{''LOCALITY_NAME'': ''' || n_name || ''', ''BUILDING_ID'': ' || CAST(k % 200 + 1 AS VARCHAR)
                  || ', ''BUILDING_NAME'': ''Tower ' || CAST(k % 50 AS VARCHAR) || ''', ''SOCIETY_NAME'': ''Society '
                  || CAST(k % 40 AS VARCHAR) || '''}'
      WHEN 1 THEN '{''LOCALITY_NAME'': '' ' || n_name || ' '', ''BUILDING_ID'': ''' || CAST(1000000 + k % 5000 AS VARCHAR) || '.0''}'
      WHEN 2 THEN '{"LOCALITY_NAME": "' || n_name || '''s Rd", ''BUILDING_ID'': None, ''VERIFIED'': True}'
      WHEN 3 THEN '{''LOCALITY_NAME'': ''' || n_name || '\xa0East'', ''BUILDING_ID'': 0}'
      WHEN 4 THEN 'garbage'
      ELSE NULL END AS location,
    CASE k % 4
      WHEN 0 THEN '{''LATITUDE'': ''' || lat || ''', ''LONGITUDE'': ''' || lng || '''}'
      WHEN 1 THEN '{''LATITUDE'': ' || lat || ', ''LONGITUDE'': ' || lng || '}'
      WHEN 2 THEN '{''LATITUDE'': 0, ''LONGITUDE'': ''''}'
      ELSE NULL END AS MAP_DETAILS,
    CASE WHEN k % 11 = 0 THEN 'nan'
         WHEN k % 7 = 0 THEN upper('agent ' || CAST(o_custkey % 300 AS VARCHAR))
         ELSE 'Agent ' || CAST(o_custkey % 300 AS VARCHAR) END AS CONTACT_NAME,
    'Co ' || CAST(o_custkey % 40 AS VARCHAR) AS CONTACT_COMPANY_NAME,
    'Tower ' || CAST(o_custkey AS VARCHAR) AS PROP_NAME,
    CASE WHEN k % 3 = 0 THEN 'Lift, Parking' END AS AMENITIES,
    CASE WHEN k % 101 = 0 THEN repeat('abcdefghij', 210) ELSE 'Status ' || o_orderstatus END AS DESCRIPTION
  FROM (SELECT o.*, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS rupees,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents,
               CAST(o_orderdate AS DATE) AS od, n_name, n_nationkey, r_name, r_regionkey,
               CAST(n_nationkey + 10 AS VARCHAR) || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS lat,
               CAST(n_nationkey + 70 AS VARCHAR) || '.' || lpad(CAST(o_orderkey % 997 AS VARCHAR), 3, '0') AS lng
        FROM orders o JOIN nation ON n_nationkey = o_orderkey % 25
        JOIN region ON r_regionkey = n_regionkey) src)
"""

NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _num(x: str) -> str:
    return f"(CASE WHEN regexp_full_match(trim({x}), '{NUM_RE}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def _smallint(x: str) -> str:
    return f"TRY_CAST(TRY_CAST(trunc({_num(x)}) AS BIGINT) AS SMALLINT)"


def price_ctes(src: str = "raw", col: str = "PRICE") -> str:
    """Layered CTEs: pp (row_id, price_raw, price_value DOUBLE)."""
    layers = [f"pp0 AS (SELECT *, {col} AS price_raw, trim({col}) AS x_s, "
              f"trim(split_part(trim({col}), ' - ', 1)) AS x_a, trim(split_part(trim({col}), ' - ', 2)) AS x_b FROM {src})"]
    l1 = ", ".join(f"trim(regexp_replace({v}, '/Bed(room)?.*', '', 'g')) AS {v}_1" for v in ("x_s", "x_a", "x_b"))
    layers.append(f"pp1 AS (SELECT *, {l1} FROM pp0)")
    l2 = ", ".join(f"contains({v}_1, 'Cr') AS {v}_cr, (contains({v}_1, ' L') OR ends_with({v}_1, 'L')) AS {v}_l"
                   for v in ("x_s", "x_a", "x_b"))
    layers.append(f"pp2 AS (SELECT *, {l2} FROM pp1)")
    l3 = ", ".join(
        f"trim(replace(replace(CASE WHEN {v}_cr THEN trim(replace({v}_1, 'Cr', '')) "
        f"WHEN {v}_l THEN trim(regexp_replace({v}_1, '\\s*L\\s*', '', 'g')) ELSE {v}_1 END, ',', ''), 'Onwards', '')) AS {v}_b"
        for v in ("x_s", "x_a", "x_b"))
    layers.append(f"pp3 AS (SELECT *, {l3} FROM pp2)")
    l4 = ", ".join(
        f"(CASE WHEN regexp_full_match({v}_b, '{NUM_RE}') THEN TRY_CAST({v}_b AS DOUBLE) END) * "
        f"(CASE WHEN {v}_cr THEN 1e7 WHEN {v}_l THEN 1e5 ELSE 1.0 END) AS {v}_v, "
        f"({v} IS NULL OR lower({v}) IN ('', 'price on request', 'nan')) AS {v}_miss"
        for v in ("x_s", "x_a", "x_b"))
    layers.append(f"pp4 AS (SELECT *, {l4} FROM pp3)")
    layers.append(f"""pp AS (SELECT *,
      CASE WHEN {col} IS NULL OR x_s_miss THEN NULL
           WHEN contains(x_s, ' - ') THEN
             CASE WHEN NOT x_a_miss AND x_a_v <> 0 AND NOT x_b_miss AND x_b_v <> 0 THEN (x_a_v + x_b_v) / 2
                  WHEN NOT x_a_miss AND x_a_v <> 0 THEN x_a_v
                  WHEN x_b_miss THEN NULL ELSE x_b_v END
           ELSE x_s_v END AS price_value FROM pp4)""")
    return ",\n".join(layers)


def date_sql(x: str) -> str:
    s = f"regexp_replace(regexp_replace(trim({x}), '(\\d+)(st|nd|rd|th)', '\\1', 'g'), '\\s+', ' ', 'g')"
    return f"""COALESCE(
  CASE WHEN regexp_full_match({s}, '\\d{{1,2}} [A-Za-z]{{3}}, \\d{{4}}') THEN CAST(try_strptime({s}, '%d %b, %Y') AS DATE) END,
  CASE WHEN regexp_full_match({s}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN CAST(try_strptime({s}, '%Y-%m-%d') AS DATE) END,
  CASE WHEN regexp_full_match({s}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime({s}, '%d/%m/%Y') AS DATE) END)"""


def _quoted(field: str, src: str) -> str:
    """Value of a quoted key in one of the fixture's dict literals."""
    single = f"regexp_extract({src}, '''{field}'':\\s*''([^'']*)''', 1)"
    double = f"regexp_extract({src}, '\"{field}\":\\s*\"([^\"]*)\"', 1)"
    return f"COALESCE(NULLIF({single}, ''), NULLIF({double}, ''), '')"


def location_sql(src: str = "location") -> str:
    loc = f"trim(replace({_quoted('LOCALITY_NAME', src)}, '\\xa0', chr(160)))"
    bid = (f"COALESCE(NULLIF(regexp_extract({src}, '''BUILDING_ID'':\\s*''?([0-9.]+)', 1), ''), '0')")
    return f"""{loc} AS locality_name, {bid} AS building_id_raw,
       {_quoted('BUILDING_NAME', src)} AS building_name, {_quoted('SOCIETY_NAME', src)} AS society_name"""


def geo_sql(field: str, src: str = "MAP_DETAILS") -> str:
    v = f"regexp_extract({src}, '''{field}'':\\s*''?([0-9.]*)', 1)"
    return f"(CASE WHEN TRY_CAST({v} AS DOUBLE) <> 0 THEN TRY_CAST({v} AS DECIMAL(10,7)) END)"


def with_raw(sql: str, extra: str = "") -> str:
    ctes = RAW.strip()
    if extra:
        ctes += ",\n" + extra.strip()
    return f"WITH {ctes}\n{sql.strip()}"


def parse_price_sql() -> str:
    return with_raw("SELECT row_id, price_raw, price_value FROM pp", price_ctes())


def parse_date_sql() -> str:
    return with_raw(f"SELECT row_id, REGISTER_DATE AS date_raw, {date_sql('REGISTER_DATE')} AS register_date FROM raw")


def parse_location_sql() -> str:
    return with_raw(f"""SELECT row_id, {location_sql()},
       {geo_sql('LATITUDE')} AS latitude, {geo_sql('LONGITUDE')} AS longitude FROM raw""")


def csv_records_sql() -> str:
    """The fields as they were before they were written, and the text of the
    records that got a field too many."""
    return """WITH r AS (
  SELECT r_name AS city_name, o_orderkey AS k, 'R' || o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS agent,
         CASE o_orderkey % 3 WHEN 0 THEN 'Tower "' || (o_orderkey % 50) || '",' || chr(10) || 'by the "park"' || chr(10)
                             WHEN 1 THEN 'Flat, ' || o_orderstatus ELSE o_orderpriority END AS text
  FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 JOIN region ON r_regionkey = n_regionkey
)
SELECT city_name, CASE WHEN k % 97 <> 0 THEN id END AS PROP_ID, CASE WHEN k % 97 <> 0 THEN text END AS DESCRIPTION,
       CASE WHEN k % 97 <> 0 THEN agent END AS AGENT,
       CASE WHEN k % 97 = 0 THEN id || ',' || CASE WHEN text LIKE '%,%' THEN '"' || replace(text, '"', '""') || '"' ELSE text END
                                 || ',' || agent || ',one too many' END AS record,
       CASE WHEN k % 97 = 0 THEN 'too many fields' END AS reason
FROM r"""


def parse_literals_sql() -> str:
    """The fields by style of the row, from the text itself."""
    spaces = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
    return f"""SELECT doc_id,
       CASE WHEN text IS NULL OR doc_id % 6 > 3 THEN '' WHEN doc_id % 6 = 3 THEN 'AAA' ELSE trim(text, '{spaces}') END AS locality_name,
       CASE WHEN text IS NOT NULL AND doc_id % 6 IN (0, 3) THEN CAST(doc_id AS VARCHAR) ELSE '0' END AS building_id_raw,
       CASE WHEN text IS NULL THEN '' WHEN doc_id % 6 = 1 THEN 'Plot: True, near' WHEN doc_id % 6 = 3 THEN text ELSE '' END AS building_name,
       CASE WHEN text IS NOT NULL AND doc_id % 6 = 2 THEN 'Green ''Park''' ELSE '' END AS society_name
FROM documents"""


def _synth(prop: str) -> str:
    h = f"('0x' || substr(md5(concat_ws('|', {prop})), 1, 8))::BIGINT"
    return f"(DATE '2022-10-01' + CAST({h} % 396 AS INTEGER))"


def _clamp(x: str, n: int) -> str:
    return f"NULLIF(substr({x}, 1, {n}), '')"


NORMALIZED_SQL = f"""
norm AS (
  SELECT trim(PROP_ID) AS prop_id,
    {_clamp('PROPERTY_TYPE', 100)} AS property_type,
    CAST(CASE WHEN source_rank = 3 THEN 1
              WHEN {_smallint('TRANSACT_TYPE')} IS NULL OR {_smallint('TRANSACT_TYPE')} = 0 THEN 1
              ELSE {_smallint('TRANSACT_TYPE')} END AS SMALLINT) AS transact_type,
    {_smallint('BEDROOM_NUM')} AS bedroom_num,
    {_smallint('BATHROOM_NUM')} AS bathroom_num,
    {_smallint('BALCONY_NUM')} AS balcony_num,
    CAST(CASE WHEN source_rank <> 3 AND {_smallint('FURNISH')} IN (0, 1, 2, 4) THEN {_smallint('FURNISH')} ELSE 0 END AS SMALLINT) AS furnish_id,
    {_smallint('AGE')} AS age,
    {_smallint('FLOOR_NUM')} AS floor_num,
    {_smallint('TOTAL_FLOOR')} AS total_floor,
    CASE WHEN {_num('PRICE_SQFT')} > 0 THEN TRY_CAST(trim(PRICE_SQFT) AS DECIMAL(12,2)) END AS price_sqft,
    {_clamp('PROP_NAME', 400)} AS prop_name,
    {_clamp('AMENITIES', 500)} AS amenities,
    {_clamp('DESCRIPTION', 2000)} AS description,
    TRY_CAST(trim(CASE WHEN source_rank = 0 THEN AREA ELSE MIN_AREA_SQFT END) AS DECIMAL(12,4)) AS min_area_sqft,
    TRY_CAST(trim(CASE WHEN source_rank = 0 THEN AREA WHEN source_rank = 1 THEN MIN_AREA_SQFT ELSE MAX_AREA_SQFT END) AS DECIMAL(12,4)) AS max_area_sqft,
    price_raw,
    CAST(CAST(price_value AS VARCHAR) AS DECIMAL(18,2)) AS price_inr,
    CASE WHEN source_rank = 3 THEN FALSE ELSE COALESCE(trim(VERIFIED) IN ('1', '1.0', 'Y', 'Yes', 'True', 'TRUE', 'true'), FALSE) END AS verified,
    COALESCE(CASE WHEN source_rank <> 0 THEN {date_sql('REGISTER_DATE')} END, {_synth('trim(PROP_ID)')}) AS register_date,
    (CASE WHEN source_rank <> 0 THEN {date_sql('REGISTER_DATE')} END) IS NULL AS register_date_synth,
    {date_sql('EXPIRY_DATE')} AS expiry_date,
    {location_sql()},
    city_name,
    {geo_sql('LATITUDE')} AS latitude, {geo_sql('LONGITUDE')} AS longitude,
    CASE WHEN source_rank IN (2, 4) THEN trim(CONTACT_NAME) END AS contact_name,
    CASE WHEN source_rank IN (2, 4) THEN trim(CONTACT_COMPANY_NAME) END AS company_name,
    CASE WHEN TRY_CAST(trunc({_num('TOTAL_FLOOR')}) AS BIGINT) BETWEEN 0 AND 32767
         THEN CAST(trunc({_num('TOTAL_FLOOR')}) AS SMALLINT) END AS total_floors_bld,
    source_rank, row_id
  FROM pp),
normalized AS (
  SELECT * EXCLUDE (building_id_raw),
         CASE WHEN TRY_CAST(trunc({_num('building_id_raw')}) AS BIGINT) > 0
              THEN TRY_CAST(trunc({_num('building_id_raw')}) AS BIGINT) END AS building_id
  FROM (SELECT * REPLACE (NULLIF(building_name, '') AS building_name,
                          NULLIF(society_name, '') AS society_name) FROM norm))
"""


def normalized_ctes() -> str:
    return price_ctes() + ",\n" + NORMALIZED_SQL.strip()


NORMALIZED_COLS = ("prop_id, property_type, transact_type, bedroom_num, bathroom_num, balcony_num, "
                   "furnish_id, age, floor_num, total_floor, price_sqft, prop_name, amenities, description, "
                   "min_area_sqft, max_area_sqft, price_raw, price_inr, verified, register_date, "
                   "register_date_synth, expiry_date, locality_name, building_id, building_name, "
                   "society_name, city_name, latitude, longitude, contact_name, company_name, "
                   "total_floors_bld, source_rank, row_id")

CLEAN_CTE = """
kept AS (SELECT * FROM normalized
         WHERE price_inr > 0 AND prop_id IS NOT NULL AND prop_id <> 'nan' AND prop_id <> ''),
clean AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY prop_id ORDER BY source_rank, row_id) AS rn FROM kept) WHERE rn = 1)
"""


def normalize_listings_sql() -> str:
    return with_raw(f"SELECT {NORMALIZED_COLS} FROM normalized", normalized_ctes())


def quality_filter_sql() -> str:
    return with_raw("SELECT prop_id, price_inr, source_rank, row_id FROM kept",
                    normalized_ctes() + ",\n" + CLEAN_CTE.strip())


def dedup_first_sql() -> str:
    return with_raw("SELECT prop_id, source_rank, row_id, price_inr, city_name, locality_name FROM clean",
                    normalized_ctes() + ",\n" + CLEAN_CTE.strip())


def register_date_synth_sql() -> str:
    return with_raw("SELECT prop_id, row_id, register_date FROM clean WHERE register_date_synth",
                    normalized_ctes() + ",\n" + CLEAN_CTE.strip())


# -- dimension maintenance -------------------------------------------------------

def with_all(sql: str, extra: str = "") -> str:
    """Bridge + raw fixture + normalised/clean ingest CTEs."""
    ctes = BRIDGE.strip() + ",\n" + RAW.strip() + ",\n" + normalized_ctes() + ",\n" + CLEAN_CTE.strip()
    if extra:
        ctes += ",\n" + extra.strip()
    return f"WITH {ctes}\n{sql.strip()}"


DIM_CTES = """
first_loc AS (
  SELECT locality_name, city_name, latitude AS n_lat, longitude AS n_lng, source_rank AS _sr, row_id AS _ri
  FROM (SELECT *, row_number() OVER (PARTITION BY locality_name, city_name ORDER BY source_rank, row_id) AS rn
        FROM clean WHERE locality_name IS NOT NULL AND locality_name <> '') WHERE rn = 1),
cand_loc AS (SELECT f.*, c.city_id FROM first_loc f JOIN cities c ON c.city_name = f.city_name),
merged_loc AS (
  SELECT COALESCE(o.locality_name, n.locality_name) AS locality_name, COALESCE(o.city_id, n.city_id) AS city_id,
         o.locality_id, o.latitude, o.longitude, n.n_lat, n.n_lng, n._sr, n._ri
  FROM localities o FULL JOIN cand_loc n ON o.locality_name = n.locality_name AND o.city_id = n.city_id),
loc2 AS (
  SELECT locality_id, locality_name, city_id, COALESCE(n_lat, latitude) AS latitude,
         COALESCE(n_lng, longitude) AS longitude FROM merged_loc WHERE locality_id IS NOT NULL
  UNION ALL
  SELECT (SELECT COALESCE(MAX(locality_id), 0) FROM localities) + row_number() OVER (ORDER BY _sr, _ri),
         locality_name, city_id, n_lat, n_lng FROM merged_loc WHERE locality_id IS NULL),
first_b AS (
  SELECT * FROM (SELECT building_id, building_name, society_name, locality_name, city_name, total_floors_bld,
                        row_number() OVER (PARTITION BY building_id ORDER BY source_rank, row_id) AS rn
                 FROM clean WHERE building_id IS NOT NULL) WHERE rn = 1),
bld2 AS (
  SELECT building_id, building_name, society_name, locality_id, total_floors FROM buildings
  UNION ALL
  SELECT f.building_id, f.building_name, f.society_name, l.locality_id, f.total_floors_bld
  FROM first_b f LEFT JOIN cities c ON c.city_name = f.city_name
  LEFT JOIN loc2 l ON l.locality_name = f.locality_name AND l.city_id = c.city_id
  WHERE f.building_id NOT IN (SELECT building_id FROM buildings)),
first_a AS (
  SELECT * FROM (
    SELECT contact_name, NULLIF(COALESCE(company_name, ''), '') AS company_name,
           lower(contact_name) AS _kn, lower(COALESCE(company_name, '')) AS _kc, source_rank, row_id,
           row_number() OVER (PARTITION BY lower(contact_name), lower(COALESCE(company_name, ''))
                              ORDER BY source_rank, row_id) AS rn
    FROM clean WHERE contact_name IS NOT NULL AND lower(contact_name) NOT IN ('', 'nan', 'none')) WHERE rn = 1),
agt2 AS (
  SELECT agent_id, contact_name, company_name, phone, email, is_active FROM agents
  UNION ALL
  SELECT (SELECT COALESCE(MAX(agent_id), 0) FROM agents) + row_number() OVER (ORDER BY source_rank, row_id),
         contact_name, company_name, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), TRUE
  FROM first_a f WHERE NOT EXISTS (
    SELECT 1 FROM agents a WHERE lower(a.contact_name) = f._kn AND lower(COALESCE(a.company_name, '')) = f._kc)),
resolved AS (
  SELECT r.*, c.city_id, l.locality_id, b.building_id AS building_id_ok, am.agent_id
  FROM clean r JOIN cities c ON c.city_name = r.city_name
  LEFT JOIN loc2 l ON l.locality_name = r.locality_name AND l.city_id = c.city_id
  LEFT JOIN bld2 b ON b.building_id = r.building_id
  LEFT JOIN (SELECT contact_name, MAX(agent_id) AS agent_id FROM agt2
             WHERE contact_name IS NOT NULL GROUP BY contact_name) am ON am.contact_name = r.contact_name)
"""


def upsert_localities_sql() -> str:
    return with_all("SELECT locality_id, locality_name, city_id, latitude, longitude FROM loc2", DIM_CTES)


def insert_buildings_sql() -> str:
    return with_all("SELECT building_id, building_name, society_name, locality_id, total_floors FROM bld2", DIM_CTES)


def upsert_agents_sql() -> str:
    return with_all("SELECT agent_id, contact_name, company_name, phone, email, is_active FROM agt2", DIM_CTES)


def resolve_fks_sql() -> str:
    return with_all("""SELECT prop_id, city_id, locality_id, building_id_ok AS building_id, agent_id,
                              source_rank, row_id FROM resolved""", DIM_CTES)


def insert_if_absent_sql(order: str = "source_rank, row_id") -> str:
    return with_all(f"""
SELECT (SELECT MAX(listing_id) FROM listings) + row_number() OVER (ORDER BY {order}) AS listing_id,
       prop_id, city_id, locality_id, building_id_ok AS building_id, agent_id, price_inr, register_date,
       transact_type, is_active_new AS is_active
FROM (SELECT *, TRUE AS is_active_new FROM resolved) r
WHERE prop_id NOT IN (SELECT prop_id FROM listings)""", DIM_CTES)


def _h(salt: str, key: str = "listing_id") -> str:
    return f"('0x' || substr(md5(concat_ws('|', CAST({key} AS VARCHAR), '{salt}')), 1, 8))::BIGINT"


def synth_transactions_sql() -> str:
    first = "['Amit', 'Priya', 'Rahul', 'Sneha', 'Vikram', 'Pooja', 'Suresh', 'Kavitha', 'Arjun', 'Divya', 'Rajan', 'Meera', 'Anil', 'Sunita', 'Deepak', 'Swati']"
    last = "['Sharma', 'Patel', 'Singh', 'Gupta', 'Verma', 'Nair', 'Reddy', 'Iyer', 'Kumar', 'Joshi', 'Mehta', 'Shah', 'Das', 'Bose', 'Pillai', 'Mishra']"
    own = "['Freehold', 'Leasehold', 'Co-operative Society', 'Power of Attorney']"
    return with_bridge(f"""
SELECT 'S' || CAST(listing_id AS VARCHAR) AS txn_id, listing_id,
       CAST(round(price_inr * (CAST(0.92 AS DECIMAL(3,2))
            + CAST({_h('var')} % 16001 AS DECIMAL(10,0)) * CAST(0.00001 AS DECIMAL(6,5))), 2) AS DECIMAL(18,2)) AS sale_price,
       COALESCE(register_date + CAST(30 + {_h('days')} % 336 AS INTEGER),
                make_date(CAST(2022 + {_h('y')} % 2 AS INTEGER), CAST(1 + {_h('m')} % 12 AS INTEGER),
                          CAST(1 + {_h('d')} % 28 AS INTEGER))) AS transaction_date,
       ({first})[{_h('first')} % 16 + 1] || ' ' || ({last})[{_h('last')} % 16 + 1] AS buyer_name,
       ({own})[{_h('own')} % 4 + 1] AS ownership_type,
       CASE WHEN {_h('status')} % 100 < 80 THEN 'Completed'
            WHEN {_h('status')} % 100 < 95 THEN 'Pending' ELSE 'Cancelled' END AS status,
       CAST(NULL AS VARCHAR) AS notes
FROM chosen""", f"""
base AS (SELECT *, {_h('pick')} AS h_pick FROM listings WHERE price_inr > 0),
cnt AS (SELECT COUNT(*) FILTER (WHERE h_pick < 515396075) AS n_picked, COUNT(*) AS n FROM base),
ranked AS (SELECT *, row_number() OVER (ORDER BY h_pick, listing_id) AS rn FROM base),
chosen AS (
  SELECT * EXCLUDE (rn) FROM ranked WHERE (SELECT n_picked FROM cnt) >= 200 AND h_pick < 515396075
  UNION ALL
  SELECT * EXCLUDE (rn) FROM ranked WHERE (SELECT n_picked FROM cnt) < 200
    AND rn <= (SELECT LEAST(n, GREATEST(200, CAST(floor(n * 0.12) AS BIGINT))) FROM cnt))""")


# -- change batches --------------------------------------------------------------

def _reasons(rules: list[tuple[str, str]]) -> str:
    items = ", ".join(f"CASE WHEN COALESCE({bad}, FALSE) THEN '{code}' END" for code, bad in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _line_seq(with_order: bool = False) -> str:
    parts = ["lpad(CAST(l_linenumber AS VARCHAR), 3, '0')", "lpad(CAST(l_partkey AS VARCHAR), 12, '0')",
             "lpad(CAST(l_suppkey AS VARCHAR), 12, '0')",
             "lpad(CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR), 15, '0')"]
    if with_order:
        parts = ["lpad(CAST(l_orderkey AS VARCHAR), 12, '0')"] + parts
    return " || ".join(parts)


TXN_ID_SQL = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
              "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT))")

LISTING_CREATES = """
ch AS (
  SELECT o_orderkey AS seq,
    CASE WHEN o_orderkey % 10 = 0 THEN 'P' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 10 = 1 THEN 'N'
         WHEN o_orderkey % 10 = 9 THEN 'N' || CAST(o_orderkey - 1 AS VARCHAR)
         ELSE 'N' || CAST(o_orderkey AS VARCHAR) END AS prop_id,
    CAST(CASE WHEN o_orderkey % 10 = 2 THEN -500 ELSE o_totalprice END AS DECIMAL(18,2)) AS price_inr,
    CAST(CASE WHEN o_orderkey % 10 = 3 THEN 99 ELSE o_orderkey % 5 END AS BIGINT) AS city_id,
    CAST(CASE WHEN o_orderkey % 10 = 4 THEN 999 WHEN o_orderkey % 10 = 5 THEN NULL ELSE o_orderkey % 25 END AS BIGINT) AS locality_id,
    CAST(CASE WHEN o_orderkey % 10 = 6 THEN 3 ELSE 1 END AS SMALLINT) AS furnish_id,
    CAST(CASE WHEN o_orderkey % 10 = 7 THEN 25 ELSE o_orderkey % 6 END AS SMALLINT) AS bedroom_num,
    CAST(CASE WHEN o_orderkey % 10 = 8 THEN NULL ELSE o_orderkey % 2 + 1 END AS SMALLINT) AS transact_type,
    'New ' || CAST(o_orderkey AS VARCHAR) AS prop_name,
    CAST(NULL AS BOOLEAN) AS verified
  FROM orders),
chv AS (
  SELECT ch.*, city_id IN (SELECT city_id FROM cities) AS city_ok,
         locality_id IN (SELECT locality_id FROM localities) AS loc_ok FROM ch),
chr AS (
  SELECT chv.*, """ + _reasons([
    ("prop_id_length", "prop_id IS NULL OR NOT (length(prop_id) BETWEEN 3 AND 50)"),
    ("transact_type_range", "transact_type IS NOT NULL AND NOT (transact_type BETWEEN 1 AND 2)"),
    ("price_required", "price_inr IS NULL OR price_inr <= 0"),
    ("city_required", "city_id IS NULL"),
    ("bedroom_num_range", "bedroom_num IS NOT NULL AND NOT (bedroom_num BETWEEN 0 AND 20)"),
    ("furnish_id_domain", "furnish_id IS NOT NULL AND furnish_id NOT IN (0, 1, 2, 4)"),
    ("city_unknown", "city_id IS NOT NULL AND NOT city_ok"),
    ("locality_unknown", "locality_id IS NOT NULL AND NOT loc_ok"),
]) + """ AS reasons FROM chv)
"""


def validate_listings_sql() -> str:
    return with_bridge("SELECT seq, prop_id, len(reasons) = 0 AS is_valid, array_to_string(reasons, ',') AS reason_list FROM chr",
                       LISTING_CREATES)


def create_listings_sql() -> str:
    return with_bridge("""
SELECT (SELECT MAX(listing_id) FROM listings) + row_number() OVER (ORDER BY seq) AS listing_id,
       prop_id, price_inr, city_id, locality_id, CAST(COALESCE(transact_type, 1) AS SMALLINT) AS transact_type,
       COALESCE(verified, FALSE) AS verified, TRUE AS is_active, bedroom_num, furnish_id
FROM ok""", LISTING_CREATES + """,
chr2 AS (SELECT chr.*, list_concat(reasons, CASE WHEN prop_id IN (SELECT prop_id FROM listings)
                                                THEN ['prop_id_exists'] ELSE [] END) AS reasons2 FROM chr),
firsts AS (SELECT prop_id, MIN(seq) AS first_seq FROM chr2 WHERE len(reasons2) = 0 GROUP BY prop_id),
ok AS (SELECT chr2.* FROM chr2 JOIN firsts f ON f.prop_id = chr2.prop_id AND f.first_seq = chr2.seq
       WHERE len(reasons2) = 0)""")


def update_listings_sql() -> str:
    return with_bridge("""
SELECT l.listing_id,
       CASE WHEN a.s_price THEN a.v_price ELSE l.price_inr END AS price_inr,
       CASE WHEN a.s_verified THEN a.v_verified ELSE l.verified END AS verified,
       CASE WHEN a.s_description THEN a.v_description ELSE l.description END AS description,
       CASE WHEN a.s_active THEN a.v_active ELSE l.is_active END AS is_active,
       CASE WHEN a.s_bed THEN a.v_bed ELSE l.bedroom_num END AS bedroom_num,
       a.listing_id IS NOT NULL AS was_updated
FROM listings l LEFT JOIN agg a ON a.listing_id = l.listing_id""", f"""
u AS (
  SELECT {_line_seq()} AS seq,
         CASE WHEN l_linenumber = 7 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS listing_id,
         CASE l_linenumber % 4 WHEN 0 THEN ['price_inr'] WHEN 1 THEN ['price_inr', 'verified']
              WHEN 2 THEN ['description'] ELSE ['is_active', 'bedroom_num'] END AS set_cols,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price_inr, l_returnflag = 'R' AS verified,
         CAST(NULL AS VARCHAR) AS description, l_linestatus = 'O' AS is_active,
         CAST(l_quantity AS SMALLINT) AS bedroom_num
  FROM lineitem),
uv AS (
  SELECT * FROM u
  WHERE listing_id IN (SELECT listing_id FROM listings)
    AND NOT COALESCE(list_contains(set_cols, 'price_inr') AND price_inr IS NOT NULL AND price_inr <= 0, FALSE)
    AND NOT COALESCE(list_contains(set_cols, 'bedroom_num') AND bedroom_num IS NOT NULL
                     AND NOT (bedroom_num BETWEEN 0 AND 20), FALSE)),
agg AS (
  SELECT listing_id,
         arg_max(price_inr, seq) FILTER (WHERE list_contains(set_cols, 'price_inr')) AS v_price,
         bool_or(list_contains(set_cols, 'price_inr')) AS s_price,
         arg_max(verified, seq) FILTER (WHERE list_contains(set_cols, 'verified')) AS v_verified,
         bool_or(list_contains(set_cols, 'verified')) AS s_verified,
         arg_max(description, seq) FILTER (WHERE list_contains(set_cols, 'description')) AS v_description,
         bool_or(list_contains(set_cols, 'description')) AS s_description,
         arg_max(is_active, seq) FILTER (WHERE list_contains(set_cols, 'is_active')) AS v_active,
         bool_or(list_contains(set_cols, 'is_active')) AS s_active,
         arg_max(bedroom_num, seq) FILTER (WHERE list_contains(set_cols, 'bedroom_num')) AS v_bed,
         bool_or(list_contains(set_cols, 'bedroom_num')) AS s_bed
  FROM uv GROUP BY listing_id)""")


RETURNED_IDS = """
ids AS (SELECT l_orderkey AS listing_id FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL SELECT l_orderkey + 1000000000 FROM lineitem WHERE l_linenumber = 7)"""


def delete_listings_soft_sql() -> str:
    return with_bridge("""
SELECT listing_id, CASE WHEN listing_id IN (SELECT listing_id FROM ids) THEN FALSE ELSE is_active END AS is_active,
       listing_id IN (SELECT listing_id FROM ids) AS soft_deleted
FROM listings""", RETURNED_IDS)


def delete_listings_hard_sql() -> str:
    return with_bridge("""
SELECT 'listings' AS table_name, COUNT(*) AS row_count FROM listings WHERE listing_id NOT IN (SELECT listing_id FROM ids)
UNION ALL
SELECT 'transactions', COUNT(*) FROM transactions WHERE listing_id NOT IN (SELECT listing_id FROM ids)
UNION ALL
SELECT 'rejects', COUNT(DISTINCT listing_id) FROM ids WHERE listing_id NOT IN (SELECT listing_id FROM listings)""",
                       RETURNED_IDS)


def create_transactions_sql() -> str:
    return with_bridge("""
SELECT 'B1-' || CAST(row_number() OVER (ORDER BY seq) AS VARCHAR) AS txn_id, listing_id, sale_price,
       transaction_date, COALESCE(status, 'Completed') AS status
FROM ok""", f"""
c AS (
  SELECT {_line_seq(True)} AS seq,
         CASE WHEN l_linenumber = 7 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS listing_id,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - 1000 AS DECIMAL(18,2)) AS sale_price,
         CAST(l_shipdate AS DATE) AS transaction_date,
         CASE l_returnflag WHEN 'N' THEN NULL WHEN 'A' THEN 'Pending' ELSE 'Refunded' END AS status
  FROM lineitem),
ok AS (
  SELECT * FROM c WHERE listing_id IN (SELECT listing_id FROM listings) AND sale_price > 0
    AND transaction_date IS NOT NULL AND (status IS NULL OR status IN ('Completed', 'Pending', 'Cancelled')))""")


def update_transactions_sql() -> str:
    return with_bridge("""
SELECT t.txn_id,
       CASE WHEN list_contains(u.set_cols, 'sale_price') THEN u.sale_price ELSE t.sale_price END AS sale_price,
       CASE WHEN list_contains(u.set_cols, 'status') THEN u.status ELSE t.status END AS status,
       CASE WHEN list_contains(u.set_cols, 'notes') THEN u.notes ELSE t.notes END AS notes
FROM transactions t LEFT JOIN uv u ON u.txn_id = t.txn_id""", f"""
u AS (
  SELECT CASE WHEN l_linenumber = 7 THEN {TXN_ID_SQL} || '-x' ELSE {TXN_ID_SQL} END AS txn_id,
         CASE l_linenumber % 3 WHEN 0 THEN ['status'] WHEN 1 THEN ['notes'] ELSE ['sale_price'] END AS set_cols,
         CASE l_returnflag WHEN 'N' THEN 'Cancelled' WHEN 'A' THEN 'Completed' ELSE 'Bogus' END AS status,
         'checked ' || CAST(l_partkey AS VARCHAR) AS notes,
         CAST(CASE WHEN l_quantity > 45 THEN -1 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) + 1 END AS DECIMAL(18,2)) AS sale_price
  FROM lineitem),
uv AS (
  SELECT * FROM u WHERE txn_id IN (SELECT txn_id FROM transactions)
    AND NOT COALESCE(list_contains(set_cols, 'sale_price') AND (sale_price IS NULL OR sale_price <= 0), FALSE)
    AND NOT COALESCE(list_contains(set_cols, 'status') AND status IS NOT NULL
                     AND status NOT IN ('Completed', 'Pending', 'Cancelled'), FALSE))""")


def delete_transactions_sql() -> str:
    return with_bridge("SELECT txn_id, listing_id FROM transactions WHERE txn_id NOT IN (SELECT txn_id FROM ids)", f"""
ids AS (SELECT {TXN_ID_SQL} AS txn_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'
        UNION ALL SELECT 'none-' || CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 7)""")


EMAIL_SQL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def create_agents_sql() -> str:
    return with_bridge("""
SELECT (SELECT MAX(agent_id) FROM agents) + row_number() OVER (ORDER BY seq) AS agent_id,
       contact_name, company_name, phone, email, TRUE AS is_active FROM ok""", f"""
c AS (
  SELECT c_custkey AS seq, CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE 'New ' || c_name END AS contact_name,
         c_mktsegment AS company_name, '+91-' || CAST(c_custkey AS VARCHAR) AS phone,
         CASE WHEN c_custkey % 7 = 0 THEN 'bad-email'
              ELSE 'new' || CAST(c_custkey AS VARCHAR) || '@agents.example' END AS email
  FROM customer),
ok AS (SELECT * FROM c WHERE length(contact_name) BETWEEN 2 AND 200
       AND (email IS NULL OR regexp_full_match(email, '{EMAIL_SQL_RE}')))""")


def update_agents_sql() -> str:
    return with_bridge("""
SELECT a.agent_id,
       CASE WHEN list_contains(u.set_cols, 'phone') THEN u.phone ELSE a.phone END AS phone,
       CASE WHEN list_contains(u.set_cols, 'email') THEN u.email ELSE a.email END AS email,
       CASE WHEN list_contains(u.set_cols, 'is_active') THEN u.is_active ELSE a.is_active END AS is_active
FROM agents a LEFT JOIN uv u ON u.agent_id = a.agent_id""", f"""
u AS (
  SELECT CASE WHEN c_custkey % 13 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS agent_id,
         CASE c_custkey % 3 WHEN 0 THEN ['phone'] WHEN 1 THEN ['email'] ELSE ['is_active'] END AS set_cols,
         '+91-99' || CAST(c_custkey AS VARCHAR) AS phone,
         CASE WHEN c_custkey % 2 = 0 THEN 'oops' ELSE 'upd' || CAST(c_custkey AS VARCHAR) || '@agents.example' END AS email,
         c_acctbal > 1000 AS is_active
  FROM customer),
uv AS (
  SELECT * FROM u WHERE agent_id IN (SELECT agent_id FROM agents)
    AND NOT COALESCE(list_contains(set_cols, 'email') AND email IS NOT NULL
                     AND NOT regexp_full_match(email, '{EMAIL_SQL_RE}'), FALSE)
    AND NOT COALESCE(list_contains(set_cols, 'phone') AND length(phone) > 30, FALSE))""")


def deactivate_agents_sql() -> str:
    return with_bridge("""
SELECT agent_id, CASE WHEN agent_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 100) THEN FALSE
                      ELSE is_active END AS is_active
FROM agents""")


def referential_actions_sql() -> str:
    return with_bridge("""
SELECT listing_id,
       CASE WHEN locality_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3) THEN NULL ELSE locality_id END AS locality_id,
       CASE WHEN building_id IN (SELECT p_partkey FROM part WHERE p_size > 45) THEN NULL ELSE building_id END AS building_id,
       CASE WHEN agent_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN NULL ELSE agent_id END AS agent_id
FROM listings""")


# -- streaming -------------------------------------------------------------------

FEED_STATE = """
fed AS (
  SELECT l.* REPLACE (
           CASE l.listing_id % 8 WHEN 1 THEN l.price_inr + 1 WHEN 3 THEN l.price_inr + 1
                WHEN 7 THEN l.price_inr + 2 ELSE l.price_inr END::DECIMAL(18,2) AS price_inr,
           l.listing_id % 8 = 1 OR l.verified AS verified)
  FROM listings l WHERE l.listing_id % 8 NOT IN (2, 4, 6))
"""


def change_feed_sql() -> str:
    return with_bridge("""
SELECT prop_id, price_inr, verified, is_active, city_id, transact_type FROM fed
UNION ALL
SELECT 'S' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0'),
       CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 40 = 0 THEN 5 ELSE 0 END, TRUE, TRUE,
       CAST(o_orderkey % 5 AS BIGINT), CAST(1 AS SMALLINT)
FROM orders WHERE o_orderkey % 8 = 0""", FEED_STATE)


def change_feed_rejects_sql() -> str:
    return """
SELECT o_orderkey * 10 + i AS seq, op, reason_list
FROM orders JOIN (VALUES
    (0, 0, 'create', 'price_required', TRUE), (0, 1, 'create', 'prop_id_exists', FALSE),
    (2, 1, 'update', 'not_found', NULL), (3, 1, 'update', 'price_inr_positive', NULL),
    (5, 0, 'update', 'not_found', NULL), (5, 1, 'update', 'not_found', NULL),
    (6, 1, 'delete', 'not_found', NULL), (7, 0, 'create', CAST(NULL AS VARCHAR), NULL)
  ) r(m, i, op, reason, forty) ON o_orderkey % 8 = r.m
     AND (r.forty IS NULL OR r.forty = (o_orderkey % 40 = 0)),
  LATERAL (SELECT coalesce(reason, CASE WHEN o_orderkey < 10 THEN 'prop_id_length,prop_id_exists'
                                        ELSE 'prop_id_exists' END) AS reason_list)
"""


def change_feed_trends_sql() -> str:
    return with_bridge(_trends_select("fed", "register_date"), FEED_STATE)


def ingest_csv_sql() -> str:
    return with_raw("SELECT prop_id, source_rank, price_inr, city_name, locality_name, register_date FROM clean",
                    normalized_ctes() + ",\n" + CLEAN_CTE.strip())


def upsert_cities_sql() -> str:
    names = ", ".join(f"('{n}')" for n in ("Gurgaon", "Hyderabad", "Kolkata", "Mumbai"))
    return with_bridge(f"""
SELECT city_id, city_name, city_code FROM cities
UNION ALL
SELECT (SELECT MAX(city_id) FROM cities) + row_number() OVER (ORDER BY city_name), city_name, substr(city_name, 1, 3)
FROM (SELECT DISTINCT city_name FROM (VALUES {names}) v(city_name)
      WHERE city_name NOT IN (SELECT city_name FROM cities))""")


# -- lookups, rejects and stored views ----------------------------------------------

def agent_lookup_sql() -> str:
    return with_bridge("""
SELECT k.id AS requested_key, a.agent_id IS NOT NULL AS found, a.*
FROM (SELECT DISTINCT unnest([o_custkey, -o_orderkey - 1]) AS id FROM orders) k LEFT JOIN agents a ON a.agent_id = k.id
""")


def txn_lookup_sql() -> str:
    return with_bridge("""
SELECT k.id AS requested_key, t.txn_id IS NOT NULL AS found, t.*, l.property_type, c.city_name, p.locality_name
FROM (SELECT DISTINCT unnest([txn_id, 'none-' || listing_id]) AS id FROM transactions) k
LEFT JOIN transactions t ON t.txn_id = k.id LEFT JOIN listings l ON l.listing_id = t.listing_id
LEFT JOIN cities c ON c.city_id = l.city_id LEFT JOIN localities p ON p.locality_id = l.locality_id
""")


def create_listings_rejects_sql() -> str:
    return """
SELECT o_orderkey AS seq, concat_ws(',',
    CASE WHEN length(prop) < 3 THEN 'prop_id_length' END, CASE m WHEN 2 THEN 'price_required' WHEN 7 THEN
    'bedroom_num_range' WHEN 6 THEN 'furnish_id_domain' WHEN 3 THEN 'city_unknown' WHEN 4 THEN 'locality_unknown' END,
    CASE WHEN m = 0 THEN 'prop_id_exists' END) AS reason_list
FROM (SELECT o_orderkey, o_orderkey % 10 AS m, CASE o_orderkey % 10 WHEN 0 THEN 'P' || o_orderkey WHEN 1 THEN 'N'
        WHEN 9 THEN 'N' || (o_orderkey - 1) ELSE 'N' || o_orderkey END AS prop FROM orders)
WHERE length(prop) < 3 OR m IN (0, 2, 3, 4, 6, 7)
UNION ALL
SELECT o_orderkey, 'prop_id_duplicate_in_batch' FROM orders
WHERE o_orderkey % 10 = 9 AND length('N' || (o_orderkey - 1)) >= 3
  AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders)
"""


def txn_rejects_sql() -> str:
    """Rejected creates, updates and deletes of deals: how many, by reasons."""
    return with_bridge("""
SELECT 'create' AS change, reasons, count(*) AS n FROM (
    SELECT concat_ws(',', CASE WHEN l_linenumber = 7 THEN 'listing_unknown' END,
        CASE WHEN CAST(l_extendedprice AS DECIMAL(18,2)) - 1000 <= 0 THEN 'sale_price_required' END,
        CASE WHEN l_returnflag NOT IN ('N', 'A') THEN 'status_domain' END) AS reasons FROM lineitem) GROUP BY reasons HAVING reasons <> ''
UNION ALL
SELECT 'update', reasons, count(*) FROM (
    SELECT concat_ws(',', CASE WHEN l_linenumber = 7 THEN 'not_found' END,
        CASE WHEN l_linenumber % 3 = 2 AND (l_quantity > 45 OR l_extendedprice + 1 <= 0) THEN 'sale_price_positive' END,
        CASE WHEN l_linenumber % 3 = 0 AND l_returnflag NOT IN ('N', 'A') THEN 'status_domain' END) AS reasons
    FROM lineitem) GROUP BY reasons HAVING reasons <> ''
UNION ALL
SELECT 'delete', 'not_found', count(DISTINCT l_orderkey) FROM lineitem WHERE l_linenumber = 7 HAVING count(*) > 0
""")


def agent_rejects_sql() -> str:
    return """
SELECT 'create' AS change, c_custkey AS key, concat_ws(',', CASE WHEN c_custkey % 10 = 0 THEN 'contact_name_length' END,
    CASE WHEN c_custkey % 7 = 0 THEN 'email_format' END) AS reason_list
FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 7 = 0
UNION ALL
SELECT 'deactivate', c_custkey + 1000000000, 'not_found' FROM customer WHERE c_custkey % 13 = 0
"""


def listing_rejects_sql() -> str:
    """Rejected updates, soft deletes and hard deletes of listings."""
    return """
SELECT 'update' AS change, reason_list, count(*) AS n FROM (
    SELECT concat_ws(',', CASE WHEN l_linenumber = 7 THEN 'not_found' END,
        CASE WHEN l_linenumber % 4 = 3 AND l_quantity > 20 THEN 'bedroom_num_range' END) AS reason_list FROM lineitem)
WHERE reason_list <> '' GROUP BY reason_list
UNION ALL
SELECT k, 'not_found', count(DISTINCT l_orderkey) FROM lineitem, (VALUES ('soft'), ('hard')) v(k)
WHERE l_linenumber = 7 GROUP BY k
"""


def city_view_sql(view: str, touched: tuple[str, ...]) -> str:
    """A view's rows of the touched cities from all listings, of the others
    from every third one."""
    names = ", ".join(f"'{n}'" for n in touched)
    third = view.replace("FROM listings WHERE price_sqft", "FROM listings WHERE listing_id % 3 = 0 AND price_sqft")
    return f"SELECT * FROM ({view}) WHERE city_name IN ({names}) UNION ALL SELECT * FROM ({third}) WHERE city_name NOT IN ({names})"


def reference_graph_sql() -> str:
    """What is left of each table, and the requests that are refused. City 4
    has no listings, so it goes, with its localities."""
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), '-')"
    return with_bridge(f"""
SELECT 'cities' AS table_name, CAST(city_id AS VARCHAR) AS key, '' AS refs, NULL AS reason FROM cities WHERE city_id <> 4
UNION ALL SELECT 'cities', CAST(city_id AS VARCHAR), NULL, 'referenced_by_listings' FROM cities WHERE city_id <> 4
UNION ALL SELECT 'cities', CAST(city_id + 100 AS VARCHAR), NULL, 'not_found' FROM cities
UNION ALL SELECT 'localities', CAST(locality_id AS VARCHAR), {text('city_id')}, NULL FROM localities WHERE city_id NOT IN (3, 4)
UNION ALL SELECT 'buildings', CAST(building_id AS VARCHAR), {text('CASE WHEN locality_id NOT IN (SELECT * FROM gone_loc) THEN locality_id END')}, NULL
          FROM buildings WHERE building_id NOT IN (SELECT * FROM gone_bld)
UNION ALL SELECT 'buildings', CAST(-p_partkey - 1 AS VARCHAR), NULL, 'not_found' FROM part WHERE p_size > 45
UNION ALL SELECT 'agents', CAST(agent_id AS VARCHAR), '', NULL FROM agents WHERE agent_id NOT IN (SELECT * FROM gone_agt)
UNION ALL SELECT 'listings', CAST(listing_id AS VARCHAR),
       {text('CASE WHEN building_id NOT IN (SELECT * FROM gone_bld) THEN building_id END')} || ',' ||
       {text('CASE WHEN agent_id NOT IN (SELECT * FROM gone_agt) THEN agent_id END')} || ',' || {text('city_id')} || ',' ||
       {text('CASE WHEN locality_id NOT IN (SELECT * FROM gone_loc) THEN locality_id END')}, NULL
       FROM listings WHERE city_id <> 4 AND listing_id % 7 <> 0
UNION ALL SELECT 'transactions', txn_id, {text('listing_id')}, NULL FROM transactions
       WHERE listing_id NOT IN (SELECT listing_id FROM listings WHERE city_id <> 4 AND listing_id % 7 = 0)
""", """
gone_loc AS (SELECT locality_id FROM localities WHERE city_id IN (3, 4)),
gone_bld AS (SELECT p_partkey FROM part WHERE p_size > 45),
gone_agt AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")


def create_listings_all_fks_sql() -> str:
    return with_bridge("""
SELECT prop_id, NULL::BIGINT AS seq, NULL::VARCHAR AS reason_list FROM ok
UNION ALL SELECT NULL, seq, array_to_string(CASE WHEN len(reasons3) = 0 THEN ['prop_id_duplicate_in_batch'] ELSE reasons3 END, ',')
FROM chr3 WHERE seq NOT IN (SELECT seq FROM ok)""", LISTING_CREATES + """,
chr3 AS (SELECT chr.*, list_concat(list_concat(list_concat(reasons,
             CASE WHEN seq % 20 = 12 THEN ['building_unknown'] ELSE [] END),
             CASE WHEN seq % 10 = 8 THEN ['agent_unknown'] ELSE [] END),
             CASE WHEN prop_id IN (SELECT prop_id FROM listings) THEN ['prop_id_exists'] ELSE [] END) AS reasons3 FROM chr),
firsts AS (SELECT prop_id, MIN(seq) AS first_seq FROM chr3 WHERE len(reasons3) = 0 GROUP BY prop_id),
ok AS (SELECT chr3.* FROM chr3 JOIN firsts f ON f.prop_id = chr3.prop_id AND f.first_seq = chr3.seq
       WHERE len(reasons3) = 0)""")


def city_delete_sql() -> str:
    return with_bridge("""
SELECT building_id, CASE WHEN locality_id IN (SELECT locality_id FROM localities WHERE city_id IN (
         SELECT city_id FROM cities EXCEPT SELECT city_id FROM listings WHERE city_id <> 4))
       THEN NULL ELSE locality_id END AS locality_id
FROM buildings
""")
