"""Raw per-city listing rows derived from the driver's tables.

The ingest path consumes all-string city files with messy prices, dates and
dict-literal location columns. No such files ship with the test data, so
these frames render every ``orders`` row into that raw form (one city per
region, file order = region key, row order = order key), covering each
input case of the parsers. ``propcube.plans.oracle.RAW`` renders the same
strings in DuckDB. Different cities carry different column sets, like the
real files do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propcube.sources.tables import read_table

# Columns missing from each city's file (by region key).
CITY_MISSING_COLUMNS = {
    0: ("REGISTER_DATE", "MIN_AREA_SQFT", "MAX_AREA_SQFT", "CONTACT_NAME", "CONTACT_COMPANY_NAME"),
    1: ("MAX_AREA_SQFT", "AREA", "CONTACT_NAME", "CONTACT_COMPANY_NAME"),
    2: ("AREA",),
    3: ("AREA", "TRANSACT_TYPE", "FURNISH", "CONTACT_NAME", "CONTACT_COMPANY_NAME", "VERIFIED"),
    4: ("AREA",),
}


def _s(c: Column) -> Column:
    return c.cast("string")


def _pick(k: Column, mod: int, cases: list[Column]) -> Column:
    out = None
    for i, v in enumerate(cases):
        out = (F.when(k % mod == i, v) if out is None else out.when(k % mod == i, v))
    return out


def raw_rows(spark: SparkSession, sf_dir: str, region_key: int | None = None) -> DataFrame:
    """Every order as one raw listing row (all columns, all strings).

    With ``region_key`` only that city's rows are rendered: the (25-row,
    fixed-size) nation lookup is filtered first, so other orders drop out
    at the join right after the scan.
    """
    o = read_table(spark, sf_dir, "orders")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    if region_key is not None:
        nation = nation.where(F.col("n_regionkey") == region_key)
        region = region.where(F.col("r_regionkey") == region_key)
    j = (o.join(nation, (F.col("o_orderkey") % 25).cast("int") == F.col("n_nationkey"))
          .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    return j.select(*_raw_columns(spark))


_COLUMN_CACHE: dict[int, list] = {}


def _raw_columns(spark: SparkSession) -> list[Column]:
    """The fixture's select list, built once per session and reused for
    every city (unresolved Columns bind to whichever frame selects them)."""
    key = spark.sparkContext.applicationId
    if key not in _COLUMN_CACHE:
        _COLUMN_CACHE[key] = _build_raw_columns()
    return _COLUMN_CACHE[key]


def _build_raw_columns() -> list[Column]:
    k = F.col("o_orderkey")
    rupees = F.floor("o_totalprice").cast("bigint")
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    od = F.to_date("o_orderdate")
    day = F.dayofmonth(od)
    suffix = (F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd")
               .when(day.isin(3, 23), "rd").otherwise("th"))
    mon = F.date_format(od, "MMM")
    yr = _s(F.year(od))
    two = lambda c: F.lpad(_s(c), 2, "0")
    dec2 = lambda whole, frac: F.concat(_s(whole), F.lit("."), two(frac))
    small_a = dec2(F.call_function("div", rupees % 300, F.lit(100)), rupees % 100)
    small_b = dec2(F.call_function("div", (rupees + 1) % 300, F.lit(100)), (rupees + 1) % 100)
    kilo = _s(F.call_function("div", rupees, F.lit(1000)))
    price = _pick(k, 10, [
        F.concat(dec2(F.call_function("div", cents, F.lit(1000000)),
                      F.call_function("div", cents, F.lit(10000)) % 100), F.lit(" Cr")),
        F.concat(dec2(F.call_function("div", cents, F.lit(100000)),
                      F.call_function("div", cents, F.lit(1000)) % 100), F.lit(" L")),
        F.format_number(rupees, 0),
        F.concat(kilo, F.lit(" - "), _s(F.call_function("div", rupees, F.lit(1000)) + 5), F.lit(" L")),
        F.lit("Price on Request"),
        F.concat(kilo, F.lit(" L Onwards")),
        F.concat(_s(rupees % 100), F.lit(",000/Bedroom")),
        F.concat(kilo, F.lit(" Lac")),
        F.concat(F.lit("0 - "), kilo, F.lit(" L")),
        _pick(F.call_function("div", k, F.lit(10)), 4, [
            F.lit("nan"), F.lit(""), F.lit("₹5 L"),
            F.concat(small_a, F.lit("  - "), small_b, F.lit(" Cr"))]),
    ])
    reg = _pick(k, 8, [
        F.concat(_s(day), suffix, F.lit(" "), mon, F.lit(", "), yr),
        F.upper(F.date_format(od, "dd MMM, yyyy")),
        F.date_format(od, "yyyy-MM-dd"),
        F.concat(_s(day), F.lit("/"), _s(F.month(od)), F.lit("/"), yr),
        F.lit(None).cast("string"),
        F.concat(F.date_format(od, "yyyy-MM-dd"), F.lit(" 00:00:00")),
        F.concat(_s(day), F.lit(" "), mon, F.lit(", "), _s(F.year(od) % 100)),
        F.when(k % 16 == 7, F.concat(F.lit("31 Feb, "), yr))
         .otherwise(F.concat(_s(day), F.lit("  "), mon, F.lit(",  "), yr)),
    ])
    name = F.col("n_name")
    bid_old = _s(k % 200 + 1)
    bid_new = _s(F.lit(1000000) + k % 5000)
    location = _pick(k, 6, [
        F.concat(F.lit("{'LOCALITY_NAME': '"), name, F.lit("', 'BUILDING_ID': "), bid_old,
                 F.lit(", 'BUILDING_NAME': 'Tower "), _s(k % 50), F.lit("', 'SOCIETY_NAME': 'Society "),
                 _s(k % 40), F.lit("'}")),
        F.concat(F.lit("{'LOCALITY_NAME': ' "), name, F.lit(" ', 'BUILDING_ID': '"), bid_new, F.lit(".0'}")),
        F.concat(F.lit('{"LOCALITY_NAME": "'), name, F.lit("'s Rd\", 'BUILDING_ID': None, 'VERIFIED': True}")),
        F.concat(F.lit("{'LOCALITY_NAME': '"), name, F.lit("\\xa0East', 'BUILDING_ID': 0}")),
        F.lit("garbage"),
        F.lit(None).cast("string"),
    ])
    lat = F.concat(_s(F.col("n_nationkey") + 10), F.lit("."), F.lpad(_s(k % 1000), 3, "0"))
    lng = F.concat(_s(F.col("n_nationkey") + 70), F.lit("."), F.lpad(_s(k % 997), 3, "0"))
    map_details = _pick(k, 4, [
        F.concat(F.lit("{'LATITUDE': '"), lat, F.lit("', 'LONGITUDE': '"), lng, F.lit("'}")),
        F.concat(F.lit("{'LATITUDE': "), lat, F.lit(", 'LONGITUDE': "), lng, F.lit("}")),
        F.lit("{'LATITUDE': 0, 'LONGITUDE': ''}"),
        F.lit(None).cast("string"),
    ])
    area = F.lit(400) + (k % 37) * 50
    prop_id = (F.when(k % 50 == 7, F.concat(F.lit("P"), _s(k)))
                .when(k % 50 == 9, F.concat(F.lit("R"), _s(k - 1)))
                .when(k % 50 == 13, F.lit(None).cast("string"))
                .otherwise(F.concat(F.lit("R"), _s(k))))
    agent_no = _s(F.col("o_custkey") % 300)
    contact = (F.when(k % 11 == 0, F.lit("nan"))
                .when(k % 7 == 0, F.upper(F.concat(F.lit("agent "), agent_no)))
                .otherwise(F.concat(F.lit("Agent "), agent_no)))
    return [
        F.col("r_name").alias("city_name"),
        F.col("r_regionkey").cast("int").alias("source_rank"),
        k.alias("row_id"),
        prop_id.alias("PROP_ID"),
        F.when(k % 23 == 0, F.lit(None).cast("string"))
         .otherwise(F.substr("o_orderpriority", F.lit(3))).alias("PROPERTY_TYPE"),
        _pick(k, 5, [F.lit("1"), F.lit("2"), F.lit(""), F.lit("0"), F.lit("2.0")]).alias("TRANSACT_TYPE"),
        F.when(k % 9 == 0, F.lit("")).when(k % 9 == 1, F.lit("abc"))
         .when(k % 9 == 2, F.concat(_s(k % 7), F.lit(".0"))).otherwise(_s(k % 7)).alias("BEDROOM_NUM"),
        _s(k % 5).alias("BATHROOM_NUM"),
        F.when(k % 13 == 0, F.lit("-1")).otherwise(_s(k % 4)).alias("BALCONY_NUM"),
        _pick(k, 6, [F.lit("0"), F.lit("1"), F.lit("2"), F.lit("4"), F.lit("3"), F.lit("x")]).alias("FURNISH"),
        F.when(k % 17 == 0, F.lit("99999")).otherwise(_s(k % 40)).alias("AGE"),
        _s(k % 25).alias("FLOOR_NUM"),
        _s(k % 30 + 1).alias("TOTAL_FLOOR"),
        F.when(k % 7 == 0, F.lit("0")).when(k % 7 == 1, F.lit("-5"))
         .otherwise(_s(F.call_function("div", rupees, area))).alias("PRICE_SQFT"),
        _s(area).alias("MIN_AREA_SQFT"),
        _s(area + 100).alias("MAX_AREA_SQFT"),
        _s(area).alias("AREA"),
        price.alias("PRICE"),
        _pick(k, 5, [F.lit("Y"), F.lit("Yes"), F.lit("1"), F.lit("N"), F.lit("")]).alias("VERIFIED"),
        reg.alias("REGISTER_DATE"),
        F.when(k % 3 != 0, F.date_format(F.date_add(od, 365), "yyyy-MM-dd")).alias("EXPIRY_DATE"),
        location.alias("location"),
        map_details.alias("MAP_DETAILS"),
        contact.alias("CONTACT_NAME"),
        F.concat(F.lit("Co "), _s(F.col("o_custkey") % 40)).alias("CONTACT_COMPANY_NAME"),
        F.concat(F.lit("Tower "), _s(F.col("o_custkey"))).alias("PROP_NAME"),
        F.when(k % 3 == 0, F.lit("Lift, Parking")).alias("AMENITIES"),
        F.when(k % 101 == 0, F.repeat(F.lit("abcdefghij"), 210))
         .otherwise(F.concat(F.lit("Status "), F.col("o_orderstatus"))).alias("DESCRIPTION"),
    ]


def city_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One raw frame per city (region), each with its own column set."""
    cities = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()
    out = {}
    for key, name in sorted((int(a), b) for a, b in cities):
        drop = CITY_MISSING_COLUMNS.get(key % 5, ())
        out[name] = raw_rows(spark, sf_dir, key).drop("city_name", "source_rank", *drop)
    return out


def write_ragged_csvs(spark: SparkSession, sf_dir: str, root: str) -> dict[str, str]:
    """One header CSV folder per city, of texts with quotes, commas and line
    breaks; every 97th record has a field too many. City -> folder."""
    k = F.col("o_orderkey")
    text = (F.when(k % 3 == 0, F.concat(F.lit('Tower "'), _s(k % 50), F.lit('",\nby the "park"\n')))
             .when(k % 3 == 1, F.concat(F.lit("Flat, "), F.col("o_orderstatus"))).otherwise(F.col("o_orderpriority")))
    row = F.to_csv(F.struct(F.concat(F.lit("R"), _s(k)), text, _s(F.col("o_custkey"))), {"escape": '"', "ignoreTrailingWhiteSpace": "false"})
    record = F.concat(row, F.when(k % 97 == 0, F.lit(",one too many")).otherwise(F.lit("")))
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("o_nation"), "n_regionkey")
    rows = (read_table(spark, sf_dir, "orders").withColumn("o_nation", k % 25).join(nation, "o_nation")
            .select(F.col("n_regionkey").alias("city"), (k + 1).alias("at"), record.alias("value")))
    regions = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    header = regions.select(F.col("r_regionkey").alias("city"), F.lit(0).cast("long").alias("at"),
                            F.lit("PROP_ID,DESCRIPTION,AGENT").alias("value"))
    (header.unionByName(rows.select(F.col("city").cast(header.schema["city"].dataType).alias("city"), F.col("at").cast("long").alias("at"), "value"))
     .repartition("city").sortWithinPartitions("city", "at").select("city", "value").write.partitionBy("city").text(root))
    return {r["r_name"]: f"city={r['r_regionkey']}" for r in regions.collect()}


def literal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locality literals that hold any text: every document's text inside a
    dict as Python would write it, in six styles by doc_id (the last two are
    no literals)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.col("text")
    for raw, written in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\x85", "\\x85"), ("é", "\\u00e9")):
        body = F.replace(body, F.lit(raw), F.lit(written))
    quoted = F.concat(F.lit("'"), body, F.lit("'"))
    k = F.col("doc_id")
    literal = _pick(k, 6, [
        F.concat(F.lit("{'LOCALITY_NAME': "), quoted, F.lit(", 'BUILDING_ID': "), _s(k), F.lit(",}")),
        F.concat(F.lit("{'X': (1, 'True, (', [None, {'y': (2,)}]), 'BUILDING_NAME': 'Plot: True, near', \"LOCALITY_NAME\": "),
                 quoted, F.lit("}")),
        F.concat(F.lit("{'SOCIETY_NAME': 'Green' \" 'Park'\", 'LOCALITY_NAME': "), quoted, F.lit(", 'Z': {1, 2}}")),
        F.concat(F.lit("{'BUILDING_ID': 0x"), F.lower(F.hex(k)), F.lit(", 'BUILDING_NAME': "), quoted,
                 F.lit(", 'LOCALITY_NAME': ' \\x41\\101\\u0041\\t', True: None}")),
        F.concat(F.lit("{'LOCALITY_NAME': "), quoted),
        F.col("text"),
    ])
    return d.select("doc_id", literal.alias("location"), F.lit(None).cast("string").alias("MAP_DETAILS"))


_MATERIALIZED: dict[tuple, dict[str, str]] = {}


def stored_city_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The raw city frames written once per session as parquet files under
    the shared storage root (like landed city files), then read back.

    Ingest plans then start from plain string columns, as they do on real
    files, instead of carrying the fixture's rendering expressions.
    """
    from propcube.session import scratch_path
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MATERIALIZED:
        root = scratch_path(spark, "raw-city-files")
        paths = {}
        for city, df in city_frames(spark, sf_dir).items():
            path = f"{root}/{city.lower().replace(' ', '_')}"
            df.write.mode("errorifexists").parquet(path)
            paths[city] = path
        _MATERIALIZED[key] = paths
    return {city: spark.read.parquet(path) for city, path in _MATERIALIZED[key].items()}
