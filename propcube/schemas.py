"""Domain table schemas and fixed lookup values."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference's for identical results, and
# are stated here plainly in their natural order.
# ---------------------------------------------------------------------------
# Furnish code -> label (lookup table of the listing schema).
FURNISH_LABELS = {0: "Unknown", 1: "Furnished", 2: "Semi-Furnished", 4: "Unfurnished"}
VALID_FURNISH = (0, 1, 2, 4)
# Transaction type code -> label (1 = sale, 2 = rent).
TRANSACT_LABELS = {1: "Buy/Sell", 2: "Rent"}
# Transaction status domain.
TXN_STATUSES = ("Completed", "Pending", "Cancelled")
OWNERSHIP_TYPES = ("Freehold", "Leasehold", "Co-operative Society", "Power of Attorney")
BUYER_FIRST = ("Amit", "Priya", "Rahul", "Sneha", "Vikram", "Pooja", "Suresh", "Kavitha",
               "Arjun", "Divya", "Rajan", "Meera", "Anil", "Sunita", "Deepak", "Swati")
BUYER_LAST = ("Sharma", "Patel", "Singh", "Gupta", "Verma", "Nair", "Reddy", "Iyer",
              "Kumar", "Joshi", "Mehta", "Shah", "Das", "Bose", "Pillai", "Mishra")
# City -> source file of the ingest job.
CITY_FILES = {
    "Gurgaon": "gurgaon_10k.csv",
    "Hyderabad": "hyderabad.csv",
    "Kolkata": "kolkata.csv",
    "Mumbai": "mumbai.csv",
}
# Synthetic register dates fall in this inclusive window.
SYNTH_DATE_START = "2022-10-01"
SYNTH_DATE_DAYS = 396  # 2022-10-01 .. 2023-10-31 inclusive
# Synthetic transactions: sample rate, floor on the sample size, price
# variance band and days after registration.
SYNTH_TXN_RATE = 0.12
SYNTH_TXN_MIN = 200
SYNTH_DAYS_LO, SYNTH_DAYS_HI = 30, 365
# Text column clamps applied at ingest and validated on create.
TEXT_LIMITS = {"property_type": 100, "description": 2000, "prop_name": 400, "amenities": 500}
# Market sanity band on price per square foot (exclusive bounds).
PRICE_SQFT_MAX = 100000
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(18, 2)
PRICE_SQFT = T.DecimalType(12, 2)
AREA = T.DecimalType(12, 4)
GEO = T.DecimalType(10, 7)

CITIES = T.StructType([
    T.StructField("city_id", T.LongType(), False),
    T.StructField("city_name", T.StringType(), False),
    T.StructField("city_code", T.StringType(), True),
])

LOCALITIES = T.StructType([
    T.StructField("locality_id", T.LongType(), False),
    T.StructField("locality_name", T.StringType(), False),
    T.StructField("city_id", T.LongType(), False),
    T.StructField("latitude", GEO, True),
    T.StructField("longitude", GEO, True),
])

BUILDINGS = T.StructType([
    T.StructField("building_id", T.LongType(), False),
    T.StructField("building_name", T.StringType(), True),
    T.StructField("society_name", T.StringType(), True),
    T.StructField("locality_id", T.LongType(), True),
    T.StructField("total_floors", T.ShortType(), True),
])

AGENTS = T.StructType([
    T.StructField("agent_id", T.LongType(), False),
    T.StructField("contact_name", T.StringType(), True),
    T.StructField("company_name", T.StringType(), True),
    T.StructField("phone", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
    T.StructField("is_active", T.BooleanType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

LISTING_COLUMNS = [
    ("listing_id", T.LongType()),
    ("prop_id", T.StringType()),
    ("property_type", T.StringType()),
    ("transact_type", T.ShortType()),
    ("bedroom_num", T.ShortType()),
    ("bathroom_num", T.ShortType()),
    ("balcony_num", T.ShortType()),
    ("furnish_id", T.ShortType()),
    ("age", T.ShortType()),
    ("floor_num", T.ShortType()),
    ("total_floor", T.ShortType()),
    ("min_area_sqft", AREA),
    ("max_area_sqft", AREA),
    ("price_inr", MONEY),
    ("price_sqft", PRICE_SQFT),
    ("description", T.StringType()),
    ("prop_name", T.StringType()),
    ("latitude", GEO),
    ("longitude", GEO),
    ("register_date", T.DateType()),
    ("expiry_date", T.DateType()),
    ("verified", T.BooleanType()),
    ("is_active", T.BooleanType()),
    ("building_id", T.LongType()),
    ("agent_id", T.LongType()),
    ("city_id", T.LongType()),
    ("locality_id", T.LongType()),
    ("amenities", T.StringType()),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
]
LISTINGS = T.StructType([T.StructField(n, t, True) for n, t in LISTING_COLUMNS])

TRANSACTIONS = T.StructType([
    T.StructField("txn_id", T.StringType(), False),
    T.StructField("listing_id", T.LongType(), False),
    T.StructField("sale_price", MONEY, False),
    T.StructField("transaction_date", T.DateType(), False),
    T.StructField("buyer_name", T.StringType(), True),
    T.StructField("ownership_type", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

# Listing columns a partial update may set (everything else is ignored).
LISTING_UPDATABLE = (
    "property_type", "transact_type", "bedroom_num", "bathroom_num", "balcony_num",
    "furnish_id", "age", "floor_num", "total_floor", "min_area_sqft", "max_area_sqft",
    "price_inr", "price_sqft", "description", "prop_name", "verified", "is_active",
    "amenities", "locality_id", "agent_id",
)
TXN_UPDATABLE = ("sale_price", "transaction_date", "buyer_name", "ownership_type",
                 "status", "notes")
AGENT_UPDATABLE = ("contact_name", "company_name", "phone", "email", "is_active")

# Output column order of an enriched listing record.
LISTING_OUT = [
    "listing_id", "prop_id", "property_type", "transact_type", "bedroom_num",
    "bathroom_num", "balcony_num", "furnish_id", "age", "floor_num", "total_floor",
    "min_area_sqft", "max_area_sqft", "price_inr", "price_sqft", "description",
    "prop_name", "latitude", "longitude", "register_date", "expiry_date", "verified",
    "is_active", "city_id", "city_name", "locality_id", "locality_name", "building_id",
    "agent_id", "agent_name", "amenities", "created_at", "updated_at",
]
