"""Ingest pipeline: city files -> one cleaned, de-duplicated listing frame.

SRC1 read per-city CSVs (all columns as strings) -> ING13 normalise each
(one narrow projection, schema-driven for absent columns) -> SET1 union in
file order -> FIL1 quality filter -> SET2 keep-first dedup by prop_id.
The only shuffle is the dedup, which keeps the first row of a key map-side
already, so a prop_id repeated millions of times moves one row per task.
"""

from __future__ import annotations

import itertools
import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.functions import exprs as X
from propcube.functions import parsing as P
from propcube.session import exists
from propcube.sources.csvfiles import read_csv

log = logging.getLogger(__name__)
_OBSERVE_SEQ = itertools.count()

NORMALIZED_COLUMNS = [
    "prop_id", "property_type", "transact_type", "bedroom_num", "bathroom_num", "balcony_num",
    "furnish_id", "age", "floor_num", "total_floor", "price_sqft", "prop_name", "amenities",
    "description", "min_area_sqft", "max_area_sqft", "price_raw", "price_inr", "verified",
    "register_date", "register_date_synth", "expiry_date", "locality_name", "building_id",
    "building_name", "society_name", "city_name", "latitude", "longitude", "contact_name",
    "company_name", "total_floors_bld", "source_rank", "row_id",
]


# -- SRC1 --------------------------------------------------------------------

def city_csvs(spark: SparkSession, data_dir: str,
              city_files: dict[str, str] = S.CITY_FILES) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(rows, rejects) of each configured city file that exists, all columns as
    text. A file, or a folder of part files, is read by as many tasks as it has
    splits. ``row_id`` follows the rows' order: part files by name, then the
    line on which the record starts. Rejects are malformed records with their
    file, line and reason.

    Missing files are skipped with a warning; none at all is an error.
    """
    out: dict[str, tuple[DataFrame, DataFrame]] = {}
    for city, fname in city_files.items():
        path = f"{data_dir.rstrip('/')}/{fname}"
        if not exists(spark, path):
            log.warning("%s not found, skipping %s", path, city)
            continue
        rows, rejects = read_csv(spark, path)
        names = spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).distinct()
        # one row for each file
        ranked = names.select("file", F.row_number().over(Window.orderBy("file")).alias("_at"))
        rows = rows.join(ranked, "file").withColumn("row_id", F.shiftleft(F.col("_at").cast("bigint"), 33) + F.col("line"))
        out[city] = rows.drop("file", "line", "_at"), rejects
    if not out:
        raise FileNotFoundError(f"no city files found under {data_dir}")
    return out


def read_city_csvs(spark: SparkSession, data_dir: str,
                   city_files: dict[str, str] = S.CITY_FILES) -> dict[str, DataFrame]:
    """One all-string DataFrame per configured city file that exists."""
    return {city: rows for city, (rows, _) in city_csvs(spark, data_dir, city_files).items()}


# -- ING13 -------------------------------------------------------------------

def _or_null(c, typ: str = "string"):
    return c if c is not None else F.lit(None).cast(typ)


def _normalize_base(df: DataFrame, city_name: str, source_rank: int) -> DataFrame:
    """Schema-driven first projection of one city file (cheap parses; raw
    inputs of the heavy price/date parses are passed through)."""
    cols = set(df.columns)
    g = lambda n: F.col(f"`{n}`") if n in cols else None
    if "MIN_AREA_SQFT" in cols:
        min_a = g("MIN_AREA_SQFT")
        max_a = g("MAX_AREA_SQFT") if "MAX_AREA_SQFT" in cols else min_a
    elif "AREA" in cols:
        min_a = max_a = g("AREA")
    else:
        min_a = max_a = None

    def area(c):
        if c is None:
            return F.lit(None).cast(S.AREA)
        return F.when(P.to_double(c).isNotNull(), P.pystrip(c).try_cast(S.AREA))

    text = lambda n, lim: X.clamp_text(_or_null(g(n)), lim)
    sqft_raw = _or_null(g("PRICE_SQFT"))
    row_id = g("row_id") if "row_id" in cols else F.monotonically_increasing_id()
    # Stage 1: plain columns plus the raw inputs of the heavier parses.
    base = df.select(
        P.pystrip(_or_null(g("PROP_ID"))).alias("prop_id"),
        text("PROPERTY_TYPE", S.TEXT_LIMITS["property_type"]).alias("property_type"),
        P.transact_code(g("TRANSACT_TYPE")).alias("transact_type"),
        P.to_smallint(_or_null(g("BEDROOM_NUM"))).alias("bedroom_num"),
        P.to_smallint(_or_null(g("BATHROOM_NUM"))).alias("bathroom_num"),
        P.to_smallint(_or_null(g("BALCONY_NUM"))).alias("balcony_num"),
        P.furnish_code(g("FURNISH")).alias("furnish_id"),
        P.to_smallint(_or_null(g("AGE"))).alias("age"),
        P.to_smallint(_or_null(g("FLOOR_NUM"))).alias("floor_num"),
        P.to_smallint(_or_null(g("TOTAL_FLOOR"))).alias("total_floor"),
        F.when(P.to_double(sqft_raw) > 0, P.pystrip(sqft_raw).try_cast(S.PRICE_SQFT)).alias("price_sqft"),
        text("PROP_NAME", S.TEXT_LIMITS["prop_name"]).alias("prop_name"),
        text("AMENITIES", S.TEXT_LIMITS["amenities"]).alias("amenities"),
        text("DESCRIPTION", S.TEXT_LIMITS["description"]).alias("description"),
        area(min_a).alias("min_area_sqft"),
        area(max_a).alias("max_area_sqft"),
        _or_null(g("PRICE")).alias("price_raw"),
        P.verified_flag(g("VERIFIED")).alias("verified"),
        _or_null(g("REGISTER_DATE")).alias("_reg_raw"),
        _or_null(g("EXPIRY_DATE")).alias("_exp_raw"),
        _or_null(g("location")).alias("_loc_raw"),
        _or_null(g("MAP_DETAILS")).alias("_map_raw"),
        F.lit(city_name).alias("city_name"),
        P.pystrip(_or_null(g("CONTACT_NAME"))).alias("contact_name"),
        P.pystrip(_or_null(g("CONTACT_COMPANY_NAME"))).alias("company_name"),
        P.floors(_or_null(g("TOTAL_FLOOR"))).alias("total_floors_bld"),
        F.lit(source_rank).cast("int").alias("source_rank"),
        row_id.cast("bigint").alias("row_id"),
    )
    base = P.with_literals(base, "_loc_raw", "_map_raw").drop("_loc_raw", "_map_raw")
    return base.observe(f"ingest_file_{source_rank}_{next(_OBSERVE_SEQ)}", F.count(F.lit(1)).alias("rows"))
    # ^ per-file row count; the metrics node also stops later projections
    # from being collapsed into this one, which would re-inline the dict
    # literal parse (from_json) once per extracted field.


def _finish(base: DataFrame) -> DataFrame:
    """Staged parses over (a union of) base frames, then the final shape."""
    # Stage 2: staged parses.
    staged = P.with_price(base, "price_raw", "_price")
    staged = P.with_date(staged, "_reg_raw", "_reg")
    staged = P.with_date(staged, "_exp_raw", "expiry_date")
    reg = F.col("_reg")
    out = staged.select(
        "prop_id", "property_type", "transact_type", "bedroom_num", "bathroom_num", "balcony_num",
        "furnish_id", "age", "floor_num", "total_floor", "price_sqft", "prop_name", "amenities",
        "description", "min_area_sqft", "max_area_sqft", "price_raw",
        F.col("_price").cast(S.MONEY).alias("price_inr"),
        "verified",
        F.coalesce(reg, P.synth_register_date("prop_id")).alias("register_date"),
        reg.isNull().alias("register_date_synth"),
        "expiry_date",
        "locality_name",
        P.building_id(F.col("building_id_raw")).alias("building_id"),
        F.nullif(F.col("building_name"), F.lit("")).alias("building_name"),
        F.nullif(F.col("society_name"), F.lit("")).alias("society_name"),
        "city_name", "latitude", "longitude",
        "contact_name", "company_name", "total_floors_bld", "source_rank", "row_id",
    )
    # Per-file ingest metrics. The metrics node also keeps later filters
    # (FIL1) from being pushed down into, and inlined through, the staged
    # parse projections, which would rebuild one oversized expression.
    return out.observe(f"ingest_{next(_OBSERVE_SEQ)}",
                       F.count(F.lit(1)).alias("rows"),
                       F.count("price_inr").alias("priced"),
                       F.count_if(F.col("register_date_synth")).alias("synth_dates"))


def normalize(df: DataFrame, city_name: str, source_rank: int) -> DataFrame:
    """ING13: raw city frame -> unified typed frame (ING1-ING12 applied).

    Absent source columns become typed NULLs or their defaults; the area
    fallback (ING7) branches on the frame's columns, not on data.
    """
    return _finish(_normalize_base(df, city_name, source_rank))


# -- SET1 / FIL1 / SET2 ----------------------------------------------------------

def union_cities(frames: dict[str, DataFrame]) -> DataFrame:
    """SET1: normalise each city frame and union them in configured order."""
    out = None
    for rank, (city, df) in enumerate(frames.items()):
        n = _normalize_base(df, city, rank)
        out = n if out is None else out.unionByName(n)
    if out is None:
        raise ValueError("no city frames")
    # The heavy parses run once over the union. The metrics node keeps the
    # optimizer from pushing those projections into every union branch
    # (which would copy the parse expressions once per file).
    out = out.observe(f"ingest_union_{next(_OBSERVE_SEQ)}", F.count(F.lit(1)).alias("rows"))
    return _finish(out)


def quality_filter(df: DataFrame) -> DataFrame:
    """FIL1: priced (> 0) rows with a real prop_id."""
    return df.where((F.col("price_inr") > 0) & F.col("prop_id").isNotNull()
                    & (F.col("prop_id") != "nan") & (F.col("prop_id") != ""))


def dedup_first(df: DataFrame, key: str = "prop_id",
                order: tuple[str, ...] = ("source_rank", "row_id")) -> DataFrame:
    """SET2: keep the first row per key in (file, row) order.

    Of each task's rows of a key only the first moves (a limit that Spark puts
    below the shuffle), so a key held by a third of all rows still moves one row
    per map task. Rows stay rows: columns that nobody reads are not worked out.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").select(
        key, *[c for c in df.columns if c != key])


def clean_listings(frames: dict[str, DataFrame]) -> DataFrame:
    """SET1 -> FIL1 -> SET2."""
    return dedup_first(quality_filter(union_cities(frames)))


def write_city_csvs(frames: dict[str, DataFrame], out_dir: str,
                    city_files: dict[str, str]) -> None:
    """Write raw city frames as one header-CSV directory per city file
    (parallel part files; no single-task funnel)."""
    for city, df in frames.items():
        df.drop("row_id").write.mode("errorifexists").option("header", True) \
          .option("escape", '"').csv(f"{out_dir}/{city_files[city]}")
