"""Ingest scalar functions (ING1-ING12) as Spark column expressions.

All are built-ins (regexp, split, try_cast, from_json, try_to_timestamp),
so the whole normalisation of a raw listing file is one codegen'd
projection with no Python in the row path.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propcube import schemas as S
from propcube.functions import literals
from propcube.functions.exprs import col, hash_u32

_OBSERVE_SEQ = itertools.count()

# Python's str.strip() removes Unicode whitespace (incl. NBSP), not only ' '.
# The character set is derived from the rule str.isspace(), and trimmed
# with btrim (a plain character scan, no regex per row).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
_WS = r"(?U)[\s\x1c-\x1f]"
# A plain decimal number the way Python's float() reads it (no inf/nan,
# no digit separators; Spark alone would also accept '1.5d' or 'Infinity').
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def pystrip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def to_double(c: str | Column) -> Column:
    """float(x) or NULL: whitespace-trimmed, numeric-guarded."""
    s = pystrip(c)
    return F.when(s.rlike(NUMERIC), s.try_cast("double"))


# -- ING2 ---------------------------------------------------------------------

DATE_FORMATS = ("d MMM, yyyy", "yyyy-M-d", "d/M/yyyy")
# Shape of each format (Python's %d: 1-2 digits, %b: 3 letters, %Y: exactly
# 4 digits). Checking the shape first means the parser only runs on
# plausible strings, so failed attempts (which raise inside the parser)
# are rare, and 5-digit years are refused like Python does.
DATE_SHAPES = (r"^\d{1,2} [A-Za-z]{3}, \d{4}$", r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$")


def _parse_clean_date(s: Column) -> Column:
    return F.coalesce(*[F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt)).cast("date"))
                        for fmt, shape in zip(DATE_FORMATS, DATE_SHAPES)])


def synth_register_date(prop_id: str | Column, start: str = S.SYNTH_DATE_START,
                        days: int = S.SYNTH_DATE_DAYS) -> Column:
    """ING9: deterministic stand-in date, uniform over the window, from a
    hash of the listing key (stable across re-runs and executors)."""
    return F.date_add(F.lit(start).cast("date"), F.pmod(hash_u32(prop_id), F.lit(days)).cast("int"))


# -- ING3 / ING4 ----------------------------------------------------------------

LOCATION_FIELDS = ("LOCALITY_NAME", "BUILDING_ID", "BUILDING_NAME", "SOCIETY_NAME")
_LOC_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in LOCATION_FIELDS])
_MAP_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("LATITUDE", "LONGITUDE")])


# -- ING5 / ING6 / ING10 / ING11 / ING12 -----------------------------------------

def to_smallint(c: str | Column) -> Column:
    """ING5: numeric text -> truncated SMALLINT; unparseable or out of range -> NULL."""
    return to_double(c).try_cast("bigint").try_cast("smallint")


def transact_code(c: str | Column | None) -> Column:
    """ING6: missing / unparseable / 0 -> 1."""
    if c is None:
        return F.lit(1).cast("smallint")
    v = to_smallint(c)
    return F.when(v.isNull() | (v == 0), F.lit(1)).otherwise(v).cast("smallint")


def furnish_code(c: str | Column | None) -> Column:
    """ING6: missing / unparseable / outside {0,1,2,4} -> 0."""
    if c is None:
        return F.lit(0).cast("smallint")
    v = to_smallint(c)
    return F.when(v.isin(*S.VALID_FURNISH), v).otherwise(F.lit(0)).cast("smallint")


def building_id(c: str | Column) -> Column:
    """ING10: int(float(x)); <= 0 or unparseable -> NULL."""
    d = to_double(c)
    v = d.try_cast("bigint")
    return F.when(v > 0, v)


def floors(c: str | Column) -> Column:
    """ING10: int(float(x)) within 0..32767 else NULL."""
    v = to_double(c).try_cast("bigint")
    return F.when(v.between(0, 32767), v.cast("smallint"))


def verified_flag(c: str | Column | None) -> Column:
    """ING8: 1 / '1' / True / 'Y' / 'Yes' (as CSV text) -> true; missing column -> false."""
    if c is None:
        return F.lit(False)
    return F.coalesce(pystrip(c).isin("1", "1.0", "Y", "Yes", "True", "TRUE", "true"), F.lit(False))


# -- ING1-ING4 on frames ----------------------------------------------------------
# These parsers need many intermediate values. Each is computed once, as its
# own projected column (CollapseProject keeps non-cheap, multiply-referenced
# columns separate), and the temporaries are dropped at the end; inlined into
# one expression they would outgrow the JVM's method limit.

def with_price(df: DataFrame, src: str, out: str) -> DataFrame:
    """ING1, ``df`` + ``out``: '2.63 Cr' -> 26300000.0, '69.25 L' -> 6925000.0,
    '85,000' -> 85000.0, in six projection levels.

    A range 'a - b' parses both halves separately (the unit is not shared)
    and averages them when both are non-zero, else takes the first non-zero
    one. Missing / on-request / unparseable -> NULL.
    """
    t = f"__{out}"
    keep = [F.col(f"`{c}`") for c in df.columns]
    parts = F.split(pystrip(F.col(src)), " - ")
    df = df.select(*keep, pystrip(F.col(src)).alias(f"{t}_s"),
                   pystrip(F.get(parts, 0)).alias(f"{t}_a"), pystrip(F.get(parts, 1)).alias(f"{t}_b"))
    vs = [f"{t}_{v}" for v in ("s", "a", "b")]

    def missing(x: str) -> Column:  # lower-casing is dear: only texts as long as one of the three
        c, texts = F.col(x), ("", "price on request", "nan")
        return c.isNull() | F.when(F.length(c).isin(*map(len, texts)), F.lower(c).isin(*texts)).otherwise(F.lit(False))
    df = df.select("*", *[pystrip(F.regexp_replace(F.col(x), r"/Bed(room)?.*", "")).alias(f"{x}1") for x in vs])
    df = df.select("*", *[c for x in vs for c in (
        F.col(f"{x}1").contains("Cr").alias(f"{x}cr"),
        (F.col(f"{x}1").contains(" L") | F.col(f"{x}1").endswith("L")).alias(f"{x}l"))])

    def body(x: str) -> Column:
        x1 = F.col(f"{x}1")
        b = (F.when(F.col(f"{x}cr"), pystrip(F.replace(x1, F.lit("Cr"), F.lit(""))))
              .when(F.col(f"{x}l"), pystrip(F.regexp_replace(x1, r"\s*L\s*", "")))
              .otherwise(x1))
        return pystrip(F.replace(F.replace(b, F.lit(","), F.lit("")), F.lit("Onwards"), F.lit("")))
    df = df.select("*", *[body(x).alias(f"{x}body") for x in vs])

    def value(x: str) -> Column:
        b = F.col(f"{x}body")
        mult = F.when(F.col(f"{x}cr"), F.lit(1e7)).when(F.col(f"{x}l"), F.lit(1e5)).otherwise(F.lit(1.0))
        return F.when(b.rlike(NUMERIC), b.try_cast("double")) * mult
    df = df.select("*", *[c for x in vs for c in (
        value(x).alias(f"{x}v"),
        missing(x).alias(f"{x}miss"))])
    av, bv = F.col(f"{t}_av"), F.col(f"{t}_bv")
    a_ok = ~F.col(f"{t}_amiss") & av.isNotNull() & (av != 0)
    b_ok = ~F.col(f"{t}_bmiss") & bv.isNotNull() & (bv != 0)
    ranged = (F.when(a_ok & b_ok, (av + bv) / 2).when(a_ok, av)
               .when(F.col(f"{t}_bmiss"), F.lit(None).cast("double")).otherwise(bv))
    result = (F.when(F.col(src).isNull() | F.col(f"{t}_smiss"), F.lit(None).cast("double"))
               .when(F.col(f"{t}_s").contains(" - "), ranged)
               .otherwise(F.col(f"{t}_sv")))
    return df.select(*keep, result.alias(out))


def with_date(df: DataFrame, src: str, out: str) -> DataFrame:
    """ING2, ``df`` + ``out``: ordinal suffixes dropped, first matching format
    wins, whole string must match, invalid calendar dates -> NULL."""
    t = f"__{out}_clean"
    keep = [F.col(f"`{c}`") for c in df.columns]
    s = F.regexp_replace(pystrip(F.col(src)), r"(\d+)(st|nd|rd|th)", "$1")
    df = df.select(*keep, F.regexp_replace(s, r"(?U)\s+", " ").alias(t))
    return df.select(*keep, _parse_clean_date(F.col(t)).alias(out))


def with_literals(df: DataFrame, loc_src: str, map_src: str) -> DataFrame:
    """ING3 + ING4 on a frame: adds locality_name (stripped), building_id_raw,
    building_name, society_name with the defaults '', '0', '', '' for absent
    keys or an unparseable literal, and latitude, longitude as decimal(10,7)
    (absent, empty, zero or unparseable -> NULL).

    Each literal is parsed once per row: projections are not collapsed across
    the metrics node above the two parsed structs, so later field accesses read
    plain columns instead of re-inlining the parse into every ``CASE`` branch.
    A literal of which no field is read is not parsed at all.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    lj = literals.parsed(F.col(loc_src), _LOC_SCHEMA)
    mj = literals.parsed(F.col(map_src), _MAP_SCHEMA)
    df = df.select(*keep, lj.alias("__lj"), mj.alias("__mj")).observe(
        f"literals_{next(_OBSERVE_SEQ)}", F.count(F.lit(1)).alias("rows"))

    def one(v: Column) -> Column:
        d = to_double(v)
        return F.when(d.isNotNull() & (d != 0), pystrip(v).try_cast(S.GEO))
    return df.select(
        *keep,
        pystrip(F.coalesce(F.col("__lj.LOCALITY_NAME"), F.lit(""))).alias("locality_name"),
        F.coalesce(F.col("__lj.BUILDING_ID"), F.lit("0")).alias("building_id_raw"),
        F.coalesce(F.col("__lj.BUILDING_NAME"), F.lit("")).alias("building_name"),
        F.coalesce(F.col("__lj.SOCIETY_NAME"), F.lit("")).alias("society_name"),
        one(F.col("__mj.LATITUDE")).alias("latitude"),
        one(F.col("__mj.LONGITUDE")).alias("longitude"),
    )
