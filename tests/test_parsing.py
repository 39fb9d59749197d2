"""ING1-ING4 and display formatters against the documented input cases."""
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from propcube.functions import exprs as X
from propcube.functions import parsing as P

PRICES = [
    ("2.63 Cr", 26300000.0),
    ("69.25 L", 6925000.0),
    ("85,000", 85000.0),
    ("Price on Request", None),
    ("", None),
    ("nan", None),
    (None, None),
    ("1.17  - 1.18 Cr", (1.17 + 1.18e7) / 2),
    ("60 L Onwards", 6000000.0),
    ("12,000/Bedroom", 12000.0),
    ("25 Lac", None),
    ("1.5d", None),
    ("₹5 L", None),
    ("0 - 5 L", 500000.0),
    ("inf", None),
]


def _one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_parse_price(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PRICES)], "i int, v string")
    got = [r[0] for r in P.with_price(df, "v", "out").orderBy("i").select("out").collect()]
    for (raw, want), g in zip(PRICES, got):
        assert g == pytest.approx(want) if want is not None else g is None, raw


DATES = [
    ("5th Oct, 2022", dt.date(2022, 10, 5)),
    ("05 OCT, 2022", dt.date(2022, 10, 5)),
    ("2022-10-05", dt.date(2022, 10, 5)),
    ("5/10/2022", dt.date(2022, 10, 5)),
    ("5  Oct,  2022", dt.date(2022, 10, 5)),
    ("31 Feb, 2022", None),
    ("5 Oct, 22", None),
    ("2022-10-05 00:00:00", None),
    (None, None),
]


def test_parse_date(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DATES)], "i int, v string")
    staged = [r[0] for r in P.with_date(df, "v", "out").orderBy("i").select("out").collect()]
    assert staged == [w for _, w in DATES]


def _literals(spark, locations, maps):
    df = spark.createDataFrame(list(zip(range(len(locations)), locations, maps)), "i int, loc string, map string")
    return P.with_literals(df, "loc", "map").orderBy("i").collect()


def test_parse_location(spark):
    vals = ["{'LOCALITY_NAME': 'Sector 5', 'BUILDING_ID': 12}",
            "{'LOCALITY_NAME': \"King's Rd\"}",
            "{'LOCALITY_NAME': ' A ', 'BUILDING_ID': None, 'VERIFIED': True}",
            "{'LOCALITY_NAME': 'A\\xa0East'}",
            "garbage", None]
    got = _literals(spark, vals, [None] * len(vals))
    assert (got[0].locality_name, got[0].building_id_raw) == ("Sector 5", "12")
    assert got[1].locality_name == "King's Rd"
    assert (got[2].locality_name, got[2].building_id_raw) == ("A", "0")
    assert got[3].locality_name == "A East"
    for r in got[4:]:
        assert (r.locality_name, r.building_id_raw, r.building_name, r.society_name) == ("", "0", "", "")


def test_map_details_truthiness(spark):
    vals = ["{'LATITUDE': '28.4512345678', 'LONGITUDE': 77.02}", "{'LATITUDE': 0, 'LONGITUDE': ''}"]
    got = _literals(spark, [None] * len(vals), vals)
    assert got[0].latitude == Decimal("28.4512346") and got[0].longitude == Decimal("77.0200000")
    assert got[1].latitude is None and got[1].longitude is None


def test_coded_defaults(spark):
    assert _one(spark, ["1", "2", "", "0", "2.0", "x"], P.transact_code) == [1, 2, 1, 1, 2, 1]
    assert _one(spark, ["0", "1", "2", "4", "3", "x", None], P.furnish_code) == [0, 1, 2, 4, 0, 0, 0]
    assert _one(spark, ["3", "3.9", "99999", "abc", ""], P.to_smallint) == [3, 3, None, None, None]


def test_format_price_and_number(spark):
    vals = [Decimal("26300000.00"), Decimal("6925000.00"), Decimal("85000.00"), Decimal("1234.50"),
            Decimal("0.00"), None]
    got = _one(spark, vals, X.format_price, "decimal(18,2)")
    assert got == ["₹2.63 Cr", "₹69.25 L", "₹85,000", "₹1,234.5", "—", "—"]
    assert _one(spark, [Decimal("1234567.4"), Decimal("150000")], X.format_number, "decimal(18,2)") == \
        ["12,34,567", "1,50,000"]


def test_exact_average_rounds_half_up(spark):
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),)], "x decimal(18,2)")
    assert df.agg(X.exact_avg("x")).first()[0] == Decimal("0.02")  # 0.015 -> 0.02
    df = spark.createDataFrame([(Decimal("-0.01"),), (Decimal("-0.02"),)], "x decimal(18,2)")
    assert df.agg(X.exact_avg("x")).first()[0] == Decimal("-0.02")
    empty = spark.createDataFrame([], "x decimal(18,2)")
    assert empty.agg(X.exact_avg("x")).first()[0] is None
