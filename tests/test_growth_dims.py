"""What the dimension steps stage, carry and parse."""
import re

import pytest
from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.functions import literals, parsing as P
from propcube.operators import dims as D
from propcube.plans import registry as R

SF = "/root/testdata/sf0.001"


def test_dimension_steps_stage_only_what_they_read(spark):
    key = (spark.sparkContext.applicationId, SF, "clean-listings")
    kept = R._STAGED.pop(key, None)
    try:
        staged = R._dim_chain(spark, SF)["clean"]
        assert staged.columns == R.DIM_COLUMNS and "description" not in staged.columns
        whole = R._dim_chain(spark, SF, whole=True)["clean"]
        assert "description" in whole.columns and whole.count() == staged.count()
        assert not whole.select(*R.DIM_COLUMNS).exceptAll(staged).count()
    finally:
        if kept:
            R._STAGED[key] = kept


def test_new_listings_have_the_same_values_in_the_columns_asked_for(spark):
    table = spark.createDataFrame([(4, "A"), (9, "B")], "listing_id long, prop_id string")
    for n, t in S.LISTING_COLUMNS[2:]:
        table = table.withColumn(n, F.lit(None).cast(t))
    batch = spark.createDataFrame(
        [("B", 0, 1, "old"), ("C", 1, 5, "c"), ("D", 0, 7, "d"), (None, 0, 8, None), ("D", 0, 9, "again")],
        "prop_id string, source_rank int, row_id long, description string")
    ts = "2024-01-01 00:00:00"
    cols = ["listing_id", "prop_id", "description", "is_active", "created_at", "bedroom_num"]
    some = D.insert_if_absent(table, batch, ts, columns=cols)
    every = D.insert_if_absent(table, batch, ts)
    assert some.columns == cols and every.columns == [n for n, _ in S.LISTING_COLUMNS]
    rows = sorted(map(tuple, some.collect()))
    assert rows == sorted(map(tuple, every.select(*cols).collect()))
    assert [r[:3] for r in rows] == [(4, "A", None), (9, "B", None), (10, "D", "d"), (11, None, None), (12, "D", "again"), (13, "C", "c")]


@pytest.mark.parametrize("text, plain", [
    (r"{'LOCALITY_NAME': 'x\xa0East', 'BUILDING_ID': 0}", True), (r"{'a\x3a': True, 'b': 'c\x27'}", True),
    (r"{'a': 'b\xag'}", False), (r"{'a': '\\x41'}", False), (r"{'a': 'b\n'}", False)])
def test_literals_with_hex_escapes_take_the_short_cut(text, plain):
    assert bool(re.search(literals._PLAIN, text)) == plain


def test_hex_escapes_read_as_python_reads_them(spark):
    texts = [r"{'LOCALITY_NAME': 'x\xa0East', 'BUILDING_ID': 0}", r"{'LOCALITY_NAME': '\x27\x22\x3a: \x5c', 'X': True}",
             r"{'LOCALITY\x5fNAME': '\x41\xe9\x0a.'}", r"{'LOCALITY_NAME': 'a\\x41'}", r"{'LOCALITY_NAME': '\xZ1'}"]
    frame = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "i int, l string, m string")
    got = [r.locality_name for r in P.with_literals(frame, "l", "m").orderBy("i").collect()]
    assert got == ["x\xa0East", "'\":: \\", "A\xe9\n.", "a\\x41", ""]


def test_missing_prices_in_any_case(spark):
    texts = ["", "  ", "NaN", "nan", "PRICE ON REQUEST", "Price on Request ", "5 L", "NAN - 5 L", "5 L - Price On Request", "İaN"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    out = P.with_price(frame, "p", "v").orderBy("i")
    assert [r.v for r in out.collect()] == [None, None, None, None, None, None, 500000.0, 500000.0, 500000.0, None]
