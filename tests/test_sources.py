"""SRC1: per-city CSV files, missing ones skipped, none at all is an error."""
import pytest
from pyspark.sql import functions as F

from propcube.operators import ingest as I
from propcube.session import scratch_path
from propcube.sources import raw as RAW
from tests.conftest import SF_SMALL


def test_read_city_csvs_skips_missing_and_round_trips(spark):
    frames = RAW.city_frames(spark, SF_SMALL)
    first = next(iter(frames))
    root = scratch_path(spark, "csv-test")
    I.write_city_csvs({first: frames[first]}, root, {first: "one.csv"})
    got = I.read_city_csvs(spark, root, {first: "one.csv", "Elsewhere": "missing.csv"})
    assert list(got) == [first]
    direct = I.clean_listings({first: frames[first]}).select("prop_id", "price_inr", "register_date")
    via_csv = I.clean_listings(got).select("prop_id", "price_inr", "register_date")
    assert sorted(via_csv.collect()) == sorted(direct.collect())
    assert via_csv.where(F.col("prop_id").isNull()).count() == 0


def test_read_city_csvs_all_missing_is_an_error(spark):
    root = scratch_path(spark, "csv-none")
    with pytest.raises(FileNotFoundError):
        I.read_city_csvs(spark, root, {"Nowhere": "none.csv"})


def test_rows_of_several_part_files_keep_their_order(spark):
    root = scratch_path(spark, "csv-order")
    rows = [(f"P{i:05d}", "line\nbreak") for i in range(3000)]
    spark.createDataFrame(rows, "PROP_ID string, DESCRIPTION string").repartitionByRange(7, "PROP_ID") \
        .sortWithinPartitions("PROP_ID").write.option("header", True).option("escape", '"').csv(f"{root}/one.csv")
    got = I.read_city_csvs(spark, root, {"One": "one.csv"})["One"].orderBy("row_id").collect()
    assert [r.PROP_ID for r in got] == [p for p, _ in rows]
    assert len({r.row_id for r in got}) == len(rows)


def test_keep_first_dedup_within_one_city(spark):
    df = spark.createDataFrame([("A", 0, 5, 1.0), ("A", 0, 2, 2.0), ("A", 1, 0, 3.0), ("B", 1, 9, 4.0)],
                               "prop_id string, source_rank int, row_id long, price_inr double")
    assert sorted((r.prop_id, r.price_inr) for r in I.dedup_first(df).collect()) == [("A", 2.0), ("B", 4.0)]
