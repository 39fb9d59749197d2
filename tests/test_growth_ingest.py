"""Columns that nobody reads are not parsed."""
from propcube.operators import ingest as I


def _city(spark):
    return {"ASIA": spark.createDataFrame(
        [("A", "90 L", "2024-01-02", "{'LOCALITY_NAME': 'x'}", 2), ("A", "80 L", None, "{'LOCALITY_NAME': 'y'}", 1),
         ("B", "70 L", None, "{'LOCALITY_NAME': 'z', 'BUILDING_ID': 7}", 3), ("C", None, None, None, 4)],
        "PROP_ID string, PRICE string, REGISTER_DATE string, location string, row_id long").repartition(3)}


def test_literals_that_nobody_reads_are_not_parsed(spark):
    clean = I.clean_listings(_city(spark))
    assert sorted((r.prop_id, r.row_id, r.locality_name, r.building_id) for r in clean.collect()) == [("A", 1, "y", None), ("B", 3, "z", 7)]
    dates = clean.where("register_date_synth").select("prop_id", "row_id", "register_date")
    assert "from_json" not in dates._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.prop_id for r in dates.collect()) == ["A", "B"]
