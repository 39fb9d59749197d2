"""CHG9 over the graph, per-city views, and daily partials."""
from pyspark.sql import functions as F

from propcube.operators import analytics as A
from propcube.operators import cityviews as CV
from propcube.operators import partials as SP
from propcube.operators import references as R
from propcube.operators import views as V
from propcube.session import scratch_path


def _tables(spark):
    return {
        "cities": spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "city_id int, city_name string"),
        "localities": spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, 3)], "locality_id int, city_id int"),
        "buildings": spark.createDataFrame([(100, 10), (101, 20), (102, None)], "building_id int, locality_id int"),
        "agents": spark.createDataFrame([(7,), (8,)], "agent_id int"),
        "listings": spark.createDataFrame([(1000, 100, 7, 2, 20), (1001, None, 8, 2, None), (1002, 101, None, 3, 30)],
                                          "listing_id int, building_id int, agent_id int, city_id int, locality_id int"),
        "transactions": spark.createDataFrame([("t1", 1000), ("t2", 1001)], "txn_id string, listing_id int"),
    }


def _ids(spark, key, *values):
    return spark.createDataFrame([(v,) for v in values], f"{key} int")


def _delete(spark, **wanted):
    left, rejects = R.delete(_tables(spark), {n: _ids(spark, R.KEYS[n], *v) for n, v in wanted.items()})
    return {n: sorted(map(tuple, d.collect())) for n, d in left.items()}, sorted(map(tuple, rejects.collect()))


def test_a_city_takes_its_localities_and_buildings_lose_them(spark):
    left, rejects = _delete(spark, cities=[1, 99])
    assert left["cities"] == [(2, "B"), (3, "C")] and left["localities"] == [(20, 2), (30, 3)]
    assert left["buildings"] == [(100, None), (101, 20), (102, None)] or sorted(left["buildings"]) == [(100, None), (101, 20), (102, None)]
    assert rejects == [("cities", "99", "not_found")]


def test_listings_forbid_their_city_unless_they_go_too(spark):
    left, rejects = _delete(spark, cities=[1, 2])
    assert [c[0] for c in left["cities"]] == [2, 3] and rejects == [("cities", "2", "referenced_by_listings")]
    left, rejects = _delete(spark, cities=[2], listings=[1000, 1001])
    assert [c[0] for c in left["cities"]] == [1, 3] and rejects == [] and left["transactions"] == []
    assert left["localities"] == [(10, 1), (11, 1), (30, 3)]


def test_a_restriction_further_down_takes_back_the_whole_request(spark):
    graph = (*R.GRAPH, R.Reference("buildings", "locality_id", "localities", R.RESTRICT))
    left, rejects = R.delete(_tables(spark), {"cities": _ids(spark, "city_id", 1, 3)},
                             tuple(g for g in graph if g != R.GRAPH[4]))
    assert sorted(r[0] for r in left["cities"].collect()) == [1, 2]
    assert [tuple(r) for r in rejects.collect()] == [("cities", "1", "referenced_by_buildings")]
    assert sorted(r[0] for r in left["localities"].collect()) == [10, 11, 20]


def test_set_null_everywhere(spark):
    left, _ = _delete(spark, agents=[7], buildings=[101], localities=[20, 30])
    assert sorted(left["listings"], key=str) == sorted([(1000, 100, None, 2, None), (1001, None, 8, 2, None), (1002, None, None, 3, None)], key=str)


def test_a_refresh_of_some_cities_equals_the_whole_view(spark, tables):
    root = scratch_path(spark, "city-views")
    every = [r[0] for r in tables.cities.select("city_name").collect()]
    lost = tables.listings.where("city_id = 2").limit(0)
    CV.refresh_cities(tables, root, every)
    # city 1 loses its agents' listings, city 2 all of its rows; the other cities stay
    now = tables.with_tables(listings=tables.listings.where("city_id <> 2 AND NOT (city_id = 1 AND agent_id % 3 = 0)").unionByName(lost))
    names = [r[0] for r in tables.cities.where("city_id IN (1, 2)").select("city_name").collect()]
    before = {p: n for p, n in _files(spark, root)}
    CV.refresh_cities(now, root, names)
    for view in V.VIEW_NAMES:
        want = V.VIEW_BUILDERS[view](now)
        got = CV.read_city_view(spark, root, view, want.schema)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, view
    other = [n for n in every if n not in names]
    same = [p for p, _ in _files(spark, root) if p in before and any(f"city_name={n}" in p for n in other)]
    assert len(same) == len([p for p in before if any(f"city_name={n}" in p for n in other)])


def _files(spark, root):
    return [(f.replace("%20", " "), 1) for v in V.VIEW_NAMES for f in spark.read.parquet(f"{root}/{v}").inputFiles()]


def test_summary_of_partials_for_any_range(spark, tables):
    root = scratch_path(spark, "partials")
    for i in range(3):
        SP.append_partials(tables.listings.where(F.col("listing_id") % 3 == i), tables.transactions.where(F.col("listing_id") % 3 == i), root)
    for lo, hi in ((None, None), ("1995-02-03", "1996-07-01"), ("1997-01-01", None), (None, "1992-01-31"), ("2050-01-01", None)):
        want = A.summary(tables, lo, hi).first().asDict()
        assert SP.summary_of(spark, root, lo, hi).first().asDict() == want, (lo, hi)
