"""SNK3 / MV1 by city: stored views partitioned by city, of which a refresh
rewrites only the cities that changed.

Each refreshed city's partition gets its rows and one empty marker row, so a city
that lost its last row is rewritten too. AGG7 and AGG8 group by city, so a
city's rows follow from its listings alone. AGG9's rows without a city are those
of agents without a listing (and of listings of unknown cities); they are one
more partition, which every refresh rewrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propcube.operators.views import VIEW_BUILDERS, VIEW_NAMES
from propcube.sources.bridge import Tables
from propcube.sources.buckets import read_partitions, write_partitions

_ROW = "_row"


def _of_cities(t: Tables, names: list[str]) -> Tables:
    """The tables with the listings of the named cities only."""
    ids = t.cities.where(F.col("city_name").isin(names)).select("city_id")
    return t.with_tables(listings=t.listings.join(ids, "city_id", "left_semi"))


def _without_city(t: Tables) -> DataFrame:
    """AGG9's rows without a city."""
    lost = t.with_tables(listings=t.listings.join(t.cities.select("city_id"), "city_id", "left_anti"))
    placed = t.listings.select("agent_id").where("agent_id IS NOT NULL").distinct()
    rows = VIEW_BUILDERS["mv_agent_performance"](lost)
    # an agent whose listings all have a city has no such row
    bare = rows.where("total_listings = 0").join(placed, "agent_id", "left_anti")
    return rows.where("total_listings > 0").unionByName(bare)


def refresh_cities(t: Tables, root: str, names: list[str], views: tuple[str, ...] = VIEW_NAMES) -> None:
    """Rewrite the partitions of the named cities from the current tables."""
    part = _of_cities(t, names)
    for view in views:
        rows = VIEW_BUILDERS[view](part).where(F.col("city_name").isin(names))
        marks = t.spark.createDataFrame([(n,) for n in names], "city_name string")
        if view == "mv_agent_performance":
            rows = rows.unionByName(_without_city(t))
            marks = marks.unionByName(t.spark.createDataFrame([(None,)], "city_name string"))
        out = rows.withColumn(_ROW, F.lit(True)).unionByName(marks.withColumn(_ROW, F.lit(False)), allowMissingColumns=True)
        write_partitions(out, f"{root}/{view}", ["city_name"])


def read_city_view(spark: SparkSession, root: str, view: str, schema: T.StructType, names: list[str] | None = None) -> DataFrame:
    """A stored view; with ``names``, only those cities' files are opened."""
    stored = T.StructType([*[f for f in schema.fields if f.name != "city_name"], T.StructField(_ROW, T.BooleanType()),
                           T.StructField("city_name", T.StringType())])
    wanted = None if names is None else F.col("city_name").isin(names)
    return read_partitions(spark, f"{root}/{view}", stored, wanted).where(_ROW).select(*schema.names)
