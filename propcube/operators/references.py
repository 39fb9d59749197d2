"""CHG9: deletes over the declared graph of foreign keys.

Each reference says what its rows do when the row they point at goes: go with
it (cascade), lose the pointer (set null) or forbid it (restrict). A delete
spreads along cascades by semi-joins until nothing new is found; every row that
goes remembers the asked-for row that it goes for, so a restriction found
anywhere takes back that request as a whole, and only that. Rows that go
anyway do not restrict. Unknown ids and restricted requests are rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propcube.session import materialize

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    action: str


#: Primary key of each table, and what points at what.
KEYS = {"cities": "city_id", "localities": "locality_id", "buildings": "building_id", "agents": "agent_id",
        "listings": "listing_id", "transactions": "txn_id"}
GRAPH = (
    Reference("localities", "city_id", "cities", CASCADE),
    Reference("buildings", "locality_id", "localities", SET_NULL),
    Reference("listings", "building_id", "buildings", SET_NULL),
    Reference("listings", "agent_id", "agents", SET_NULL),
    Reference("listings", "city_id", "cities", RESTRICT),
    Reference("listings", "locality_id", "localities", SET_NULL),
    Reference("transactions", "listing_id", "listings", CASCADE),
)


def _asked(tables: dict[str, DataFrame], wanted: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """Per table the known ids asked for, as (key, root_table, root), and the
    rejects of unknown ones."""
    asked, rejects = {}, []
    for name, ids in wanted.items():
        key = KEYS[name]
        keys = materialize(ids.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct(), "asked")
        known = tables[name].select(F.col(key).alias("key")).join(keys, "key", "left_semi")
        asked[name] = known.select("key", F.lit(name).alias("root_table"), F.col("key").cast("string").alias("root"))
        rejects.append(keys.join(known, "key", "left_anti").select(
            F.lit(name).alias("table_name"), F.col("key").cast("string").alias("key"), F.lit("not_found").alias("reason")))
    return asked, rejects


def _spread(tables: dict[str, DataFrame], asked: dict[str, DataFrame], graph: tuple[Reference, ...]) -> dict[str, DataFrame]:
    """All rows that go, by table, each with the requests that it goes for."""
    gone = {name: materialize(rows, "gone") for name, rows in asked.items()}
    fresh = dict(gone)
    while fresh:
        found: dict[str, DataFrame] = {}
        for ref in graph:
            if ref.action == CASCADE and ref.parent in fresh:
                up = fresh[ref.parent].withColumnRenamed("key", "_up")
                rows = tables[ref.child].select(F.col(KEYS[ref.child]).alias("key"), F.col(ref.column).alias("_up")) \
                    .join(up, "_up").select("key", "root_table", "root")
                found[ref.child] = found[ref.child].unionByName(rows) if ref.child in found else rows
        fresh = {}
        for name, rows in found.items():
            new = rows.distinct()
            if name in gone:
                new = new.join(gone[name], ["key", "root_table", "root"], "left_anti")
            new = materialize(new, "gone")
            if new.limit(1).count():
                fresh[name] = new
                gone[name] = materialize(gone[name].unionByName(new), "gone") if name in gone else new
    return gone


def delete(tables: dict[str, DataFrame], wanted: dict[str, DataFrame],
           graph: tuple[Reference, ...] = GRAPH) -> tuple[dict[str, DataFrame], DataFrame]:
    """``tables`` after deleting the ``wanted`` ids (table -> frame with its
    key), and the rejects (table_name, key, reason)."""
    asked, rejects = _asked(tables, wanted)
    gone = _spread(tables, asked, graph)
    blocked = None
    for ref in graph:
        if ref.action != RESTRICT or ref.parent not in gone:
            continue
        rows = tables[ref.child]
        if ref.child in gone:
            rows = rows.join(gone[ref.child].select(F.col("key").alias(KEYS[ref.child])), KEYS[ref.child], "left_anti")
        held = rows.select(F.col(ref.column).alias("key")).where("key IS NOT NULL").distinct()
        hit = gone[ref.parent].join(held, "key", "left_semi").select(
            "root_table", "root", F.lit(f"referenced_by_{ref.child}").alias("reason")).distinct()
        blocked = hit if blocked is None else blocked.unionByName(hit)
    if blocked is not None:
        blocked = materialize(blocked, "blocked")
        gone = {name: rows.join(blocked.select("root_table", "root"), ["root_table", "root"], "left_anti") for name, rows in gone.items()}
        rejects.append(blocked.select(F.col("root_table").alias("table_name"), F.col("root").alias("key"), "reason").distinct())
    keys = {name: materialize(rows.select("key").distinct(), "gone-keys") for name, rows in gone.items()}
    out = {}
    for name, table in tables.items():
        kept = table.join(keys[name].withColumnRenamed("key", KEYS[name]), KEYS[name], "left_anti") if name in keys else table
        for ref in graph:
            if ref.child == name and ref.action == SET_NULL and ref.parent in keys:
                up = keys[ref.parent].select(F.col("key").alias("_up"), F.lit(True).alias("_g"))
                joined = kept.join(up, F.col(ref.column) == F.col("_up"), "left")
                kept = joined.withColumn(ref.column, F.when(F.col("_g").isNull(), F.col(ref.column))).drop("_up", "_g")
        out[name] = kept.select(table.columns)
    every = rejects[0]
    for r in rejects[1:]:
        every = every.unionByName(r)
    return out, every
