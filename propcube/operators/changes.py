"""Change batches (CHG1-CHG9): create / update / delete as set operations.

Every operator takes the current table(s) and a DataFrame of changes and
returns ``(new_table, rejects)``; rejects carry the offending key and an
array of reason codes. Nothing is written in place: callers persist the new
table (see ``streaming.changefeed`` for the versioned apply loop).

Partial updates carry ``set_cols`` (array<string>) so "not sent" differs
from "sent as NULL". Several updates to one key merge column by column,
the latest (by ``seq``) setting of each column winning; they are combined
with ``max_by`` partial aggregates, so a key updated millions of times
still shuffles one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propcube import schemas as S
from propcube.operators.dims import assign_ids
from propcube.session import freed_shuffles, remove, scratch_path
from propcube.sources.stored import StoredTable

EMAIL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


# -- shared helpers --------------------------------------------------------------

def with_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``reasons`` (codes of every failed rule) and ``is_valid``."""
    codes = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules]),
                     lambda x: x.isNotNull())
    return df.withColumn("reasons", codes).withColumn("is_valid", F.size("reasons") == 0)


def ensure_columns(df: DataFrame, columns) -> DataFrame:
    """Add absent columns as typed NULLs (a batch may carry only some)."""
    missing = {n: F.lit(None).cast(t) for n, t in columns if n not in df.columns}
    return df.withColumns(missing) if missing else df


LISTING_TYPES = S.LISTING_COLUMNS
TXN_TYPES = [(f.name, f.dataType) for f in S.TRANSACTIONS.fields]
AGENT_TYPES = [(f.name, f.dataType) for f in S.AGENTS.fields]


def _split(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    valid = df.where("is_valid").drop("reasons", "is_valid")
    rejects = df.where(~F.col("is_valid")).select(key, "reasons")
    return valid, rejects


def _stamp(batch_ts: str | None) -> Column:
    return (F.current_timestamp() if batch_ts is None else F.lit(batch_ts)).cast("timestamp")


def _set(c: str) -> Column:
    return F.array_contains(F.col("set_cols"), F.lit(c))


def _if_set(c: str, bad: Column) -> Column:
    """Rule that applies only when the update sets column ``c``."""
    return _set(c) & bad


def _flag_exists(df: DataFrame, table: DataFrame, left_key: str, key: str, flag: str) -> DataFrame:
    """``flag`` = the key is present in ``table``.

    ``key`` is the table's primary / unique key, so the lookup side has at
    most one row per key and the left join cannot multiply rows. The table is
    semi-joined with the batch's keys first: where the batch is small, AQE
    sends its keys to the table's tasks and the table is not shuffled.
    """
    k = f"_{flag}_k"
    wanted = df.select(F.col(left_key).alias(k)).where(F.col(k).isNotNull()).distinct()
    d = table.select(F.col(key).alias(k)).join(wanted, k, "left_semi").withColumn(flag, F.lit(True))
    return (df.join(d, F.col(left_key) == F.col(k), "left")
              .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop(k))


def merge_updates(base: DataFrame, updates: DataFrame, key: str, columns: tuple[str, ...],
                  seq: str = "seq") -> DataFrame:
    """Apply validated partial updates: per key and column the latest
    setting wins. Returns ``base`` with ``_updated`` marking touched rows."""
    aggs = []
    for c in columns:
        order = F.when(_set(c), F.col(seq))
        aggs += [F.max_by(F.col(c), order).alias(f"_v_{c}"),
                 F.max(F.when(_set(c), F.lit(True))).alias(f"_s_{c}")]
    per_key = updates.groupBy(key).agg(*aggs) if aggs else updates.select(key).distinct()
    per_key = per_key.withColumn("_updated", F.lit(True))
    j = base.join(per_key, key, "left")
    out = [F.when(F.col(f"_s_{c}"), F.col(f"_v_{c}")).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c)
           if c in columns else F.col(c) for c in base.columns]
    return j.select(*out, F.coalesce(F.col("_updated"), F.lit(False)).alias("_updated"))


# -- CHG1 / CHG2 ---------------------------------------------------------------------

def listing_rules(strict: bool = True) -> list[tuple[str, Column]]:
    """Field rules of a listing create (strict) or update (loose)."""
    c = F.col
    if strict:
        rules = [
            ("prop_id_length", c("prop_id").isNull() | ~F.length("prop_id").between(3, 50)),
            ("transact_type_range", c("transact_type").isNotNull() & ~c("transact_type").between(1, 2)),
            ("price_required", c("price_inr").isNull() | (c("price_inr") <= 0)),
            ("city_required", c("city_id").isNull()),
        ]
        for n in ("bedroom_num", "bathroom_num", "balcony_num"):
            rules.append((f"{n}_range", c(n).isNotNull() & ~c(n).between(0, 20)))
        for n in ("age", "floor_num", "total_floor"):
            rules.append((f"{n}_range", c(n).isNotNull() & ~c(n).between(0, 200)))
        for n in ("min_area_sqft", "max_area_sqft", "price_sqft"):
            rules.append((f"{n}_positive", c(n).isNotNull() & (c(n) <= 0)))
        for n, lim in S.TEXT_LIMITS.items():
            rules.append((f"{n}_length", F.length(n) > lim))
        rules.append(("furnish_id_domain", c("furnish_id").isNotNull() & ~c("furnish_id").isin(*S.VALID_FURNISH)))
        return rules
    rules = [
        ("transact_type_range", _if_set("transact_type", c("transact_type").isNotNull()
                                        & ~c("transact_type").between(1, 2))),
        ("price_inr_positive", _if_set("price_inr", c("price_inr").isNotNull() & (c("price_inr") <= 0))),
        ("price_sqft_positive", _if_set("price_sqft", c("price_sqft").isNotNull() & (c("price_sqft") <= 0))),
        ("description_length", _if_set("description", F.length("description") > 2000)),
        ("prop_name_length", _if_set("prop_name", F.length("prop_name") > 400)),
        ("furnish_id_domain", _if_set("furnish_id", c("furnish_id").isNotNull()
                                      & ~c("furnish_id").isin(*S.VALID_FURNISH))),
    ]
    for n in ("bedroom_num", "bathroom_num", "balcony_num"):
        rules.append((f"{n}_range", _if_set(n, c(n).isNotNull() & ~c(n).between(0, 20))))
    for n in ("age", "floor_num", "total_floor"):
        rules.append((f"{n}_range", _if_set(n, c(n).isNotNull() & (c(n) < 0))))
    return rules


def _reference_rules(df: DataFrame, tables: dict[str, DataFrame | None]) -> tuple[DataFrame, list]:
    """Flags and rules for ids that must exist in their table when given
    (id 0 is a real id, not 'absent'); tables that are None are not checked."""
    rules = []
    for name, table in tables.items():
        if table is not None:
            key, flag = f"{name}_id", f"_{name}_ok"
            df = _flag_exists(df, table, key, key, flag)
            rules.append((f"{name}_unknown", key, F.col(key).isNotNull() & ~F.col(flag)))
    return df, rules


def validate_listings(changes: DataFrame, cities: DataFrame, localities: DataFrame,
                      buildings: DataFrame | None = None, agents: DataFrame | None = None) -> DataFrame:
    """CHG1: every create with ``reasons`` and ``is_valid``; city must exist,
    and locality, building and agent too when given."""
    df, refs = _reference_rules(ensure_columns(changes, LISTING_TYPES), {
        "city": cities, "locality": localities, "building": buildings, "agent": agents})
    out = with_reasons(df, listing_rules(True) + [(code, bad) for code, _, bad in refs])
    return out.drop(*[f"_{code.removesuffix('_unknown')}_ok" for code, _, _ in refs])


def create_listings(listings: DataFrame, changes: DataFrame, cities: DataFrame,
                    localities: DataFrame, batch_ts: str, seq: str = "seq",
                    buildings: DataFrame | None = None, agents: DataFrame | None = None,
                    freed: DataFrame | None = None, top_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """CHG2: validated creates whose prop_id is new; the first create of a
    prop_id within the batch wins, later ones are rejected. ``freed``
    (prop_id, freed_seq) names prop_ids that the batch itself deletes; a
    create after that may use them. New ids follow ``top_id`` (default: the
    greatest id in ``listings``)."""
    v = validate_listings(changes, cities, localities, buildings, agents)
    v = _flag_exists(v, listings, "prop_id", "prop_id", "_exists")
    if freed is not None:
        v = v.join(freed, "prop_id", "left").withColumn(
            "_exists", F.col("_exists") & ~F.coalesce(F.col("freed_seq") < F.col(seq), F.lit(False))).drop("freed_seq")
    v = v.withColumn("reasons", F.concat(
        F.col("reasons"), F.filter(F.array(F.when(F.col("_exists"), F.lit("prop_id_exists"))),
                                   lambda x: x.isNotNull())))
    # Applied one by one, a later create of the same new prop_id fails
    # after the first one that passes every other check.
    first = (v.where(F.size("reasons") == 0).groupBy("prop_id").agg(F.min(seq).alias("_first_seq")))
    v = v.join(first, "prop_id", "left")
    v = v.withColumn("reasons", F.concat(
        F.col("reasons"), F.filter(F.array(F.when((F.size("reasons") == 0) & (F.col(seq) != F.col("_first_seq")),
                                                  F.lit("prop_id_duplicate_in_batch"))), lambda x: x.isNotNull()))
    ).withColumn("is_valid", F.size("reasons") == 0).drop("_exists", "_first_seq")
    valid, rejects = _split(v, seq)
    top = F.coalesce(listings.select(F.max("listing_id")).scalar(), F.lit(0)) if top_id is None else top_id
    new = assign_ids(valid.drop("listing_id"), "listing_id", top, [seq])
    ts = F.lit(batch_ts).cast("timestamp")
    defaults = {"transact_type": F.coalesce(F.col("transact_type"), F.lit(1)),
                "verified": F.coalesce(F.col("verified"), F.lit(False)),
                "is_active": F.lit(True), "created_at": ts, "updated_at": ts}
    cols = []
    for n, t in S.LISTING_COLUMNS:
        if n in defaults:
            cols.append(defaults[n].cast(t).alias(n))
        elif n in new.columns:
            cols.append(F.col(n).cast(t).alias(n))
        else:
            cols.append(F.lit(None).cast(t).alias(n))
    return listings.select(*[n for n, _ in S.LISTING_COLUMNS]).unionByName(new.select(*cols)), rejects


# -- CHG3 / CHG4 ---------------------------------------------------------------------

def update_listings(listings: DataFrame, updates: DataFrame, batch_ts: str,
                    seq: str = "seq", localities: DataFrame | None = None, agents: DataFrame | None = None,
                    gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """CHG3: partial updates of the whitelisted columns; unknown id or a
    failed rule rejects the update; ``updated_at`` bumps on applied rows.
    ``gone`` (listing_id, gone_seq): deletes of the same batch; an update
    after its listing's delete is rejected as ``not_found``."""
    cols = tuple(c for c in S.LISTING_UPDATABLE if c in updates.columns)
    u = _flag_exists(ensure_columns(updates, LISTING_TYPES), listings, "listing_id", "listing_id", "_found")
    if gone is not None:
        u = u.join(gone, "listing_id", "left").withColumn(
            "_found", F.col("_found") & ~F.coalesce(F.col("gone_seq") < F.col(seq), F.lit(False))).drop("gone_seq")
    u, refs = _reference_rules(u, {"locality": localities, "agent": agents})
    rules = [("not_found", ~F.col("_found"))] + listing_rules(False) + [(code, _if_set(key, bad)) for code, key, bad in refs]
    u = with_reasons(u, rules).drop("_found", "_locality_ok", "_agent_ok")
    valid, rejects = _split(u, seq)
    merged = merge_updates(listings, valid, "listing_id", cols, seq)
    ts = F.lit(batch_ts).cast("timestamp")
    out = merged.withColumn("updated_at", F.when(F.col("_updated"), ts).otherwise(F.col("updated_at")))
    return out.drop("_updated"), rejects.withColumnRenamed(seq, "seq")


def delete_listings(listings: DataFrame, transactions: DataFrame, ids: DataFrame, mode: str,
                    batch_ts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CHG4: ``soft`` deactivates (and bumps updated_at); ``hard`` removes
    the listings and cascades to their transactions. Returns
    ``(listings, transactions, rejects)``; unknown ids are rejected."""
    keys = ids.select("listing_id").where(F.col("listing_id").isNotNull()).distinct()
    found = listings.select("listing_id").join(keys, "listing_id", "left_semi")
    rejects = keys.join(found, "listing_id", "left_anti") \
        .withColumn("reasons", F.array(F.lit("not_found")))
    if mode == "soft":
        hit = found.withColumn("_hit", F.lit(True))
        j = listings.join(hit, "listing_id", "left")
        ts = F.lit(batch_ts).cast("timestamp")
        out = j.select(*[
            (F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("is_active")).alias(c) if c == "is_active"
             else F.when(F.col("_hit"), ts).otherwise(F.col(c)).alias(c) if c == "updated_at"
             else F.col(c)) for c in listings.columns])
        return out, transactions, rejects
    if mode == "hard":
        return (listings.join(found, "listing_id", "left_anti"),
                transactions.join(found, "listing_id", "left_anti"), rejects)
    raise ValueError("mode must be 'soft' or 'hard'")


def append_transactions(table: StoredTable, listings: DataFrame, changes: DataFrame, id_prefix: str, seq: str = "seq",
                        batch_ts: str | None = None) -> DataFrame:
    """SNK2 as a sink: the created deals of a batch are appended to a table
    that is bucketed by ``txn_id``; returns the rejects. Ids follow from the
    prefix and the batch, so a batch that is appended again adds nothing. What
    the batch writes and shuffles on its way to the table goes with it."""
    valid, rejects = check_transactions(listings, changes, seq)
    stored = table.read().select("txn_id").where(F.col("txn_id").startswith(F.lit(id_prefix)))
    if not _all_stored(stored, listings, changes, id_prefix):
        path = scratch_path(table.spark, "ids")
        try:
            with freed_shuffles(table.spark):
                new = number_transactions(valid, id_prefix, batch_ts, path)
            table.append(new.join(stored, "txn_id", "left_anti"))
        finally:
            remove(table.spark, path)
    return rejects


def _all_stored(stored: DataFrame, listings: DataFrame, changes: DataFrame, id_prefix: str) -> bool:
    """Whether every id of a batch is among the ``stored`` ids of its prefix.
    The batch's ids are the prefix and 1, 2, ... up to its number of rows, so
    they need not be dealt out to be looked up."""
    n = F.substring("txn_id", len(id_prefix) + 1, 20)
    held = stored.withColumn("_n", n).where(F.col("_n").rlike("^[1-9][0-9]{0,17}$"))
    if held.isEmpty():
        return False
    known = listings.select(F.col("listing_id").alias("_known"))
    rows = _passed_rules(changes).select("listing_id").join(known, F.col("listing_id") == F.col("_known")).count()
    return held.where(F.col("_n").cast("bigint") <= rows).select("txn_id").distinct().count() == rows


# -- CHG5 - CHG7 ---------------------------------------------------------------------

def _txn_rules(strict: bool) -> list[tuple[str, Column]]:
    c = F.col
    if strict:
        return [
            ("sale_price_required", c("sale_price").isNull() | (c("sale_price") <= 0)),
            ("transaction_date_required", c("transaction_date").isNull()),
            ("status_domain", c("status").isNotNull() & ~c("status").isin(*S.TXN_STATUSES)),
            ("buyer_name_length", F.length("buyer_name") > 200),
            ("ownership_type_length", F.length("ownership_type") > 100),
        ]
    return [
        ("sale_price_positive", _if_set("sale_price", c("sale_price").isNull() | (c("sale_price") <= 0))),
        ("transaction_date_required", _if_set("transaction_date", c("transaction_date").isNull())),
        ("status_domain", _if_set("status", c("status").isNotNull() & ~c("status").isin(*S.TXN_STATUSES))),
    ]


def create_transactions(transactions: DataFrame, listings: DataFrame, changes: DataFrame,
                        id_prefix: str, seq: str = "seq", batch_ts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """CHG5: the deals with the valid new ones of a batch."""
    new, rejects = new_transactions(listings, changes, id_prefix, seq, batch_ts)
    return transactions.select(*S.TRANSACTIONS.fieldNames()).unionByName(new), rejects


def _passed_rules(changes: DataFrame) -> DataFrame:
    """The deals that name a listing and pass every rule on their own fields."""
    typed = ensure_columns(changes, TXN_TYPES).where(F.col("listing_id").isNotNull())
    return with_reasons(typed, _txn_rules(True)).where("is_valid").drop("reasons", "is_valid")


def check_transactions(listings: DataFrame, changes: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(valid deals without ids, rejects): the listing must exist; price > 0;
    status in the domain (default Completed). ``_seq`` holds the order.

    Deals that a field rule rejects are not dealt to the listings, and the
    others only with the columns that a deal keeps."""
    typed, rules = ensure_columns(changes, TXN_TYPES), _txn_rules(True)

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        v = _flag_exists(df, listings, "listing_id", "listing_id", "_found")
        return _split(with_reasons(v, [("listing_unknown", ~F.col("_found"))] + rules).drop("_found"), seq)

    kept = [n for n in S.TRANSACTIONS.fieldNames() if n not in ("txn_id", "created_at")]
    valid, _ = split(_passed_rules(changes).select(*dict.fromkeys([seq, *kept])))
    valid = valid.select(
        F.col(seq).alias("_seq"),
        F.col("listing_id").cast("bigint").alias("listing_id"),
        F.col("sale_price").cast(S.MONEY).alias("sale_price"),
        F.col("transaction_date").cast("date").alias("transaction_date"),
        *[F.col(c).cast("string").alias(c) for c in ("buyer_name", "ownership_type")],
        F.coalesce(F.col("status"), F.lit("Completed")).alias("status"),
        F.col("notes").cast("string").alias("notes"),
    )
    return valid, split(typed)[1]


def number_transactions(valid: DataFrame, id_prefix: str, batch_ts: str | None = None,
                        path: str | None = None) -> DataFrame:
    """The deals of a batch with ids ``<prefix><n>`` in ``_seq`` order;
    ``created_at`` is ``batch_ts`` (default: now). ``path``: see ``assign_ids``."""
    new = assign_ids(valid, "_n", 0, ["_seq"], keep_order=False, path=path)
    return new.select(F.concat(F.lit(id_prefix), F.col("_n").cast("string")).alias("txn_id"), "*",
                      _stamp(batch_ts).alias("created_at")).select(*S.TRANSACTIONS.fieldNames())


def new_transactions(listings: DataFrame, changes: DataFrame, id_prefix: str, seq: str = "seq",
                     batch_ts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new deals, rejects): the valid deals of a batch, numbered."""
    valid, rejects = check_transactions(listings, changes, seq)
    return number_transactions(valid, id_prefix, batch_ts), rejects


def update_transactions(transactions: DataFrame, updates: DataFrame,
                        seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """CHG6: partial update of the six editable columns (listing_id is not
    editable)."""
    cols = tuple(c for c in S.TXN_UPDATABLE if c in updates.columns)
    u = _flag_exists(ensure_columns(updates, TXN_TYPES), transactions, "txn_id", "txn_id", "_found")
    u = with_reasons(u, [("not_found", ~F.col("_found"))] + _txn_rules(False)).drop("_found")
    valid, rejects = _split(u, seq)
    return merge_updates(transactions, valid, "txn_id", cols, seq).drop("_updated"), rejects


def delete_transactions(transactions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CHG7: hard delete; unknown ids rejected."""
    keys = ids.select("txn_id").where(F.col("txn_id").isNotNull()).distinct()
    found = transactions.select("txn_id").join(keys, "txn_id", "left_semi")
    rejects = keys.join(found, "txn_id", "left_anti") \
        .withColumn("reasons", F.array(F.lit("not_found")))
    return transactions.join(keys, "txn_id", "left_anti"), rejects


# -- CHG8 ------------------------------------------------------------------------------

def create_agents(agents: DataFrame, changes: DataFrame, seq: str = "seq",
                  batch_ts: str | None = None) -> tuple[DataFrame, DataFrame]:
    """CHG8 create: name 2..200 chars, company <= 300, phone <= 30, email
    shaped like an address; new agents are active."""
    c = F.col
    rules = [
        ("contact_name_length", c("contact_name").isNull() | ~F.length("contact_name").between(2, 200)),
        ("company_name_length", F.length("company_name") > 300),
        ("phone_length", F.length("phone") > 30),
        ("email_format", c("email").isNotNull() & ~c("email").rlike(EMAIL_RE)),
    ]
    valid, rejects = _split(with_reasons(ensure_columns(changes, AGENT_TYPES), rules), seq)
    new = assign_ids(valid, "agent_id", F.coalesce(agents.select(F.max("agent_id")).scalar(), F.lit(0)), [seq])
    new = new.select("agent_id", "contact_name", "company_name", "phone", "email", F.lit(True).alias("is_active"),
                     _stamp(batch_ts).alias("created_at"))
    return agents.select(*S.AGENTS.fieldNames()).unionByName(new), rejects


def update_agents(agents: DataFrame, updates: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """CHG8 update: partial update of five columns."""
    c = F.col
    rules = [
        ("not_found", ~c("_found")),
        ("contact_name_length", _if_set("contact_name", F.length("contact_name") > 200)),
        ("company_name_length", _if_set("company_name", F.length("company_name") > 300)),
        ("phone_length", _if_set("phone", F.length("phone") > 30)),
        ("email_format", _if_set("email", c("email").isNotNull() & ~c("email").rlike(EMAIL_RE))),
    ]
    cols = tuple(x for x in S.AGENT_UPDATABLE if x in updates.columns)
    u = _flag_exists(ensure_columns(updates, AGENT_TYPES), agents, "agent_id", "agent_id", "_found")
    valid, rejects = _split(with_reasons(u, rules).drop("_found"), seq)
    return merge_updates(agents, valid, "agent_id", cols, seq).drop("_updated"), rejects


def deactivate_agents(agents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CHG8 delete: soft (is_active = false)."""
    keys = ids.select("agent_id").where(F.col("agent_id").isNotNull()).distinct()
    found = agents.select("agent_id").join(keys, "agent_id", "left_semi")
    rejects = keys.join(found, "agent_id", "left_anti") \
        .withColumn("reasons", F.array(F.lit("not_found")))
    hit = found.withColumn("_hit", F.lit(True))
    j = agents.join(hit, "agent_id", "left")
    out = j.select(*[F.when(F.col("_hit"), F.lit(False)).otherwise(F.col(x)).alias(x) if x == "is_active"
                     else F.col(x) for x in agents.columns])
    return out, rejects


# -- CHG9 ------------------------------------------------------------------------------

def _set_null_where(df: DataFrame, col: str, removed: DataFrame) -> DataFrame:
    gone = removed.select(F.col(col).alias("_gone")).distinct().withColumn("_g", F.lit(True))
    j = df.join(gone, F.col(col) == F.col("_gone"), "left")
    return j.select(*[F.when(F.col("_g"), F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                      if c == col else F.col(c) for c in df.columns])


def delete_localities(localities: DataFrame, buildings: DataFrame, listings: DataFrame,
                      ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Locality removal: buildings and listings pointing at it get NULL."""
    removed = ids.select("locality_id").distinct()
    return (localities.join(removed, "locality_id", "left_anti"),
            _set_null_where(buildings, "locality_id", removed),
            _set_null_where(listings, "locality_id", removed))


def delete_buildings(buildings: DataFrame, listings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    removed = ids.select("building_id").distinct()
    return buildings.join(removed, "building_id", "left_anti"), _set_null_where(listings, "building_id", removed)


def delete_agents(agents: DataFrame, listings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    removed = ids.select("agent_id").distinct()
    return agents.join(removed, "agent_id", "left_anti"), _set_null_where(listings, "agent_id", removed)


def delete_cities(cities: DataFrame, localities: DataFrame, buildings: DataFrame, listings: DataFrame,
                  ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """City removal cascades to its localities, and buildings that point at
    those get NULL; it is refused (rejected) while any listing still
    references the city. Returns (cities, localities, buildings, rejects)."""
    wanted = ids.select("city_id").distinct()
    blocked = wanted.join(listings.select("city_id").distinct(), "city_id", "left_semi")
    allowed = wanted.join(blocked, "city_id", "left_anti")
    rejects = blocked.withColumn("reasons", F.array(F.lit("referenced_by_listings")))
    gone = localities.join(allowed, "city_id", "left_semi").select("locality_id")
    return (cities.join(allowed, "city_id", "left_anti"), localities.join(allowed, "city_id", "left_anti"),
            _set_null_where(buildings, "locality_id", gone), rejects)
