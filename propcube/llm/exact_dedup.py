"""Exact dedup by progressive refinement: length, prefix hash, full hash.

Texts are equal when they are identical after removing every white-space
character (``SPACE``). Rows are grouped by the length of what is left, then,
within lengths that occur more than once, by a hash of its prefix, and only
rows of (length, prefix) groups with more than one row have their full content
hashed. Only these narrow keys are shuffled; equal keys are combined in the
map tasks first, so a group with a third of all rows costs one row a task.

Of equal texts the row with the most code points in its original text stays,
then the smallest id. Defined results: null text counts as empty (so empty,
blank and null texts are equal); a null id sorts after the others; rows that
share id, text length and content (a repeated row) are marked alike by
``exact_dedup``, while ``drop_duplicates`` leaves one of them; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propcube.llm.common import SPACE, leave_one, text_key, written

PREFIX = 64  # characters of the second refinement
#: Refined keys are sent to the tasks that read texts up to this many; a key
#: takes 16 bytes. Beyond it the texts are joined with them by a shuffle.
BROADCAST_KEYS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def surviving_keys(rows: DataFrame) -> DataFrame:
    """(len, prefix) of more than one row, found length first."""
    by_length = rows.groupBy("__len").count().where("count > 1").select("__len")
    return (rows.join(by_length, "__len", "left_semi")
            .groupBy("__len", "__prefix").count().where("count > 1").select("__len", "__prefix"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text key, __points, __len, __prefix, __more, __norm) of the rows of
    ``docs``: ``__more`` is null where length and prefix tell the row apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = text_key(text)
    keyed = (docs.select(F.col(id_col).alias("__id"), F.length(text).cast("long").alias("__points"),
                         k1.alias("__k1"), k2.alias("__k2"), normalised(F.col(text_col)).alias("__norm"))
             .withColumn("__len", F.length("__norm"))
             .withColumn("__prefix", F.xxhash64(F.substring("__norm", 1, PREFIX))))
    keys = written(surviving_keys(keyed.select("__len", "__prefix")), "dedup-keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    marked = keyed.join(keys.withColumn("__more", F.lit(True)), ["__len", "__prefix"], "left")
    return marked.select("__id", "__k1", "__k2", "__points", "__len", "__prefix", "__more", "__norm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept,
    text_sha256). The digest of a row that no other can equal is null unless
    ``digest_all``."""
    full = F.sha2("__norm", 256)
    rows = exact_groups(docs, id_col, text_col).select(
        "__id", "__points", "__more",
        (full if digest_all else F.when(F.col("__more"), full)).alias("__full"))
    rows = written(rows, "dedup-rows")
    best = (rows.where("__more").groupBy("__full")
            .agg(F.min(F.struct((-F.col("__points")).alias("p"), F.col("__id").isNull().alias("n"),
                                F.col("__id").alias("id"))).alias("__best"),
                 F.count(F.lit(1)).alias("__size"))
            .where("__size > 1")
            .select("__full", F.col("__best.id").alias("__keep"), (-F.col("__best.p")).alias("__most"), "__size"))
    single = F.col("__size").isNull()
    met = rows.where("__more").join(best, "__full", "left").select(
        F.col("__id").alias(id_col),
        F.when(single, F.col("__id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__points") == F.col("__most")))).alias("kept"),
        F.col("__full").alias("text_sha256"))
    alone = rows.where("__more IS NULL").select(
        F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("__full").alias("text_sha256"))
    return met.unionByName(alone)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, all columns as they
    were. Rows are told apart by id and text: another row of the same (or null)
    id is not touched; of rows that repeat both, one stays."""
    rows = exact_groups(docs, id_col, text_col).where("__more").select(
        F.sha2("__norm", 256).alias("group"), (-F.col("__points")).alias("first"), F.col("__id").alias("id"),
        F.col("__k1").alias("k1"), F.col("__k2").alias("k2"))
    return leave_one(docs, rows, id_col, text_col)
