"""S1: apply a stream of listing changes with Structured Streaming.

The state is four plain tables, changed a partition at a time
(``sources.buckets``): the listings by a hash bucket of their id, the prop_ids
by a bucket of their own, and for each stream and batch the images of the
listings that it touched (before and after) and the changes that it rejected.
A batch opens only the buckets that its keys fall into. Its images are written
first, as one partition; then they replace their listings in the buckets. A
repeated batch finds its images and writes the same rows again, so it changes
nothing, wherever the first attempt ended. Streams are told apart by the id in
their checkpoint. A deleted listing stays in its bucket as a marked row.

Within a batch, changes take effect in ``seq`` order: updates of one listing
merge column by column, an update or delete after its delete is rejected as
``not_found``, the first valid create of a prop_id wins, and a prop_id is free
again after its listing's delete. Every change that is not applied is written
to the rejects with its seq and reasons, so the outcome does not depend on how
files fall into batches (as long as the changes of a key arrive in order).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propcube import schemas as S
from propcube.operators import changes as C
from propcube.session import exists, materialize
from propcube.sources.buckets import bucket_of, buckets_for, read_partitions, touched, write_partitions

CHANGE_SCHEMA = T.StructType(
    [T.StructField("op", T.StringType()), T.StructField("seq", T.LongType()),
     T.StructField("set_cols", T.ArrayType(T.StringType()))]
    + [T.StructField(n, t) for n, t in S.LISTING_COLUMNS if n not in ("created_at", "updated_at")])
COLUMNS = [n for n, _ in S.LISTING_COLUMNS]
_DELETED = T.StructField("_deleted", T.BooleanType())
_BUCKET = T.StructField("bucket", T.IntegerType())
_BATCH = [T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())]
LISTINGS = T.StructType([*S.LISTINGS.fields, _DELETED, _BUCKET])
PROPS = T.StructType([S.LISTINGS["listing_id"], S.LISTINGS["prop_id"], _DELETED, _BUCKET])
IMAGES = T.StructType([*S.LISTINGS.fields, _DELETED, T.StructField("_after", T.BooleanType()), *_BATCH])
REJECTS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()),
                        T.StructField("reasons", T.ArrayType(T.StringType())), *_BATCH])


# -- the state -----------------------------------------------------------------

class State:
    """The tables of a feed below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        layout = spark.read.parquet(f"{root}/layout").first()
        self.buckets, self.first_top = layout["buckets"], layout["top_id"]

    def listings(self, wanted=None) -> DataFrame:
        """Listings and marked deletes, of the wanted buckets or all."""
        return read_partitions(self.spark, f"{self.root}/listings", LISTINGS, wanted)

    def of_keys(self, table: str, schema: T.StructType, keys: DataFrame, key: str) -> DataFrame:
        """Rows of the buckets that the keys fall into."""
        held = touched(keys.where(F.col(key).isNotNull()).select(bucket_of(key, self.buckets).alias("bucket")), "bucket")
        return read_partitions(self.spark, f"{self.root}/{table}", schema, F.col("bucket").isin(held))

    def replace(self, table: str, schema: T.StructType, images: DataFrame, key: str) -> None:
        """Put ``images`` in the place of the rows of their listings."""
        images = images.withColumn("bucket", bucket_of(key, self.buckets))
        kept = self.of_keys(table, schema, images, key).join(images.select("listing_id"), "listing_id", "left_anti")
        write_partitions(kept.select(schema.names).unionByName(images.select(schema.names)), f"{self.root}/{table}", ["bucket"])

    def written(self, table: str, schema: T.StructType) -> DataFrame:
        path = f"{self.root}/{table}"
        return read_partitions(self.spark, path, schema) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def images(self, stream: str, batch: int) -> DataFrame:
        return self.written("images", IMAGES).where((F.col("stream") == stream) & (F.col("batch") == batch))

    def top_id(self) -> int:
        """The greatest id given so far, deleted listings included."""
        made = self.written("images", IMAGES).agg(F.max("listing_id")).first()[0]
        return max(self.first_top, made or 0)


def init_state(listings: DataFrame, state_dir: str) -> None:
    """The starting snapshot."""
    spark = listings.sparkSession
    rows = materialize(listings.select(*COLUMNS), "snapshot").withColumn("_deleted", F.lit(False))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("listing_id").alias("top")).first()
    buckets = buckets_for(size["n"])
    write_partitions(rows.withColumn("bucket", bucket_of("listing_id", buckets)), f"{state_dir}/listings", ["bucket"])
    props = rows.where("prop_id IS NOT NULL").select("listing_id", "prop_id", "_deleted", bucket_of("prop_id", buckets).alias("bucket"))
    write_partitions(props, f"{state_dir}/props", ["bucket"])
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(size["top"] or 0).cast("long").alias("top_id")) \
        .write.parquet(f"{state_dir}/layout")


def read_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The current listings."""
    return State(spark, state_dir).listings().where("NOT _deleted").select(*COLUMNS)


def read_rejects(spark: SparkSession, state_dir: str) -> DataFrame:
    """Changes that were not applied, of all batches."""
    return State(spark, state_dir).written("rejects", REJECTS).select("seq", "op", "reasons")


# -- one batch -------------------------------------------------------------------

def change_delta(listings: DataFrame, changes: DataFrame, cities: DataFrame, localities: DataFrame,
                 batch_ts: str, top_id: int | None = None, props: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new images of touched listings with ``_deleted``, rejects) of a batch.

    ``listings`` may be any part of the table that holds the batch's ids, and
    ``props`` (listing_id, prop_id) one that holds its prop_ids (default: the
    listings). ``changes`` is read several times: give a written or persisted
    frame."""
    props = listings if props is None else props
    ops = {op: changes.where(F.col("op") == op) for op in ("create", "update", "delete")}
    ids = changes.where(F.col("op").isin("update", "delete") & F.col("listing_id").isNotNull()) \
        .select("listing_id").distinct()
    # the batch's rows of the table, found once; everything below is batch-sized
    touched = materialize(listings.join(ids, "listing_id", "left_semi"), "touched")

    deletes = ops["delete"].select("seq", "listing_id").join(
        touched.select("listing_id", "prop_id"), "listing_id", "left")
    gone = deletes.where("prop_id IS NOT NULL").groupBy("listing_id", "prop_id").agg(F.min("seq").alias("gone_seq"))
    seqs = gone.select("listing_id", "gone_seq")
    late = deletes.join(seqs, "listing_id", "left").where("gone_seq IS NULL OR seq > gone_seq").select(
        "seq", F.lit("delete").alias("op"), F.array(F.lit("not_found")).alias("reasons"))

    # only the columns that some update sets (names: a fixed, short list) are merged
    used = {r[0] for r in ops["update"].select(F.explode("set_cols").alias("c")).distinct()
            .where(F.col("c").isin(*S.LISTING_UPDATABLE)).collect()}
    updates = ops["update"].select("seq", "listing_id", "set_cols", *[c for c in S.LISTING_UPDATABLE if c in used])
    updated, bad_updates = C.update_listings(touched, updates, batch_ts, localities=localities, gone=seqs)
    image = updated.join(seqs, "listing_id", "left").withColumn("_deleted", F.col("gone_seq").isNotNull())
    stamp = F.lit(batch_ts).cast("timestamp")
    image = image.where(F.col("_deleted") | (F.col("updated_at") == stamp)).select(*COLUMNS, "_deleted")

    creates = ops["create"].drop("op", "listing_id", "set_cols")
    freed = gone.select("prop_id", F.col("gone_seq").alias("freed_seq"))
    known = materialize(props.select("listing_id", "prop_id").join(
        creates.select("prop_id").where("prop_id IS NOT NULL").distinct(), "prop_id", "left_semi"), "known")
    if top_id is None:
        top_id = listings.agg(F.max("listing_id")).first()[0] or 0
    empty = known.limit(0).select(*[F.lit(None).cast(t).alias(n) if n not in known.columns else F.col(n)
                                    for n, t in S.LISTING_COLUMNS])
    made, bad_creates = C.create_listings(
        known.unionByName(empty, allowMissingColumns=True), creates, cities, localities, batch_ts,
        freed=freed, top_id=top_id)
    new = made.where(F.col("created_at") == stamp).withColumn("_deleted", F.lit(False))
    # a later create of the same prop_id meets the first one, in this batch or an earlier one
    same = F.transform("reasons", lambda r: F.when(r == "prop_id_duplicate_in_batch", "prop_id_exists").otherwise(r))
    rejects = bad_creates.select("seq", F.lit("create").alias("op"), same.alias("reasons")).unionByName(
        bad_updates.select("seq", F.lit("update").alias("op"), "reasons")).unionByName(late)
    other = changes.where("op IS NULL OR op NOT IN ('create', 'update', 'delete')").select(
        "seq", "op", F.array(F.lit("unknown_op")).alias("reasons"))
    return image.unionByName(new.select(*COLUMNS, "_deleted")), rejects.unionByName(other)


def apply_changes(listings: DataFrame, changes: DataFrame, cities: DataFrame, localities: DataFrame,
                  batch_ts: str, transactions: DataFrame | None = None):
    """One batch job over whole tables: (listings, rejects), or (listings,
    transactions, rejects) when deals are given, which deletes cascade to."""
    changes = materialize(changes, "changes")
    delta, rejects = change_delta(listings, changes, cities, localities, batch_ts)
    delta = materialize(delta, "delta")
    out = listings.select(*COLUMNS).join(delta.select("listing_id"), "listing_id", "left_anti").unionByName(
        delta.where("NOT _deleted").select(*COLUMNS))
    if transactions is None:
        return out, rejects
    gone = delta.where("_deleted").select("listing_id")
    return out, transactions.join(gone, "listing_id", "left_anti"), rejects


# -- the stream ------------------------------------------------------------------

#: Batches that a backlog is drained in, at most. Scattered keys fall into every
#: bucket, so each batch may read and rewrite the whole table: batches of fixed
#: size would make that quadratic.
MOST_BATCHES = 4


def files_per_trigger(files: int, least: int) -> int:
    return max(least, math.ceil(files / MOST_BATCHES))


def apply_batch(state: State, batch: DataFrame, stream: str, number: int, cities: DataFrame, localities: DataFrame,
                batch_ts: str) -> DataFrame:
    """Apply one micro-batch; returns its images. Repeating it is harmless."""
    label = [F.lit(stream).alias("stream"), F.lit(number).cast("long").alias("batch")]
    if not state.images(stream, number).limit(1).count():
        changes = materialize(batch, "changes")
        current = state.of_keys("listings", LISTINGS, changes, "listing_id").where("NOT _deleted").select(*COLUMNS)
        props = state.of_keys("props", PROPS, changes.where("op = 'create'"), "prop_id").where("NOT _deleted")
        delta, rejects = change_delta(current, changes, cities, localities, batch_ts, state.top_id(), props)
        delta = materialize(delta, "delta")
        before = current.join(delta.select("listing_id"), "listing_id", "left_semi").select(
            *COLUMNS, F.lit(False).alias("_deleted"), F.lit(False).alias("_after"))
        write_partitions(rejects.select("*", *label), f"{state.root}/rejects", ["stream", "batch"], ("seq",))
        # the images come last: with them the batch is decided
        write_partitions(delta.withColumn("_after", F.lit(True)).unionByName(before).select("*", *label),
                         f"{state.root}/images", ["stream", "batch"], ("listing_id",))
    images = state.images(stream, number)
    after = images.where("_after")
    state.replace("listings", LISTINGS, after, "listing_id")
    state.replace("props", PROPS, after.where("prop_id IS NOT NULL"), "prop_id")
    return images


def run_change_feed(spark: SparkSession, source_dir: str, state_dir: str, checkpoint_dir: str,
                    cities: DataFrame, localities: DataFrame, batch_ts: str,
                    max_files_per_trigger: int = 1, trends_dir: str | None = None) -> None:
    """Drain every available change file (``availableNow``) into the state,
    ``max_files_per_trigger`` at a time, or more where there are many files.
    With ``trends_dir``, the price-trend partials (S2) take the images."""
    from propcube.streaming import incremental as INC
    state = State(spark, state_dir)

    def take(batch: DataFrame, batch_id: int) -> None:
        stream = INC.stream_id(spark, checkpoint_dir)
        images = apply_batch(state, batch, stream, batch_id, cities, localities, batch_ts)
        if trends_dir is not None:
            signed = INC.signed_images(images.where("NOT _after"), images.where("_after AND NOT _deleted"))
            INC.apply_signed(spark, trends_dir, signed, cities, stream, batch_id, lambda: read_state(spark, state_dir))

    files = len(spark.read.schema(CHANGE_SCHEMA).parquet(source_dir).inputFiles())
    stream = (spark.readStream.schema(CHANGE_SCHEMA)
              .option("maxFilesPerTrigger", files_per_trigger(files, max_files_per_trigger)).parquet(source_dir))
    q = (stream.writeStream.foreachBatch(take)
         .option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
