"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propcube.session import storage_root

#: White space of the word and text contracts, as a character class.
SPACE = r"\x20\x09-\x0D"
#: Bytes that separate words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder, by whatever file system its path names."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of an Arrow batch for a Python worker: pieces of work are smaller still,
#: so larger batches (64 MB by default) would only fill memory.
BATCH, BATCH_KEY = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library's modules to the Python workers, once a session, as
    ``--py-files`` would: sessions that others started may not have it."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY, None) in (None, "67108864b", "64m"):  # unless the session says otherwise
        spark.conf.set(BATCH_KEY, BATCH)
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="modules-"), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared storage root and read back: cuts
    the lineage, so that a lost executor costs a re-read only."""
    path = f"{storage_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of(col: str) -> Column:
    """crc32 of a column's text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits of a text (two 64-bit hashes); null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


BITS = 24  # a table of bits has 2^24


def may_match(rows: DataFrame, key: str, keys: DataFrame, size: int = BITS) -> DataFrame:
    """``rows`` with ``__may``: false where ``key`` (a hash) surely equals none of
    ``keys`` (column ``key``). By a bounded table of 2^``size`` bits, whatever
    their number."""
    slot = F.col(key).bitwiseAND(F.lit((1 << size) - 1))
    word, bit = F.shiftright(slot, 6).alias("__word"), f"cast({key} & 63 AS int)"
    table = keys.select(F.col("key").alias(key)).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("__bits"))
    return (rows.withColumn("__word", word).join(F.broadcast(table), "__word", "left")
            .withColumn("__may", F.coalesce(F.expr(f"shiftright(__bits, {bit}) & 1 = 1"), F.lit(False)))
            .drop("__word", "__bits"))


def leave_one(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that are not the first of their group.
    ``rows``: (group, first, id, k1, k2), the last three naming rows of
    ``docs`` by id and text key; the least ``first`` comes first, then the
    least id (null last), then the least key. Of repeated rows (one id and
    text) that come first, the one whose columns sort first as JSON stays.
    Rows not named stay; they are not shuffled (but for a few whose key looks
    like that of a named one)."""
    named = ["id", "k1", "k2"]
    rows = written(rows.groupBy("group", "first", *named).agg(F.count(F.lit(1)).alias("n")), "grouped-rows")
    best = (rows.groupBy("group").agg(F.min(F.struct("first", F.col("id").isNull().alias("none"), *named)).alias("best"),
                                      F.sum("n").alias("size")).where("size > 1").drop("size"))
    won = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))
    met = written(rows.join(best, "group").select(
        F.col("id").alias("__id"), F.col("k1").alias("__g1"), F.col("k2").alias("__g2"),
        won.alias("__won"), "n").where("NOT __won OR n > 1").drop("n"), "gone")
    k1, k2 = text_key(F.col(text_col))
    keyed = docs.withColumn("__k1", k1).withColumn("__k2", k2)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2"))
    keyed = may_match(keyed, "__k1", met.select(F.col("__g1").alias("key")))
    some = keyed.where("__may")
    left = keyed.where("NOT __may").select(docs.columns).unionByName(
        some.join(met.drop("__won"), same, "left_anti").select(docs.columns))
    tied = met.where("__won").drop("__won")
    if not tied.limit(1).count():
        return left
    others = F.to_json(F.struct(*[c for c in docs.columns if c != text_col]))
    one = (some.join(tied, same, "left_semi").groupBy(id_col, "__k1", "__k2")
           .agg(F.min_by(F.struct(*docs.columns), F.struct(others, F.col(text_col).isNull())).alias("__row"))
           .select("__row.*"))
    return left.unionByName(one)


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def by_bytes(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, one row at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: (start byte, end byte, words of each row).

    A word is a run of bytes other than SPACE_BYTES within one row; UTF-8
    never uses these bytes inside a longer character.
    """
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    solid = ~_IS_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = solid[cuts]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    before = cuts[cuts > 0] - 1
    last[before] = solid[before]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """base^0 ... base^(n-1). Made anew each time: it costs less than the sums
    that it goes into, and idle workers hold nothing."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out[:n]


_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def range_hasher(raw: np.ndarray):
    """A function (starts, ends) -> 64-bit hashes of those byte ranges.

    Prefix sums of byte * base^place, differenced per range and scaled back by
    base^-start (base is odd, so it has an inverse modulo 2^64): equal bytes
    hash alike wherever they stand.
    """
    n = len(raw)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.take(_SPREAD, raw, out=total[1:])
    total[1:] *= _powers(n, _BASE)
    np.cumsum(total[1:], out=total[1:])
    back = _powers(n + 1, _INVERSE)

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _ODD)

    return hashes


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, whatever its place."""
    return range_hasher(raw)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def shingle_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (n - k + 1 of them,
    over the whole array: the caller drops runs that cross a row's end)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    factor = _powers(k + 1, np.uint64(0xD1342543DE82EF95))[1:]
    for j in range(k):
        acc += word[j:j + n] * factor[j]
    return mix(acc + np.uint64(k))
