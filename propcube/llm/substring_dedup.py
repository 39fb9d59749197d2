"""Substring dedup by super-k-mers of words.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the
least hash among its runs of ``MINIMISER`` words; consecutive windows with one
minimiser travel as one packed string of words to the minimiser's bucket.
There the windows of all strings are sorted by a 128-bit hash of their words,
which shows the least document of each distinct window; words covered by a
window that a document with a smaller id has too are removed.

Minimisers are counted first, in a bounded histogram; it gives the number of
buckets (of BUCKET strings each on average; a bucket holds whole minimisers).
The strings that a task has for a bucket are compressed together. Bins far
above the mean (one common passage, or many copies of one text) are not sent
to buckets: their windows are grouped one by one by hash, minima
combined in the map tasks, and the rows to remove found by a join that Spark
can split. Both ways find the same windows.

Defined results: null text has no words; a document of fewer words than a
window loses none; a null id counts as greater than all others, and rows with
null id keep what only they share, as do rows that repeat an id. Words are
removed row by row: a row is its id and, where the id is null or may be
repeated (by a bounded sieve), a 128-bit key of its text, else zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propcube.llm.common import by_bytes, mix, shingle_hashes, ship, text_key, utf8, word_hashes, written
from propcube.llm.jaccard_join import among, sifted

WINDOW, MINIMISER = 13, 3
BINS = 1 << 16
LONGEST = 4096  # windows in one string
BUCKET = 1 << 14  # strings in a bucket, on average
GATHER = 2 << 20  # bytes of text whose strings are compressed together
NO_ID = (1 << 63) - 1
ROW = np.dtype([("id", "<i8"), ("k1", "<i8"), ("k2", "<i8")])


def columns(rows: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(rows[c])) for c in ROW.names]


def laid_out(raw: np.ndarray, offsets: np.ndarray):
    """Texts with single spaces between words and a line feed behind each:
    (bytes, word starts, word ends, words of each text)."""
    data = raw.tobytes()
    texts = [data[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    counts = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"\n".join(b" ".join(t) for t in texts if t) + b"\n", np.uint8)
    if not counts.sum():
        z = np.zeros(0, np.int64)
        return buf[:0], z, z, counts
    ends = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
    return buf, np.concatenate([[0], ends[:-1] + 1]), ends, counts


def super_kmers(word: np.ndarray, counts: np.ndarray):
    """(bucket key, text, first word overall, first word in text, windows) of
    each run of windows with one minimiser."""
    runs = shingle_hashes(word, MINIMISER)
    n = len(word) - WINDOW + 1
    z = np.zeros(0, np.int64)
    if n <= 0:
        return z.astype(np.uint64), z, z, z, z
    least = runs[:n].copy()
    for j in range(1, WINDOW - MINIMISER + 1):
        np.minimum(least, runs[j:j + n], out=least)
    first = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(counts)), counts)[:n]
    at = np.flatnonzero(np.arange(n) + WINDOW <= first[doc + 1])  # windows within one text
    if not len(at):
        return z.astype(np.uint64), z, z, z, z
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(at)))
    if size.max() > LONGEST:  # cut into pieces of LONGEST windows
        pieces = -(-size // LONGEST)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(LONGEST, np.repeat(size, pieces) - nth * LONGEST)
        start = np.repeat(start, pieces) + nth * LONGEST
    w = at[start]
    return mix(least[w]), doc[w], w, w - first[doc[w]], size


def pieces_of(batches: Iterator[pa.RecordBatch], step: int = 1 << 18):
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        ids = np.rec.fromarrays([batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "k1", "k2")], ROW)
        for lo, hi in by_bytes(offsets, step):
            buf, ws, we, counts = laid_out(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            word = word_hashes(buf, ws, we)
            yield ids[lo:hi], buf, ws, we, word, super_kmers(word, counts)


def bin_counts(docs: DataFrame) -> np.ndarray:
    """Strings in each bin of minimisers."""
    def count(batches):
        seen = np.zeros(BINS, np.int64)
        for *_, (key, *_rest) in pieces_of(batches):
            seen += np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=BINS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bin", "n"])

    out = np.zeros(BINS, np.int64)  # BINS rows at most come to the driver
    for r in docs.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def _block(parts: list[tuple[np.ndarray, np.ndarray, bytes]]) -> bytes:
    """One bucket's strings: number, rows (column by column), starts, and the
    strings, a line feed behind each."""
    rows = np.concatenate([p[0] for p in parts])
    starts = np.concatenate([p[1] for p in parts]).astype("<i4")
    data = len(rows).to_bytes(4, "little") + b"".join(rows[c].tobytes() for c in ROW.names) + starts.tobytes() + b"".join(p[2] for p in parts)
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unblock(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = int.from_bytes(data[:4], "little")
    rows = np.empty(n, ROW)
    for i, c in enumerate(ROW.names):
        rows[c] = np.frombuffer(data, "<i8", n, 4 + 8 * n * i)
    return rows, np.frombuffer(data, "<i4", n, 4 + 24 * n), np.frombuffer(data, np.uint8, offset=4 + 28 * n)


def packed(docs: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, block): the strings that a task has for a bucket."""
    skip = docs.sparkSession.sparkContext.broadcast(heavy)

    def pack(batches):
        held: dict[int, list] = {}
        size = 0

        def out():
            names = sorted(held)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(
                [_block(held[k]) for k in names], pa.binary())], ["bucket", "block"])

        for ids, buf, ws, we, _, (key, doc, w, start, n) in pieces_of(batches):
            use = np.flatnonzero(~skip.value[(key >> np.uint64(48)).astype(np.int64)])
            bucket = (key[use] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            use, bucket = use[order], bucket[order]
            w, n, own, start = w[use], n[use], ids[doc[use]], start[use]
            lo = ws[w]
            length = we[w + n + WINDOW - 2] - lo + 1  # with the space or line feed behind
            at = np.concatenate([[0], np.cumsum(length)])
            # a piece of text and its strings count less than 2^31 bytes, unless one text alone does not
            kind = np.int32 if at[-1] < 1 << 31 and len(buf) < 1 << 31 else np.int64
            data = buf[np.repeat((lo - at[:-1]).astype(kind), length) + np.arange(at[-1], dtype=kind)]
            data[at[1:] - 1] = 0x0A
            data = data.tobytes()
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist()):
                held.setdefault(int(bucket[a]), []).append((own[a:b], start[a:b], data[at[a]:at[b]]))
            size += len(buf)
            if size >= GATHER:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    return docs.mapInArrow(pack, "bucket long, block binary")


def window_hashes(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each run of WINDOW words."""
    return shingle_hashes(word, WINDOW), shingle_hashes(mix(word ^ np.uint64(0xA0761D6478BD642F)), WINDOW)


def repeated(rows: np.ndarray, starts: np.ndarray, buf: np.ndarray):
    """(row, first word, end) of the words to remove, from a complete bucket:
    strings with a line feed behind each in ``buf``."""
    gaps = np.flatnonzero((buf == 0x20) | (buf == 0x0A))
    ws = np.concatenate([[0], gaps[:-1] + 1])
    last = np.flatnonzero(buf[gaps] == 0x0A) + 1  # words up to each string's end
    h1, h2 = window_hashes(word_hashes(buf, ws, gaps))
    size = np.diff(np.concatenate([[0], last])) - WINDOW + 1
    row = np.repeat(np.arange(len(rows)), size)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.concatenate([[0], last[:-1]])[row] + nth
    h1, h2, doc = h1[at], h2[at], rows["id"][row]
    order = np.argsort(h1)
    a, b, d = h1[order], h2[order], doc[order]
    same = a[1:] == a[:-1]
    if (b[1:] != b[:-1])[same].any():  # one 64-bit hash for different windows: order by both
        order = np.lexsort((h2, h1))
        a, b, d = h1[order], h2[order], doc[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.repeat(np.minimum.reduceat(d, start), np.diff(np.append(start, len(d))))
    hit = np.zeros(len(doc), bool)
    hit[order] = d > least
    run = np.flatnonzero(hit)
    if not len(run):
        return rows[:0], starts[:0], starts[:0]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1] + 1) | (row[run[1:]] != row[run[:-1]])
    lo = run[new]
    hi = run[np.append(np.flatnonzero(new)[1:], len(run)) - 1]
    return rows[row[lo]], starts[row[lo]] + nth[lo], starts[row[lo]] + nth[hi] + WINDOW


def _count_windows(batches: Iterator[pa.RecordBatch]):
    """Blocks arrive in order of their bucket."""
    def out(blocks):
        parts = [_unblock(b) for b in blocks]
        rows, starts, buf = (np.concatenate([p[i] for p in parts]) for i in range(3))
        rows, lo, hi = repeated(rows, starts.astype(np.int64), buf)
        return pa.RecordBatch.from_arrays([*columns(rows), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                                          [*ROW.names, "lo", "hi"])

    now, held = None, []
    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
            if bucket != now and held:
                yield out(held)
                held = []
            now = bucket
            held.append(block.as_py())
    if held:
        yield out(held)


def heavy_windows(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(id, k1, k2, lo, hi) to remove, from the windows of heavy bins."""
    chosen = docs.sparkSession.sparkContext.broadcast(heavy)

    def single(batches):
        for ids, _, _, _, word, (key, doc, w, start, size) in pieces_of(batches):
            use = chosen.value[(key >> np.uint64(48)).astype(np.int64)]
            doc, w, start, size = doc[use], w[use], start[use], size[use]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            h1, h2 = window_hashes(word)
            at = np.repeat(w, size) + nth
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[at].view(np.int64) if len(at) else np.zeros(0, np.int64)),
                 pa.array(h2[at].view(np.int64) if len(at) else np.zeros(0, np.int64)),
                 *columns(ids[np.repeat(doc, size)]), pa.array(np.repeat(start, size) + nth, pa.int64())],
                ["h1", "h2", *ROW.names, "lo"])

    rows = docs.mapInArrow(single, "h1 long, h2 long, id long, k1 long, k2 long, lo long")
    least = (rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most"))
             .where("least < most").select("h1", "h2", "least"))
    return rows.join(least, ["h1", "h2"]).where("id > least").select(
        *ROW.names, "lo", (F.col("lo") + WINDOW).alias("hi"))


def removals(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, lo, hi): word ranges to remove from each row (id, k1, k2,
    text)."""
    counts = bin_counts(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = int(counts.sum())
    # more than a quarter of an average partition, and more than a bucket's tasks hold at once
    heavy = counts > max(1000, min(total // (4 * max(1, parts)), 4 * (BUCKET + total // BINS)))
    buckets = max(parts, total // BUCKET)
    blocks = packed(docs, heavy, buckets).repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = blocks.mapInArrow(_count_windows, "id long, k1 long, k2 long, lo long, hi long")
    if heavy.any():
        found = found.unionByName(heavy_windows(docs, heavy))
    return found


def _cleaned(batches: Iterator[pa.RecordBatch], with_text: bool):
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        data = raw.tobytes()
        los, his = batch.column("los"), batch.column("his")
        total, removed, digest, kept = [], [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            w = data[a:b].split()
            lo = los[i].values
            total.append(len(w))
            gone = 0
            if lo is not None and len(lo):
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, np.minimum(lo.to_numpy(), len(w)), 1)
                np.add.at(edge, np.minimum(his[i].values.to_numpy(), len(w)), -1)
                stay = np.cumsum(edge[:-1]) <= 0
                gone = len(w) - int(stay.sum())
                w = [w[j] for j in np.flatnonzero(stay).tolist()]
            removed.append(gone)
            text = b" ".join(w)
            digest.append(hashlib.sha256(text).hexdigest())
            kept.append(text)
        cols = [batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(digest, pa.string())]
        names = ["id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(cols, names)


def keyed(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, text): rows told apart by a key of their text where their
    id is null or may be repeated."""
    many = docs.groupBy("id").count().where("count > 1").select("id").unionByName(
        docs.sparkSession.range(1).select(F.lit(NO_ID).alias("id")))
    shared = among(many)
    k1, k2 = text_key(F.col("text"))
    docs = docs.withColumn("__shared", shared)
    return docs.select("id", *[F.when(F.col("__shared"), k).otherwise(F.lit(0)).alias(n) for k, n in ((k1, "k1"), (k2, "k2"))],
                       "text")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row, and the kept text
    itself (words joined by a space) if asked for."""
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(text_col, F.lit("")).alias("text"))
    docs = keyed(docs)
    found = written(removals(docs), "removals")
    per = written(found.groupBy(*ROW.names).agg(F.collect_set(F.struct("lo", "hi")).alias("r")), "removed-of")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    none = F.array().cast("array<long>")
    touched = sifted(docs, per.select("id")).join(per, [*ROW.names], "left").select(
        "id", "text", F.coalesce("r.lo", none).alias("los"), F.coalesce("r.hi", none).alias("his"))
    others = sifted(docs, per.select("id"), within=False).select(
        "id", "text", none.alias("los"), none.alias("his"))
    clean = lambda batches: _cleaned(batches, with_text)
    out = touched.mapInArrow(clean, schema).unionByName(others.mapInArrow(clean, schema))
    return out.withColumn("id", F.nullif("id", F.lit(NO_ID))).withColumnRenamed("id", id_col)
