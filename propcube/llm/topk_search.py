"""Exact top-k search by inner product, a block at a time.

Components become integers x = floor(256 * c). Equal vectors fold into one that
carries its k + 1 least ids (no more of them can be in an answer). The folded
vectors get an order that keeps alike ones together, and ranges of it form
segments and, inside them, blocks of ``BLOCK`` vectors. A term is a component
with its sign; a segment and a block store each term's maximum. A query's sum of
term maxima bounds every score inside from above. Blocks are taken in falling
order of that bound and scored through their forward index until the next
bound falls below the k-th score so far.

1. The order is a kd-tree over the widest components of a bounded sample
   (``SAMPLE`` vectors of smallest hash), at most ``LEAVES`` leaves, each a
   segment; inside one, the same cut goes on by all its vectors.
2. Each distinct query goes to the segment of its greatest bound, which gives a
   first k-th score.
3. It then goes to every other segment whose bound reaches that score.
4. The best of all segments are merged.

A segment and the queries that reach it are dealt in parts of at most about
``HOLD`` vectors and ``QUERIES`` queries, so no task grows with the data.

Ties go to the smaller id, null ids last. A bound equal to the k-th score is
still followed. Defined results: vectors that are null or hold null or
non-finite components take no part; a shorter vector is filled up with zeros to
the greatest length; rows that repeat an id are separate rows, each asks for
itself and meets the others; a row with null id is never a query of an id
condition but is found; a score beyond a long
counts as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propcube.llm.common import written
from propcube.llm.vectors import binary, integer_vectors, matrix, packed, shape, width

SAMPLE, LEAVES, SEGMENT, BLOCK = 8192, 1024, 2048, 32
HOLD, QUERIES = 32_768, 4096
LAST = np.iinfo(np.int64).max
FOUND = "q binary, score long, id long, same boolean"


def number(dim: int, most: int) -> np.dtype:
    """A type whose sums of ``dim`` products of components up to ``most`` are
    exact."""
    top = dim * most * most
    return np.dtype(np.float64 if top < 1 << 53 else np.int64 if top < 1 << 62 else object)


def held(scores: np.ndarray) -> np.ndarray:
    """Scores within the range of a long."""
    return np.clip(scores, -LAST - 1, LAST) if scores.dtype == object else scores


def halves(x: np.ndarray, least: int) -> np.ndarray:
    """An order of the rows of ``x`` in which each run of ``least`` is alike:
    cut in the middle of the widest component, again and again."""
    order, stack = np.arange(len(x)), [(0, len(x))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= least:
            continue
        part = x[order[lo:hi]]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0).astype(np.float64)))
        # runs stay whole: the middle is a multiple of ``least``
        mid = max(least, (hi - lo) // 2 // least * least)
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, axis], mid)]
        stack += [(lo, lo + mid), (lo + mid, hi)]
    return order


class Tree:
    """A kd-tree of a sample; its leaves, in order, are the segments."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, min(leaves, len(sample)).bit_length() - 1)
        nodes = (1 << self.depth) - 1
        self.axis, self.cut = np.zeros(nodes, np.int64), np.zeros(nodes, sample.dtype)
        held = {0: sample}
        for node in range(nodes):
            x = held.pop(node)
            if len(x):
                spread = x.astype(np.float64).var(axis=0)
                self.axis[node] = np.argmax(spread)
                self.cut[node] = np.sort(x[:, self.axis[node]])[(len(x) - 1) // 2]
            right = x[:, self.axis[node]] > self.cut[node]
            if 2 * node + 1 < nodes:
                held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return (node - ((1 << self.depth) - 1)).astype(np.int32)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(queries x ranges) sums of term maxima; ``high`` and ``low`` are the
    greatest and least components of each range."""
    return held(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)


class Segment:
    """The forward index of one part of a segment, block by block."""

    def __init__(self, rows: pa.Table, kind: np.dtype, dim: int, exact: np.dtype):
        at = np.argsort(rows.column("block").to_numpy())
        rows = rows.take(pa.array(at))
        self.x = np.concatenate([np.frombuffer(b.as_py(), kind).reshape(-1, dim)
                                 for b in rows.column("x")]).astype(exact)
        self.high = matrix(rows.column("high"), kind, dim).astype(exact)
        self.low = matrix(rows.column("low"), kind, dim).astype(exact)
        ids = rows.column("ids").combine_chunks().flatten()
        self.ids, self.first = ids.flatten(), ids.offsets.to_numpy()
        self.first = self.first - self.first[0]
        self.ids = self.ids.fill_null(LAST).to_numpy()
        self.none = ids.flatten().is_null().to_numpy(zero_copy_only=False)
        self.least = self.ids[self.first[:-1]]
        size = np.diff(rows.column("ids").combine_chunks().offsets.to_numpy())
        self.start = np.concatenate([[0], np.cumsum(size)])

    def rows_of(self, blocks: np.ndarray) -> np.ndarray:
        """Rows of the given blocks, one block after another."""
        size = self.start[blocks + 1] - self.start[blocks]
        return np.repeat(self.start[blocks] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def best(self, q: np.ndarray, bound: np.ndarray, floor, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the ``k`` best vectors that reach ``floor`` (None:
        any), by falling score, then least id."""
        order = np.argsort(-bound, kind="stable")
        falling = -bound[order]
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.x.dtype)
        at, step = 0, 4
        while at < len(order):
            end = len(order) if floor is None else int(np.searchsorted(falling, -floor, side="right"))
            if at >= end:
                break
            to = min(at + step, end)
            take = self.rows_of(order[at:to])
            s = held(self.x[take] @ q)
            rows, scores = np.append(rows, take), np.append(scores, s)
            if floor is not None:
                good = scores >= floor
                rows, scores = rows[good], scores[good]
            if len(scores) > k:
                kth = np.sort(scores)[-k]
                floor = kth if floor is None else max(floor, kth)
                tied = scores >= floor
                rows, scores = rows[tied], scores[tied]
            at, step = to, step * 2
        pick = np.lexsort((self.least[rows], -scores))[:k]
        return rows[pick], scores[pick]


def search_tile(index: pa.Table, asked: pa.Table, kind: np.dtype, dim: int, exact: np.dtype, k: int) -> pa.Table:
    """The k best rows of one part for each of its queries."""
    out: list[tuple] = []
    if index.num_rows and asked.num_rows:
        seg = Segment(index, kind, dim, exact)
        q = matrix(asked.column("q"), kind, dim).astype(exact)
        keys, floors = asked.column("q").to_pylist(), asked.column("floor").to_pylist()
        for lo in range(0, len(q), 256):
            bound = bounds(q[lo:lo + 256], seg.high, seg.low)
            for i in range(len(bound)):
                rows, scores = seg.best(q[lo + i], bound[i], floors[lo + i], k)
                mine = (seg.x[rows] == q[lo + i]).all(axis=1)
                n = 0
                for r, s, same in zip(rows.tolist(), scores.tolist(), mine.tolist()):
                    for j in range(seg.first[r], seg.first[r + 1]):
                        out.append((keys[lo + i], int(s), None if seg.none[j] else int(seg.ids[j]), same))
                        n += 1
                    # the next vector may tie and hold a smaller id than this one's last
                    if n >= k and not len(scores[scores == s]) > 1:
                        break
    cols = list(zip(*out)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.bool_()))],
                    names=["q", "score", "id", "same"])


class Searcher:
    """The index of a table of packed vectors (id, x)."""

    def __init__(self, rows: DataFrame, dim: int, kind: np.dtype, exact: np.dtype, k: int):
        self.spark, self.dim, self.kind, self.exact, self.k = rows.sparkSession, dim, kind, exact, k
        # row_number() with a limit is cut in the map tasks, so a vector that fills the table moves k rows a task
        by_id = Window.partitionBy("x").orderBy(F.col("id").asc_nulls_last())
        folded = written(rows.select("id", "x").withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k)
                         .groupBy("x").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))),
                                                       lambda e: e["id"]).alias("ids")), "folded")
        n = folded.count()
        sample = folded.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).toArrow()
        points = matrix(sample.column("x"), kind, dim)
        tree = Tree(points, min(LEAVES, 1 << max(0, -(-n // SEGMENT) - 1).bit_length(), max(1, len(points) // 4)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = tree.leaf(matrix(b.column("x"), kind, dim))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column("x"), b.column("ids")], ["seg", "x", "ids"])

        placed = written(folded.mapInArrow(place, "seg int, x binary, ids array<long>"), "placed")
        self.parts = F.broadcast(written(placed.groupBy("seg").agg(  # at most LEAVES rows
            F.ceil(F.count(F.lit(1)) / HOLD).cast("int").alias("parts")), "segments"))

        def build(key, rows):
            x = matrix(rows.column("x"), kind, dim)
            order = halves(x, BLOCK)
            x, ids = x[order], rows.column("ids").combine_chunks().take(pa.array(order))
            cuts = list(range(0, len(x), BLOCK))
            m = len(cuts)
            return pa.table({
                "seg": pa.array([key[0].as_py()] * m, pa.int32()), "part": pa.array([key[1].as_py()] * m, pa.int32()),
                "block": pa.array(range(m), pa.int32()),
                "x": pa.array([x[c:c + BLOCK].tobytes() for c in cuts], pa.binary()),
                "ids": pa.array([ids[c:c + BLOCK].to_pylist() for c in cuts], pa.list_(pa.list_(pa.int64()))),
                "high": binary(np.array([x[c:c + BLOCK].max(axis=0) for c in cuts])),
                "low": binary(np.array([x[c:c + BLOCK].min(axis=0) for c in cuts]))})

        self.index = written(
            placed.join(self.parts, "seg").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
            .groupBy("seg", "part").applyInArrow(
                build, "seg int, part int, block int, x binary, ids array<array<long>>, high binary, low binary"), "index")

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[np.ndarray]] = {}
            for b in batches:
                high, low = (matrix(b.column(c), kind, dim) for c in ("high", "low"))
                for s, h, w in zip(b.column("seg").to_pylist(), high, low):
                    old = held.get(s)
                    held[s] = [h.copy(), w.copy()] if old is None else [np.maximum(old[0], h), np.minimum(old[1], w)]
            segs = sorted(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(segs, pa.int32()), *(pa.array([held[s][i].tobytes() for s in segs], pa.binary()) for i in (0, 1))],
                ["seg", "high", "low"])

        summaries = "seg int, high binary, low binary"
        top = (self.index.select("seg", "high", "low").mapInArrow(ranges, summaries)
               .repartition("seg").mapInArrow(ranges, summaries).toArrow())  # at most LEAVES rows
        self.segs = top.column("seg").to_numpy()
        self.high, self.low = (matrix(top.column(c), kind, dim).astype(exact) for c in ("high", "low"))

    def routed(self, asked: DataFrame, first: bool) -> DataFrame:
        """(q, floor, seg) of each query (q, floor): its segment of greatest
        bound, or all others whose bound reaches ``floor``."""
        segs, high, low, kind, dim, exact = self.segs, self.high, self.low, self.kind, self.dim, self.exact
        shared = self.spark.sparkContext.broadcast((segs, high, low))  # LEAVES ranges

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            segs, high, low = shared.value
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    bound = bounds(matrix(part.column("q"), kind, dim).astype(exact), high, low)
                    home = np.argmax(bound, axis=1)
                    if first:
                        i, s = np.arange(part.num_rows), home
                    else:
                        reach = np.ones(bound.shape, bool)
                        for j, f in enumerate(part.column("floor").to_pylist()):
                            if f is not None:
                                reach[j] = bound[j] >= f
                        reach[np.arange(part.num_rows), home] = False
                        i, s = np.nonzero(reach)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("q").take(pa.array(i)), part.column("floor").take(pa.array(i)),
                         pa.array(segs[s], pa.int32())], ["q", "floor", "seg"])

        return asked.select("q", "floor").mapInArrow(route, "q binary, floor long, seg int")

    def tiles(self, routed: DataFrame) -> DataFrame:
        """FOUND rows of each part of a segment for each query sent to it."""
        kind, dim, exact, k = self.kind, self.dim, self.exact, self.k
        routed = written(routed, "routed")
        per = F.broadcast(written(routed.groupBy("seg").agg(  # at most LEAVES rows
            F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("asks")), "asked"))
        asked = (routed.join(per, "seg").join(self.parts, "seg")
                 .withColumn("ask", F.pmod(F.xxhash64("q"), F.col("asks")).cast("int"))
                 .select("seg", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ask", "q", "floor"))
        index = self.index.join(per, "seg").select("seg", "part", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"),
                                                   "block", "x", "ids", "high", "low")
        key = ["seg", "part", "ask"]
        return written(index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
            lambda a, b: search_tile(a, b, kind, dim, exact, k), FOUND), "found")

    def best(self, found: DataFrame) -> DataFrame:
        """The first k rows of each query, numbered ``r``."""
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), F.desc("same"))
        return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= self.k)

    def search(self, asked: DataFrame) -> DataFrame:
        """FOUND rows with ``r`` for the distinct vectors ``q`` of ``asked``."""
        none = F.lit(None).cast("long")
        near = self.tiles(self.routed(asked.select("q", none.alias("floor")), True))
        floors = self.best(near).where(F.col("r") == self.k).select("q", F.col("score").alias("floor"))
        rest = self.tiles(self.routed(asked.join(floors, "q", "left"), False))
        return self.best(near.unionByName(rest))


def nearest(vectors: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row that meets the condition
    ``asks``, the ``k`` other rows (all, if fewer) of greatest inner product."""
    spark = vectors.sparkSession
    result = f"query_id long, rank int, {id_col} long, score long"
    rows = integer_vectors(vectors, id_col, vec_col, asks)
    dim, most = shape(rows)
    if not dim:
        rows = written(rows.select("id", "flag", F.array(F.lit(0).cast("long")).alias("x")), "integer-vectors")
        if not rows.limit(1).count():
            return spark.createDataFrame([], result)
        dim, most = 1, 0
    kind = width(most)
    rows = written(packed(rows, dim, kind), "integer-vectors")
    searcher = Searcher(rows, dim, kind, number(dim, most), k + 1)
    queries = rows.where("flag").select(F.col("id").alias("query_id"), F.col("x").alias("q"))
    found = searcher.search(written(queries.select("q").distinct(), "queries"))
    answers = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "score", "id", "same"))).alias("found"))
    own = F.array_position(F.transform("found", lambda e: e["same"] & e["id"].eqNullSafe(F.col("query_id"))), True)
    others = F.filter("found", lambda e, i: i + 1 != F.col("own"))
    return (queries.join(answers, "q").withColumn("own", own).select("query_id", F.slice(others, 1, k).alias("e"))
            .select("query_id", F.posexplode("e").alias("at", "e"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias(id_col),
                    F.col("e.score").alias("score")))
