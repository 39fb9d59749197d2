"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

A document's set holds its distinct word shingles. Two documents link when
100 * |A and B| >= percent * |A or B|. Result: per document its set size and
the least id of its component. Every link between different sets is found:

1. Documents with equal sets fold into one (by a 128-bit key), a node named by
   the row number of one of them, not by its id.
2. Tiles of few min-hash keys propose each member beside the tile's least id;
   what the check confirms forms first components. This only saves work.
3. Exact rest: under one global order of shingles, linked sets share one of
   their first n - ceil(percent * n / 100) + 1 shingles. Tiles are these
   shingles by size band (bands are as wide as a link allows, so linked sets lie
   in one band or in neighbours); only members of different components become
   candidates, so a large group of near copies proposes no pairs here.
   Frequent shingles come last in the order, which keeps common passages out
   of the prefixes: first by a bounded histogram of all shingles; then the tiles
   that would hold more than HOT components are counted, their shingles go
   behind all others (as bits of a bounded table), and the prefixes that held
   one are taken anew: from the next shingles, which the sketch keeps too, or
   from the texts where too many of these are hot as well. Any order finds every
   link. Shingles of only one component make no tile (bits of another bounded
   table tell most). Of a linked pair, the set with fewer shingles has a common
   one among its first n - 2 * percent * n / (100 + percent): only these places
   stand on the smaller side of a tile.
4. The check of a candidate: hashed bitmaps of both sets (4 bits a shingle)
   bound the overlap from above by bit counts; survivors' texts meet at the
   lower node, split into parts of PART candidates, and sorted hash arrays are
   intersected exactly.

Defined results: null or blank text has no shingles and links with nothing;
fewer words than ``k`` make one shingle; a null id gets component null; rows
that repeat an id with the same text are one node; with different texts, the
id has the links of all of them. ``keep_one`` decides by row instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propcube.llm.common import by_bytes, leave_one, may_match, mix, shingle_hashes, ship, text_key, utf8, word_hashes, words, written
from propcube.llm.components import components

BIN_BITS = 18
BINS = 1 << BIN_BITS  # of the histogram of shingles
STEPS = 8  # levels of the order in each doubling of a bin's count
KEYS, PER_KEY = 8, 2  # min-hash keys of the first components, hashes in each
MAX_BITS = 1 << 15  # a bitmap's size; a smaller one only loosens the bound
PART = 1000  # candidates of one node that are checked together
SIEVE_BITS = 22  # the sieve of candidates' ids has 2^22 bits
HOT, HOT_BITS = 8, 24  # components that make a tile hot; the tables of shingles have 2^24 bits
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = mix(np.arange(1, KEYS * PER_KEY + 1, dtype=np.uint64))


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw = _LOWER[raw]
    starts, ends, counts = words(raw, offsets)
    word = word_hashes(raw, starts, ends)
    runs = shingle_hashes(word, k)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for lo, n in zip(first[:-1].tolist(), counts.tolist()):
        if n >= k:
            out.append(np.unique(runs[lo:lo + n - k + 1]))
        else:
            out.append(shingle_hashes(word[lo:lo + n], n) if n else runs[:0])
    return out


def texts_of(batches: Iterator[pa.RecordBatch], k: int, step: int = 1 << 18):
    """(row batch, first row, sets) piece by piece."""
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        for lo, hi in by_bytes(offsets, step):
            yield batch, lo, shingles(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], k)


def levels(docs: DataFrame, k: int) -> np.ndarray:
    """Of each bin of shingles: how far above the mean it is, in STEPS to each
    doubling. A passage that many documents share lifts its bins."""
    def count(batches):
        seen = np.zeros(BINS, np.int64)
        for _, _, sets in texts_of(batches, k):
            seen += np.bincount((np.concatenate(sets) >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=BINS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bin", "n"])

    rows = docs.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(BINS)  # BINS rows at most came to the driver
    for r in rows:
        seen[r["bin"]] = r["n"]
    return np.minimum(255, STEPS * np.log2(np.maximum(1, seen / max(8.0, seen.mean())))).astype(np.uint8)


def bitmap(values: np.ndarray) -> bytes:
    bits = 64
    while bits < min(MAX_BITS, 4 * len(values)):
        bits *= 2
    held = np.zeros(bits, bool)
    held[(values & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(held).tobytes()


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def first_of(s: np.ndarray, late: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` of sorted shingles in the order of (late, shingle)."""
    return s[np.argsort(late, kind="stable")[:size]] if late.any() else s[:size]


def sketches(docs: DataFrame, order, k: int, percent: int) -> DataFrame:
    """(id, h1, h2, n, k1, k2, keys, bits, prefix, more) of each row, ``order``
    being a broadcast of ``levels``; ``more`` goes on where the prefix ends, up
    to its size again."""

    def sketch(batches):
        level = order.value
        for batch, lo, sets in texts_of(batches, k):
            n = [len(s) for s in sets]
            sums, xors, keys, bits, prefix, more = [], [], [], [], [], []
            for s in sets:
                if not len(s):
                    sums.append(0), xors.append(0), keys.append([]), bits.append(b""), prefix.append([]), more.append([])
                    continue
                mixed = mix(s)
                sums.append(int(np.add.reduce(mixed)) - (1 << 63))
                xors.append(int(np.bitwise_xor.reduce(mix(mixed))) - (1 << 63))
                least = np.min([mix(s[i:i + 8192, None] ^ _SEEDS).min(axis=0) for i in range(0, len(s), 8192)],
                               axis=0).reshape(KEYS, PER_KEY)
                keys.append(mix(least[:, 0] + mix(least[:, 1] + _SEEDS[:KEYS])).view(np.int64))
                bits.append(bitmap(s))
                late = level[(s >> np.uint64(64 - BIN_BITS)).astype(np.int64)]
                size = prefix_size(len(s), percent)
                most = first_of(s, late, 2 * size).view(np.int64)
                prefix.append(most[:size]), more.append(most[size:])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c)[lo:lo + len(sets)] for c in ("id", "h1", "h2")), pa.array(n, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(xors, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
                 *(pa.array(x, pa.list_(pa.int64())) for x in (prefix, more))],
                ["id", "h1", "h2", "n", "k1", "k2", "keys", "bits", "prefix", "more"])

    h1, h2 = text_key(F.col("text"))
    return docs.withColumn("h1", h1).withColumn("h2", h2).mapInArrow(
        sketch, "id long, h1 long, h2 long, n long, k1 long, k2 long, keys array<long>, bits binary, prefix array<long>, more array<long>")


def fits(a: str, b: str, percent: int):
    """Sizes that a link allows."""
    return ((100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))))


def _bound(percent: int):
    @F.arrow_udf("boolean")
    def may_link(x: pa.Array, y: pa.Array, nx: pa.Array, ny: pa.Array) -> pa.Array:
        out = []
        for p, q, n, m in zip(x, y, nx.to_pylist(), ny.to_pylist()):
            p, q = (np.frombuffer(v.as_py(), np.uint8) for v in (p, q))
            while len(p) != len(q):  # the longer bitmap folds onto the shorter: bit i mod its size
                if len(p) > len(q):
                    p = p.reshape(2, -1)[0] | p.reshape(2, -1)[1]
                else:
                    q = q.reshape(2, -1)[0] | q.reshape(2, -1)[1]
            apart = int(np.bitwise_count(p ^ q).sum())
            both = (n + m - apart) // 2
            out.append(100 * both >= percent * (n + m - both))
        return pa.array(out, pa.bool_())

    return may_link


def sieve(ids: DataFrame, size: int = SIEVE_BITS) -> np.ndarray:
    """Bit set of hashed ids: bounded, whatever the number of ids."""
    h = F.pmod(F.xxhash64("id"), F.lit(1 << size))
    rows = (ids.groupBy(F.shiftright(h, 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) AS int))")).alias("bits")).toArrow())
    out = np.zeros(1 << (size - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def among(ids: DataFrame, col: str = "id") -> Column:
    """Whether a row's id may be among ``ids`` (else it surely isn't)."""
    bits = ids.sparkSession.sparkContext.broadcast(sieve(ids))

    @F.arrow_udf("boolean")
    def may_hold(h: pa.Array) -> pa.Array:
        v = h.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((bits.value[v >> 6] >> (v & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return may_hold(F.pmod(F.xxhash64(col), F.lit(1 << SIEVE_BITS)))


def sifted(docs: DataFrame, ids: DataFrame, within: bool = True) -> DataFrame:
    """Rows of ``docs`` whose id may be among ``ids`` (or else the others,
    whose id surely isn't); saves shuffling texts."""
    held = among(ids)
    return docs.where(held if within else ~held)


def narrowed(rows: DataFrame, ids: DataFrame, col: str = "id") -> DataFrame:
    """``rows`` whose ``col`` may be among the ``ids``, told by a join with their
    bits: no Python worker beside those of the stage's own work, and texts do
    not pass through one."""
    keys = ids.select(F.xxhash64("id").alias("key"))
    return may_match(rows.withColumn("__hash", F.xxhash64(col)), "__hash", keys, SIEVE_BITS).where("__may").select(rows.columns)


def check(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``nodes`` that link, by bitmap bound and then
    exactly. A node's text is that of its row (id and text key) of ``docs``."""
    pairs = written(pairs, "candidates")
    own = narrowed(nodes.select("node", "n", "bits"), pairs.select(F.explode(F.array("a", "b")).alias("id")), "node")
    pairs = (pairs.join(own.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n").alias("nx")), "a")
             .join(own.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n").alias("ny")), "b")
             .where(_bound(percent)("x", "y", "nx", "ny")).select("a", "b"))
    pairs = written(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    split = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    own_rows = parts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    place = nodes.select(F.col("node").alias("b"), F.coalesce("id", F.lit(0)).alias("id"), "h1", "h2")
    wanted = written(split.unionByName(own_rows).join(place, "b"), "wanted")
    h1, h2 = text_key(F.col("text"))
    texts = narrowed(docs.select(F.coalesce("id", F.lit(0)).alias("id"), "text"), wanted.select("id")).select(
        "id", h1.alias("h1"), h2.alias("h2"), "text")
    # rows that repeat id and text: one stands for them
    met = wanted.join(texts.groupBy("id", "h1", "h2").agg(F.max("text").alias("text")), ["id", "h1", "h2"])

    def exact(batches):
        now, base = None, None
        for batch, lo, sets in texts_of(batches, k):
            a = batch.column("a")[lo:lo + len(sets)].to_pylist()
            b = batch.column("b")[lo:lo + len(sets)].to_pylist()
            part = batch.column("part")[lo:lo + len(sets)].to_pylist()
            hit = []
            for i, s in enumerate(sets):
                if a[i] == b[i]:
                    now, base = (a[i], part[i]), s
                elif now == (a[i], part[i]):
                    both = len(np.intersect1d(base, s, assume_unique=True))
                    if 100 * both >= percent * (len(base) + len(s) - both):
                        hit.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hit], pa.int64()),
                                              pa.array([b[i] for i in hit], pa.int64())], ["a", "b"])

    return (met.select("a", "part", "b", "text").repartition("a", "part")
            .sortWithinPartitions("a", "part", F.col("b") != F.col("a"), "b").mapInArrow(exact, "a long, b long"))


def bits_of(counted: DataFrame, least: int) -> np.ndarray:
    """Bit set of the shingles ``token`` that ``counted`` (token, c) gives at
    least ``least`` times."""
    tokens = counted.groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select(slot(F.col("token")).alias("id"))
    rows = tokens.groupBy(F.shiftright("id", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(id & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (HOT_BITS - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def slot(token: Column) -> Column:
    """A shingle's bit: its lowest HOT_BITS bits."""
    return token.bitwiseAND(F.lit((1 << HOT_BITS) - 1))


def is_set(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    at = s & np.uint64((1 << HOT_BITS) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def prefixes(batches: Iterator[pa.RecordBatch], step: int = 1 << 17):
    """(rows, where their prefixes start and end, the shingles in them) of some
    ``step`` shingles at a time."""
    for batch in batches:
        p = batch.column("prefix")
        first = p.offsets.to_numpy().astype(np.int64)
        for lo, hi in by_bytes(first, step):
            yield (batch.slice(lo, hi - lo), first[lo:hi + 1] - first[lo],
                   p.values[int(first[lo]):int(first[hi])].to_numpy().view(np.uint64))


def settled(nodes: DataFrame, docs: DataFrame, order, bits, k: int, percent: int) -> DataFrame:
    """(id, n, prefix) of ``nodes`` in the final order: hot shingles (by the
    broadcast ``bits``) last. A prefix without a hot one stays; the others are
    taken anew, from ``more`` if that suffices, else from their texts."""
    def cooled(rows, first, token):
        """Rows whose prefix stays, (row, prefix) of those taken anew, and rows
        that only the text tells."""
        seen = np.concatenate([[0], np.cumsum(is_set(bits.value, token))])
        hot = seen[first[1:]] > seen[first[:-1]]
        anew, short = [], []
        for i in np.flatnonzero(hot).tolist():
            p, m = (rows.column(c)[i].values.to_numpy() for c in ("prefix", "more"))
            s = np.concatenate([p, m])
            late = is_set(bits.value, s.view(np.uint64))
            # hot ones are told in order only if these are all shingles
            if len(s) == rows.column("n")[i].as_py() or np.count_nonzero(~late) >= len(p):
                anew.append((i, first_of(s, late, len(p))))
            else:
                short.append(i)
        return np.flatnonzero(~hot), anew, short

    def told(batches):
        for piece in prefixes(batches):
            stay, anew, _ = cooled(*piece)
            rows, at = piece[0], pa.array([i for i, _ in anew], pa.int64())
            yield rows.select(["id", "n", "prefix"]).take(pa.array(stay))
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(at) for c in ("id", "n")),
                                              pa.array([s for _, s in anew], pa.list_(pa.int64()))], ["id", "n", "prefix"])

    def untold(batches):
        for piece in prefixes(batches):
            yield piece[0].select(["id", "doc", "h1", "h2"]).take(pa.array(cooled(*piece)[2], pa.int64()))

    marked = nodes.select(F.col("node").alias("id"), F.coalesce("id", F.lit(0)).alias("doc"), "h1", "h2", "n", "prefix", "more")
    short = written(marked.mapInArrow(untold, "id long, doc long, h1 long, h2 long").select(
        F.col("id").alias("node"), F.col("doc").alias("id"), "h1", "h2"), "hot-rows")
    h1, h2 = text_key(F.col("text"))
    texts = narrowed(docs.select(F.coalesce("id", F.lit(0)).alias("id"), "text"), short.select("id")).select(
        "id", h1.alias("h1"), h2.alias("h2"), "text")
    met = short.join(texts.groupBy("id", "h1", "h2").agg(F.max("text").alias("text")), ["id", "h1", "h2"]).select("node", "text")

    def again(batches):
        for batch, lo, sets in texts_of(batches, k):
            prefix = []
            for s in sets:
                late = order.value[(s >> np.uint64(64 - BIN_BITS)).astype(np.int64)] + np.where(is_set(bits.value, s), 256, 0)
                prefix.append(first_of(s, late, prefix_size(len(s), percent)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node")[lo:lo + len(sets)], pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array(prefix, pa.list_(pa.int64()))], ["id", "n", "prefix"])

    return marked.mapInArrow(told, "id long, n long, prefix array<long>").unionByName(
        met.mapInArrow(again, "id long, n long, prefix array<long>"))


def tiles_of(final: DataFrame, shared, percent: int) -> DataFrame:
    """(token, band, pos, id, n, comp, alone) of the shingles that more than one
    component may have, by the broadcast bits ``shared``."""
    def place(batches):
        for b, first, token in prefixes(batches):
            size = np.diff(first)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(token)) - np.repeat(first[:-1], size)
            use = is_set(shared.value, token)
            at = pa.array(row[use])
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[use].view(np.int64)), pa.array(pos[use])] + [b.column(c).take(at) for c in ("id", "n", "comp", "alone")],
                ["token", "pos", "id", "n", "comp", "alone"])

    rows = final.mapInArrow(place, "token long, pos long, id long, n long, comp long, alone boolean")
    return rows.withColumn("band", band_of(F.col("n"), percent))


def prefix_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components that share a tile.
    ``tiles``: (token, band, pos, id, n, comp, alone), pos being the token's
    place in the order of its set. A tile is a token and a size band; the
    smaller set also stands in the next band. Of a linked pair, the first
    common token leaves enough places behind it on both sides for the overlap
    that a link needs; the smaller set's place must allow it for two of its
    size."""
    near = fits("n", "n2", percent) & (
        F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) * (100 + percent)
        >= percent * (F.col("n") + F.col("n2")))
    ordered = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2")))
    tile = ["token", "band"]
    rows = tiles.select(*tile, "pos", "id", "n", "comp", "alone")

    def beside(some):  # as the smaller set: in its own band and the next
        return some.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))

    def right(some):
        return some.select(*tile, *[F.col(c).alias(c + "2") for c in some.columns if c not in tile])

    less = rows.where((F.col("n") - F.col("pos")) * (100 + percent) >= 2 * percent * F.col("n")).drop("comp")
    more = rows.drop("comp")
    pairs = beside(less.drop("alone")).join(right(more.where("alone").drop("alone")), tile)
    mixed = beside(less.where("alone").drop("alone")).join(right(more.where("NOT alone").drop("alone")), tile)
    # components of several members meet once per tile; only pairs of them that fit are spread to members
    others = rows.where("NOT alone").drop("alone")
    groups = others.groupBy(*tile, "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    wide = groups.select("token", F.col("band").alias("band2"), *[F.col(c).alias(c + "2") for c in ("comp", "lo", "hi")],
                         F.explode(F.array(*[F.col("band") + b for b in (0, -1, 1)])).alias("band"))
    met = groups.join(wide, tile).where(
        (F.col("comp") < F.col("comp2")) & (100 * F.col("hi2") >= percent * F.col("lo"))
        & (100 * F.col("hi") >= percent * F.col("lo2"))).select(*tile, "comp", "band2", "comp2")
    o2 = others.select("token", *[F.col(c).alias(c + "2") for c in ("band", "pos", "comp", "id", "n")])
    across = met.join(others, [*tile, "comp"]).join(o2, ["token", "band2", "comp2"]).where(near)
    both = [p.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
            for p in (pairs.where(ordered & near), mixed.where(ordered & near), across)]
    return both[0].unionByName(both[1]).unionByName(both[2]).distinct()


def band_of(n: Column, percent: int) -> Column:
    """Size band: two sizes that a link allows are at most one band apart (the
    sizes' quotient is at most 100 / percent; a little slack for rounding)."""
    return F.floor(F.log(n.cast("double")) / (-math.log(percent / 100) * (1 + 1e-9)) if percent < 100 else n).cast("long")


def linked_sets(rows: DataFrame, docs: DataFrame, order, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of sketched ``rows``: the distinct sets (k1, k2, node, least id), and
    (id, component) of the nodes that link."""
    sets = written(rows.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("id").alias("rep")), "sets")
    nodes = rows.withColumnRenamed("row", "node")
    keyed = nodes.join(sets.select("node"), "node", "left_semi").select(F.col("node").alias("id"), "n", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("h"), F.count(F.lit(1)).alias("c")) \
        .where("c > 1").select("key", F.col("h.id").alias("a"), F.col("h.n").alias("na"))
    first = (keyed.join(hubs, "key").where((F.col("a") < F.col("id")) & fits("n", "na", percent))
             .select("a", F.col("id").alias("b")).distinct())
    links = written(check(first, nodes, docs, k, percent), "links")
    comps = written(components(links), "components")

    member = sets.select(F.col("node").alias("id")).join(comps, "id", "left").select(
        "id", F.coalesce("component", "id").alias("comp"), F.col("component").isNull().alias("alone"))
    broadcast = docs.sparkSession.sparkContext.broadcast
    one = F.lit(1).cast("long").alias("c")
    # one member stands for its component here: this count only shapes the order
    some = narrowed(nodes.select("node", "prefix"), member.where("alone OR comp = id").select("id"), "node")
    hot = bits_of(some.select(F.explode("prefix").alias("token"), one), HOT + 1)
    final = written(settled(narrowed(nodes, sets.select(F.col("node").alias("id")), "node"), docs, order, broadcast(hot), k, percent)
                    .join(member, "id"), "prefixes")
    tokens = final.select(F.explode("prefix").alias("token"), "comp", "alone")
    counted = tokens.where("alone").select("token", one).unionByName(
        tokens.where("NOT alone").select("token", "comp").distinct().select("token", one))
    tiles = written(tiles_of(final, broadcast(bits_of(counted, 2)), percent), "tiles")
    more = written(check(prefix_pairs(tiles, percent), nodes, docs, k, percent), "links")
    if more.limit(1).count():
        comps = joined(comps, more)
    return sets, comps


def joined(comps: DataFrame, more: DataFrame) -> DataFrame:
    """Components with the links (a, b) of ``more`` as well."""
    return written(components(comps.select(F.col("id").alias("a"), F.col("component").alias("b"))
                              .unionByName(more)), "components")


def sketched(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, object]:
    """``docs`` as (id, text), their sketches, each with a row number, and the
    order of shingles (a broadcast)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(levels(docs, k))
    return docs, written(sketches(docs, order, k, percent).withColumn("row", F.monotonically_increasing_id()), "sketch"), order


def placed(sets: DataFrame, comps: DataFrame) -> DataFrame:
    """(k1, k2, rep, comp) of each set."""
    return sets.join(comps.withColumnRenamed("id", "node"), "node", "left").select(
        "k1", "k2", "rep", F.coalesce("component", "node").alias("comp"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    docs, sketch, order = sketched(docs, k, percent, id_col, text_col)
    some = sketch.where("n > 0 AND id IS NOT NULL")
    sets, comps = linked_sets(some, docs.where("id IS NOT NULL"), order, k, percent)
    several = written(some.groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("k1", "k2")])
                      .where("min_k1 < max_k1 OR min_k2 < max_k2").select("id"), "several")
    if several.limit(1).count():  # sets of one id belong together
        of = written(some.join(several, "id", "left_semi").select("id", "k1", "k2").distinct()
                     .join(sets, ["k1", "k2"]).select("id", "node"), "of")
        comps = joined(comps, of.join(of.groupBy("id").agg(F.min("node").alias("a")), "id")
                       .select("a", F.col("node").alias("b")))
    put = written(placed(sets, comps), "placed")
    named = put.join(put.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("k1", "k2", "component_id")
    got = some.select("id", "n", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n", "component_id")
    rest = sketch.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"))
    return got.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of linked texts, the row with the least id (null last),
    and all rows without shingles. Rows are told apart by id and text: another
    text of the same (or null) id has groups of its own."""
    pairs, sketch, order = sketched(docs, k, percent, "doc_id", "text")
    some = sketch.where("n > 0")
    sets, comps = linked_sets(some, pairs, order, k, percent)
    rows = some.select("id", "h1", "h2", "k1", "k2").join(placed(sets, comps), ["k1", "k2"]).select(
        F.col("comp").alias("group"), F.lit(0).alias("first"), "id", F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    return leave_one(docs, rows, "doc_id", "text")
