"""Embedding near-dedup: iterative quantisation and multi-index Hamming tables.

Rotations that balance the sign bits of centred vectors are learned from a
bounded sample (``SAMPLE`` vectors, smallest hashes). Each vector's code is
cut into substrings, one per table; vectors that agree in a table's substring
share a bucket, where the original vectors are compared by cosine in double
precision. Substring length is at most log2 of the number of vectors (so bucket
sizes do not grow by need) and as short as costs least; the number of tables
is that at which pairs made at the threshold from the sample, coded like the
vectors, are found with a recall of ``RECALL``.

Equal vectors fold into one first. Buckets above ``BLOCK`` vectors are cut
into blocks, and each pair of blocks is a tile of its own; tiles return sums
of links and one star per connected part, never pairs. A pair counts in the
first table where its codes agree.

Defined results: vectors that are null, empty, zero, hold null or non-finite
components, have another length than most (the least length on ties), or have
a null id link with nothing and are their own component; repeated rows are
separate vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propcube.llm.common import ship, written
from propcube.llm.components import components

SAMPLE, ROUNDS = 4096, 30
RECALL = 0.98
TABLES = 256
BLOCK = 1024
PAIRS, PLANES = 8192, 512  # pairs and hyperplanes that agreement is measured on, at least
ROW = 256  # products that cost as much as a row placed in a table


def fit_rotation(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Principal axes of centred rows ``x``, turned so that signs lose least."""
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    full = np.zeros((x.shape[1], x.shape[1]))
    full[:len(axes)] = axes
    v = x @ full.T
    turn, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
    for _ in range(ROUNDS):
        signs = np.where(v @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ v)
        turn = (left @ right).T
    return full.T @ turn


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a substring, tables) for ``n`` vectors without a common mean."""
    bits = max(6, min(30, round(math.log2(max(n, 2)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def pairs_at(x: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of PAIRS pairs of unit vectors at the threshold: rows of ``x``,
    half of them turned any way, half turned towards another row."""
    a = x[rng.integers(0, len(x), PAIRS)]
    away = rng.normal(size=a.shape)
    half = PAIRS // 2
    towards = x[rng.integers(0, len(x), half)] - a[:half]
    towards -= (towards * a[:half]).sum(axis=1, keepdims=True) * a[:half]
    apart = np.linalg.norm(towards, axis=1) > 1e-6
    away[:half][apart] = towards[apart]
    away -= (away * a).sum(axis=1, keepdims=True) * a
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    return a, threshold * a + math.sqrt(1 - threshold ** 2) * away


def worse(hit: np.ndarray) -> float:
    """The lower mean of the two kinds of pairs."""
    return min(hit[:PAIRS // 2].mean(), hit[PAIRS // 2:].mean())


class Coder:
    """Learned rotations and the cut of codes into table substrings.

    Centring widens the angle of a pair, by more the more of the vectors their
    mean holds, so ``plan`` only bounds the bits from above: agreement is
    measured on pairs at the threshold made from the sample, the bits are those
    of the least estimated work for ``n`` vectors, six at least, and
    tables are added until the measured recall is RECALL. Where TABLES of them do
    not reach it, the substrings get shorter (to nothing only where signs tell
    nothing, as in one dimension)."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.mean = sample.mean(axis=0)
        # rotations fit their own rows better than others: pairs come from other rows
        own, others = (sample[::2], sample[1::2]) if len(sample) > 1 else (sample, sample)
        a, b = pairs_at(others, threshold, rng)
        turns, alike = [], []

        def more():
            turn = fit_rotation(own - self.mean, rng)[:, rng.permutation(d)]
            turns.append(turn)
            alike.append(((a - self.mean) @ turn >= 0) == ((b - self.mean) @ turn >= 0))

        while len(turns) * d < PLANES:
            more()
        most, least = plan(n, threshold)
        self.bits = self._cheapest(others, np.hstack(turns), np.hstack(alike).mean(axis=1), n, most)
        while True:
            found, self.tables = np.full(PAIRS, self.bits == 0), 0 if self.bits else 1
            while self.bits and self.tables < TABLES and (
                    worse(found) < RECALL or (self.bits == most and self.tables < least)):
                lo = self.tables * self.bits
                while len(turns) * d < lo + self.bits:
                    more()
                span = [alike[i][:, max(0, lo - i * d):lo + self.bits - i * d]
                        for i in range(lo // d, (lo + self.bits - 1) // d + 1)]
                found |= np.hstack(span).all(axis=1)
                self.tables += 1
            if worse(found) >= RECALL:
                break
            self.bits -= 1
        self.recall = worse(found)
        self.turn = np.hstack(turns)[:, :self.bits * self.tables]

    def _cheapest(self, sample: np.ndarray, turn: np.ndarray, agree: np.ndarray, n: int, most: int) -> int:
        """Bits of least work: rows placed in tables and products in buckets."""
        signs = (sample - self.mean) @ turn >= 0

        def work(bits: int) -> float:
            chance, low, high = agree ** bits, 1, 1 << 40
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if worse(1 - (1 - chance) ** mid) >= RECALL else (mid + 1, high)
            tables, share = low, []
            for lo in range(0, min(8 * bits, turn.shape[1] - bits + 1), bits):
                c = np.unique(signs[:, lo:lo + bits] @ (1 << np.arange(bits, dtype=np.int64)), return_counts=True)[1]
                share.append((c * (c - 1.0)).sum() / max(1, len(sample) * (len(sample) - 1)))
            mates = n * max(np.mean(share), 0.5 ** bits)
            return tables * (ROW * max(1.0, mates / BLOCK) + mates)

        return min(range(most, 5, -1), key=work)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(vectors x tables) substrings of unit vectors."""
        signs = ((x - self.mean) @ self.turn >= 0).reshape(len(x), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stars(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least node of each node's connected part, for links (u, v)."""
    label = np.arange(n)
    while len(u):
        before = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def links_in(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, t: int, threshold: float, own: bool):
    """Positions (i, j) of links whose first common table is ``t``."""
    hit = x @ y.T >= threshold
    if own:
        hit = np.triu(hit, 1)
    for earlier in range(t):
        if not hit.any():
            break
        hit &= cx[:, earlier][:, None] != cy[:, earlier]
    return np.nonzero(hit)


def _tiles(batches: Iterator[pa.RecordBatch], dim: int, threshold: float, gather: int = 20_000):
    """Rows arrive sorted by tile; each whole tile gives (id, links, least)."""
    def done(rows: pa.Table):
        ids, w = rows.column("id").to_numpy(), rows.column("w").to_numpy()
        blocks, table = rows.column("block").to_numpy(), rows.column("t").to_numpy()
        x = unit(np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float32).reshape(-1, dim))
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int32).reshape(len(ids), -1)
        key = [rows.column(c).to_numpy() for c in ("t", "key", "i", "j")]
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])
        first = np.append(np.flatnonzero(new), len(ids))
        us, vs = [], []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo < 2:
                continue
            t = int(table[lo])
            if key[2][lo] == key[3][lo]:
                u, v = links_in(x[lo:hi], x[lo:hi], codes[lo:hi], codes[lo:hi], t, threshold, True)
                us.append(u + lo), vs.append(v + lo)
            else:
                a = lo + np.flatnonzero(blocks[lo:hi] == key[2][lo])
                b = lo + np.flatnonzero(blocks[lo:hi] == key[3][lo])
                u, v = links_in(x[a], x[b], codes[a], codes[b], t, threshold, False)
                us.append(a[u]), vs.append(b[v])
        u = np.concatenate(us) if us else np.zeros(0, np.int64)
        v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
        links = np.bincount(u, w[v], len(ids)) + np.bincount(v, w[u], len(ids))
        label = stars(u, v, len(ids))
        some = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[some], pa.int64()), pa.array(links[some].astype(np.int64)),
             pa.array(ids[label[some]], pa.int64())], ["id", "links", "least"])

    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, gather):
            part = batch.slice(lo, gather)
            if n >= gather:
                last = held[-1]
                key = [last.column(c)[-1].as_py() for c in ("t", "key", "i", "j")]
                other = np.any([part.column(c).to_numpy() != k for c, k in zip(("t", "key", "i", "j"), key)], axis=0)
                at = int(np.flatnonzero(other)[0]) if other.any() else part.num_rows
                held.append(part.slice(0, at))
                if at == part.num_rows:
                    continue
                yield done(pa.Table.from_batches(held).combine_chunks())
                part, held, n = part.slice(at), [], 0
            held.append(part)
            n += part.num_rows
    if held and sum(b.num_rows for b in held):
        yield done(pa.Table.from_batches(held).combine_chunks())


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~odd
              & F.exists("v", lambda x: x != 0))
    # a null condition (null vector) counts as unusable
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    sizes = rows.where("ok").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = sizes[0]["d"]
    rows = rows.withColumn("ok", F.col("ok") & (F.size("v") == dim))
    folded = written(rows.where("ok").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "vectors")
    sample = folded.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    coder = Coder(unit(np.array([r["v"] for r in sample], np.float32)), folded.count(), threshold)
    shared = spark.sparkContext.broadcast(coder)

    def code(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            codes = shared.value.codes(unit(x)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("w"), pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(list(codes), pa.list_(pa.int32()))],
                ["id", "w", "vec", "codes", "keys"])

    coded = written(folded.mapInArrow(code, "id long, w long, vec binary, codes binary, keys array<int>"), "codes")
    large = written(coded.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").count()
                    .where(F.col("count") > BLOCK)
                    .select("t", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb")), "large-buckets")
    placed = (coded.select("id", "w", "vec", "codes", F.posexplode("keys").alias("t", "key"))
              .join(large, ["t", "key"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
              .select("t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      "block", "id", "w", "vec", "codes"))
    found = written(placed.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j").mapInArrow(
        lambda b: _tiles(b, dim, threshold), "id long, links long, least long"), "tile-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    named = folded.join(links, "id", "left").join(comps, "id", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    got = rows.where("ok").join(named, "v").select("id", "n_links", "component_id")
    rest = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = got.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
