"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole
document. Learned filters of WIDTH bytes slide over each chunk; each filter's
greatest response in the chunk (max pooling) and the chunk's self-similarity
at short byte lags feed one logit per chunk; the document's probability is a
logistic combination of the mean, least and greatest chunk logit.

Training happens on the driver on a bounded sample of labelled rows
(``per_class`` rows of each label, each of ``train_bytes`` bytes at most,
chosen by hash); scoring runs in the tasks over every byte of every row.

Defined results: null text scores as the empty text; null or other labels
than 0 and 1 are not learned from; a label repeated for a document counts
once; without labels of both kinds every score is the share of label 1 (0.5
without labels). Rows keep their multiplicity; other columns are untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propcube.llm.common import by_bytes, crc_of, ship, utf8

WIDTH, STRIDE, BLOCK = 8, 4, 128  # bytes of a filter, between its places, and of a block
CHUNK_BLOCKS, CHUNK_STEP = 4, 3  # a chunk is 4 blocks; chunks start 3 blocks apart
FILTERS = 16
LAGS = range(2, 33)
SAME_SCALE = 6.0  # brings self-similarity to the range of the responses
THRESHOLD = 0.3


@dataclass
class Model:
    tables: np.ndarray  # WIDTH x 256 x FILTERS: a byte's share in a filter's response
    bias: np.ndarray
    chunk_w: np.ndarray
    chunk_b: float
    doc_w: np.ndarray
    doc_b: float

    def responses(self, grid: np.ndarray) -> np.ndarray:
        """Filter responses at every STRIDE-th byte of a padded buffer."""
        at = np.arange(0, len(grid), STRIDE)
        wide = np.concatenate([grid, np.zeros(WIDTH, np.uint8)])
        acc = self.tables[0][wide[at]]
        for j in range(1, WIDTH):
            acc += self.tables[j][wide[at + j]]
        return acc


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out from block to block, zero bytes behind each, and the
    number of blocks of each text (one at least)."""
    size = np.diff(offsets)
    # as many zero bytes as the longest lag, so that no text meets its neighbour
    blocks = np.maximum(1, -(-(size + LAGS[-1]) // BLOCK))
    at = np.concatenate([[0], np.cumsum(blocks)]) * BLOCK
    grid = np.zeros(int(at[-1]), np.uint8)
    for i, n in enumerate(size):
        grid[at[i]:at[i] + n] = raw[offsets[i]:offsets[i + 1]]
    return grid, blocks


def self_similarity(grid: np.ndarray) -> np.ndarray:
    """Of each block: the greatest share of bytes equal to the one a lag before."""
    n = len(grid) // BLOCK
    best = np.zeros(n, np.uint8)
    solid = grid != 0
    same = np.zeros(len(grid), np.uint8)
    for lag in LAGS:
        same[:lag] = 0
        np.equal(grid[lag:], grid[:-lag], out=same[lag:].view(bool))
        np.logical_and(same, solid, out=same.view(bool))
        np.maximum(best, same.reshape(n, BLOCK).sum(axis=1, dtype=np.uint8), out=best)
    return best.astype(np.float32) * (SAME_SCALE / BLOCK)


def chunk_blocks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks x CHUNK_BLOCKS block numbers, first chunk of each text)."""
    chunks = np.maximum(1, -(-(blocks - 1) // CHUNK_STEP))
    first = np.concatenate([[0], np.cumsum(chunks)])
    doc = np.repeat(np.arange(len(blocks)), chunks)
    nth = np.arange(first[-1]) - first[doc]
    base = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    member = nth[:, None] * CHUNK_STEP + np.arange(CHUNK_BLOCKS)
    return base[doc][:, None] + np.minimum(member, (blocks[doc] - 1)[:, None]), first


def features(model: Model, grid: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per chunk: pooled responses, then self-similarity (mean and greatest)."""
    per = model.responses(grid).reshape(-1, BLOCK // STRIDE, FILTERS)
    last = np.cumsum(blocks) - 1  # the last place of a text's last block reaches into the next text
    per[last, -1] = per[last, -2]
    per = per.max(axis=1)
    same = self_similarity(grid)
    member, first = chunk_blocks(blocks)
    pooled = np.maximum(per[member].max(axis=1) + model.bias, 0)
    near = same[member]
    return np.hstack([pooled, near.mean(axis=1, keepdims=True), near.max(axis=1, keepdims=True)]), first


def combined(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: mean, least and greatest logit of its chunks."""
    at = first[:-1]
    mean = np.add.reduceat(logits, at) / np.diff(first)
    return np.stack([mean, np.minimum.reduceat(logits, at), np.maximum.reduceat(logits, at)], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chunk_logits(model: Model, raw: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Combined logits of the chunks of each text, some ``step`` bytes of texts
    at a time."""
    out = np.zeros((len(offsets) - 1, 3))
    for lo, hi in by_bytes(offsets, step):
        grid, blocks = padded(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        x, first = features(model, grid, blocks)
        out[lo:hi] = combined(x @ model.chunk_w + model.chunk_b, first)
    return out


def score_texts(model: Model, raw: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Probability of label 1 of each text."""
    return sigmoid(chunk_logits(model, raw, offsets, step) @ model.doc_w + model.doc_b)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400, ridge: float = 1e-3):
    """Weighted logistic regression on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, w, b = (x - mean) / scale, np.zeros(x.shape[1]), 0.0
    weight = weight / weight.sum()
    for _ in range(steps):
        gap = (sigmoid(z @ w + b) - y) * weight
        w -= 2.0 * (z.T @ gap + ridge * w)
        b -= 2.0 * gap.sum()
    return w / scale, b - float((w / scale) @ mean)


def train(texts: list[str], labels: list[int], priors: tuple[float, float],
          steps: int = 500, batch: int = 192, seed: int = 7) -> Model:
    """Fit filters and chunk weights by Adam on chunks (a chunk has its
    document's label), then the combination of chunks on documents.
    ``priors``: weight of a row of label 0 and 1."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                  rng.normal(0, 0.1, FILTERS + 2).astype(np.float32), 0.0, np.zeros(3), 0.0)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        model.doc_b = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return model
    encoded = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in encoded])])
    grid, blocks = padded(np.frombuffer(b"".join(encoded), np.uint8), offsets)
    same = self_similarity(grid)
    member, first = chunk_blocks(blocks)
    doc = np.repeat(np.arange(len(blocks)), np.diff(first))
    wide = np.concatenate([grid, np.zeros(WIDTH, np.uint8)])
    inside = np.arange(0, BLOCK, STRIDE)
    ends = np.zeros(int(blocks.sum()), bool)
    ends[np.cumsum(blocks) - 1] = True
    kinds = [np.flatnonzero(y[doc] == k) for k in (0, 1)]
    state = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))]
             for k in ("tables", "bias", "chunk_w")}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(k, batch // 2) for k in kinds])
        at = (member[pick][:, :, None] * BLOCK + inside).reshape(len(pick), -1)
        bytes_at = wide[at[:, :, None] + np.arange(WIDTH)]
        acc = sum(model.tables[j][bytes_at[:, :, j]] for j in range(WIDTH))
        acc.reshape(len(pick), CHUNK_BLOCKS, len(inside), FILTERS)[ends[member[pick]], -1] = -np.inf
        top = acc.argmax(axis=1)
        pre = np.take_along_axis(acc, top[:, None, :], 1)[:, 0] + model.bias
        near = same[member[pick]]
        x = np.hstack([np.maximum(pre, 0), near.mean(axis=1, keepdims=True), near.max(axis=1, keepdims=True)])
        gap = ((sigmoid(x @ model.chunk_w + model.chunk_b) - y[doc[pick]]) / len(pick)).astype(np.float32)
        back = gap[:, None] * model.chunk_w[:FILTERS] * (pre > 0)
        grads = {"chunk_w": x.T @ gap + 1e-4 * model.chunk_w, "bias": back.sum(axis=0),
                 "tables": 1e-5 * model.tables}
        chosen = bytes_at[np.arange(len(pick))[:, None], top]  # pick x filter x WIDTH
        for j in range(WIDTH):
            flat = chosen[:, :, j].astype(np.int64) * FILTERS + np.arange(FILTERS)
            grads["tables"][j] += np.bincount(flat.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        model.chunk_b -= 0.05 * float(gap.sum())
        for k, g in grads.items():
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            getattr(model, k)[...] -= 0.02 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    z = chunk_logits(model, np.frombuffer(b"".join(encoded), np.uint8), offsets)
    w, b = _logistic(z, y, np.where(y == 1, priors[1], priors[0]))
    model.doc_w, model.doc_b = w, float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 1500,
        train_bytes: int = 1 << 15) -> Model:
    """Train on a bounded sample of the rows of ``docs`` that ``labels``
    (doc_id, quality) marks and ``learn`` (a condition on doc_id) allows:
    the ``per_class`` smallest hashes of each label among them."""
    marked = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
              .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    counts = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}
    texts, values = [], []
    for kind in sorted(counts):
        few = marked.where(F.col("quality") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                .where(F.octet_length("text") <= train_bytes)
                .join(F.broadcast(few.select("doc_id")), "doc_id")  # per_class ids at most
                .orderBy("doc_id", "text").limit(per_class).collect())
        texts += [r["text"] for r in rows]
        values += [kind] * len(rows)
    n = {k: max(1, values.count(k)) for k in (0, 1)}
    return train(texts, values, (counts.get(0, 0) / n[0], counts.get(1, 0) / n[1]))


def scorer(spark, model: Model):
    """Column function: text -> probability of label 1."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        raw, offsets = utf8(text)
        return pa.array(score_texts(shared.value, raw, offsets))

    return score


def learnable(col: str = "doc_id") -> Column:
    """Rows whose label may be learned from; the others are held out."""
    return crc_of(col) % 5 != 0


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    score = scorer(docs.sparkSession, fit(docs, labels, learnable()))
    return docs.select("doc_id", (~learnable()).alias("held_out"),
                       score(F.coalesce("text", F.lit(""))).alias("score")).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
