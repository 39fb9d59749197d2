"""Language of texts and words by a linear-chain conditional random field.

The words of a line form a chain (cut after ``CHAIN`` words). A word's score
for each language sums learned weights of hashed features: the word itself
(lexicon), its prefixes and suffixes, and the byte trigrams in and around it;
learned transition weights tie neighbours. Forward-backward gives each word's
marginal probabilities, so code-switched text is labelled word by word; a
document's language has the greatest sum of marginals over all its words, and
its score is their mean.

Training happens on the driver on a bounded sample: the ``per_lang`` smallest
hashes of each language among the learnable documents, at most
``train_bytes`` bytes of each. Chains of one to three pieces of different documents
teach the transitions. Prediction runs in the tasks over whole texts.

Defined results: null text or text without a letter is ``und`` with score 0; a
null language is not learned; with one language known it is always predicted,
with none every text is ``und``. Rows keep their multiplicity; ties go to the
language that sorts first. A text's result is the same in any batch; repeated
rows get equal results, and an id with several texts teaches one of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propcube.llm.common import by_bytes, crc_of, range_hasher, ship, utf8, words, written

TABLE = 1 << 17
PREFIXES, SUFFIXES = (2, 3, 5), (2, 3, 4, 6)  # bytes
CHAIN = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words x features) places in the weight table: lexicon and affixes."""
    hashes = range_hasher(raw)
    cols = [hashes(starts, ends)]
    cols += [hashes(starts, np.minimum(starts + n, ends)) + np.uint64(n) for n in PREFIXES]
    cols += [hashes(np.maximum(ends - n, starts), ends) + np.uint64(64 + n) for n in SUFFIXES]
    salt = np.arange(len(cols), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (((np.stack(cols, 1) ^ salt) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(47)).astype(np.int64)


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Place of the trigram around each byte; beyond the ends of each text
    (``offsets``) there are spaces, never another text."""
    byte = raw.astype(np.uint32)
    byte[(byte >= 9) & (byte <= 13)] = 32
    before, after = np.full(len(byte), 32, np.uint32), np.full(len(byte), 32, np.uint32)
    before[1:], after[:-1] = byte[:-1], byte[1:]
    some = offsets[1:] > offsets[:-1]
    before[offsets[:-1][some]] = 32
    after[offsets[1:][some] - 1] = 32
    value = before << 16 | byte << 8 | after
    return ((value * np.uint32(2654435761)) >> np.uint32(15)).astype(np.int64)


def times(rows: np.ndarray, move: np.ndarray) -> np.ndarray:
    """``rows @ move`` with the same sums whatever the number of rows: a text's
    result doesn't depend on its neighbours in a batch, not even in the last bit."""
    out = rows[:, :1] * move[0]
    for i in range(1, len(move)):
        out += rows[:, i:i + 1] * move[i]
    return out


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # TABLE x languages
    moves: np.ndarray  # languages x languages

    def scores(self, raw, offsets, starts, ends) -> np.ndarray:
        """(words x languages) sums of feature weights."""
        places = word_features(raw, starts, ends)
        out = self.weights[places[:, 0]]
        for j in range(1, places.shape[1]):
            out += self.weights[places[:, j]]
        per = self.weights[trigrams(raw, offsets)]
        cuts = np.stack([starts, np.minimum(ends, len(raw))], 1).ravel()
        sums = np.add.reduceat(np.vstack([per, np.zeros((1, per.shape[1]), per.dtype)]), cuts, axis=0)[::2]
        return out + sums

    def marginals(self, score: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Forward-backward over chains that start at word ``first``."""
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        near = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64)
        move = np.exp(self.moves - self.moves.max())
        ahead = near.copy()
        ahead[first] /= ahead[first].sum(axis=1, keepdims=True)
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right") if len(size) else []
        for t in range(1, len(live)):
            at = first[:live[t]] + t
            a = times(ahead[at - 1], move) * near[at]
            ahead[at] = a / a.sum(axis=1, keepdims=True)
        back = np.ones_like(near)
        for t in range(len(live) - 1, 0, -1):
            at = first[:live[t]] + t
            b = times(near[at] * back[at], move.T)
            back[at - 1] = b / b.sum(axis=1, keepdims=True)
        out = ahead * back
        return out / out.sum(axis=1, keepdims=True)


def chains(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of each chain: lines, cut after CHAIN words."""
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z
    lines = np.cumsum(raw == 10)[starts]
    new = np.concatenate([[True], lines[1:] != lines[:-1]])
    heads = np.cumsum(counts)[:-1]
    new[heads[heads < len(starts)]] = True
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    pieces = -(-size // CHAIN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(first, pieces) + nth * CHAIN, np.minimum(CHAIN, np.repeat(size, pieces) - nth * CHAIN)


def train(texts: list[str], langs: list[str], steps: int = 250, batch: int = 64, length: int = 36, seed: int = 5) -> Crf:
    """Maximise the chains' likelihood by Adagrad."""
    known = sorted(set(langs))
    k = len(known)
    model = Crf(known, np.zeros((TABLE, k), np.float32), np.zeros((k, k)))
    if k < 2:
        return model
    rng = np.random.default_rng(seed)
    y = np.array([known.index(v) for v in langs])
    encoded = [_LOWER[np.frombuffer(t.encode(), np.uint8)] for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])])
    raw = np.concatenate(encoded) if encoded else np.zeros(0, np.uint8)
    starts, ends, counts = words(raw, offsets)
    affix, grams = word_features(raw, starts, ends), trigrams(raw, offsets)
    heads = np.concatenate([[0], np.cumsum(counts)])
    some = np.flatnonzero(counts > 0)
    seen_w, seen_m = np.full((TABLE, k), 1e-6, np.float32), np.full((k, k), 1e-6)
    by_lang = [some[y[some] == c] for c in range(k)]
    by_lang = [d for d in by_lang if len(d)]
    for _ in range(steps):
        at, gold, size = [], [], []
        for _ in range(batch):
            n = 0
            for _ in range(int(rng.integers(1, 4))):
                d = int(rng.choice(by_lang[int(rng.integers(len(by_lang)))]))
                take = int(rng.integers(2, length // 2))
                lo = int(rng.integers(heads[d], max(heads[d] + 1, heads[d + 1] - take)))
                piece = np.arange(lo, min(lo + take, heads[d + 1]))
                at.append(piece), gold.append(np.full(len(piece), y[d]))
                n += len(piece)
            size.append(n)
        at, gold, size = np.concatenate(at), np.concatenate(gold), np.array(size)
        width = ends[at] - starts[at]
        row = np.repeat(np.arange(len(at)), width)
        gram = grams[np.repeat(starts[at] - (np.cumsum(width) - width), width) + np.arange(width.sum())]
        score = model.weights[affix[at]].sum(axis=1)
        score += np.stack([np.bincount(row, model.weights[gram, c], len(at)) for c in range(k)], 1).astype(np.float32)
        first = np.cumsum(size) - size
        p = model.marginals(score, first, size)
        gap = p.copy()
        gap[np.arange(len(at)), gold] -= 1
        gap /= len(at)
        grad = np.zeros_like(model.weights)
        for c in range(k):
            grad[:, c] = np.bincount(affix[at].ravel(), np.repeat(gap[:, c], affix.shape[1]), TABLE) \
                + np.bincount(gram, gap[row, c], TABLE)
        # neighbours' joint marginals: p(i) * move * near(j) * back(j), from the chain's own recursions
        inner = np.ones(len(at), bool)
        inner[first] = False
        j = np.flatnonzero(inner)
        move = np.exp(model.moves - model.moves.max())
        near = np.exp(score - score.max(axis=1, keepdims=True))
        ahead, back = _sweeps(near, move, first, size)
        joint = ahead[j - 1][:, :, None] * move * (near[j] * back[j])[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        move_grad = joint.sum(axis=0)
        np.subtract.at(move_grad, (gold[j - 1], gold[j]), 1)
        move_grad /= len(at)
        seen_w += grad * grad
        seen_m += move_grad * move_grad
        model.weights -= 0.25 * grad / np.sqrt(seen_w)
        model.moves -= 0.1 * move_grad / np.sqrt(seen_m)
    return model


def _sweeps(near: np.ndarray, move: np.ndarray, first: np.ndarray, size: np.ndarray):
    """Scaled forward and backward vectors of chains (training's few words)."""
    ahead, back = near.astype(np.float64), np.ones(near.shape)
    for t in range(1, int(size.max())):
        at = (first + t)[size > t]
        a = (ahead[at - 1] @ move) * near[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(int(size.max()) - 1, 0, -1):
        at = (first + t)[size > t]
        b = (near[at] * back[at]) @ move.T
        back[at - 1] = b / b.sum(axis=1, keepdims=True)
    return ahead, back


def word_marginals(model: Crf, raw: np.ndarray, offsets: np.ndarray, step: int = 1 << 20):
    """(first row, last row, words of each row, words x languages) in pieces."""
    for lo, hi in by_bytes(offsets, step):
        part = _LOWER[raw[offsets[lo]:offsets[hi]]]
        own = offsets[lo:hi + 1] - offsets[lo]
        starts, ends, counts = words(part, own)
        p = np.zeros((0, len(model.langs)))
        if len(starts):
            p = model.marginals(model.scores(part, own, starts, ends), *chains(part, starts, counts))
        yield lo, hi, counts, p


def learnable(col: str = "doc_id") -> Column:
    return crc_of(col) % 3 != 1


def fit(docs: DataFrame, learn: Column, per_lang: int = 250, train_bytes: int = 1 << 13) -> Crf:
    """Train on the ``per_lang`` smallest hashes of each language. Of a text
    above ``train_bytes`` bytes a piece is learned, from a place that its id's
    hash names, so a language of long texts only has its class too."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    hashed = F.xxhash64("doc_id")
    rows = written(usable.select("doc_id", "lang", hashed.alias("__h")).distinct(), "langid-rows")
    # a bounded top list for each language: row_number() with a limit is cut in the map tasks
    by_hash = Window.partitionBy("lang").orderBy("__h", F.col("doc_id").asc_nulls_last())
    ids = rows.withColumn("__r", F.row_number().over(by_hash)).where(F.col("__r") <= per_lang).select("doc_id", "lang")
    size = train_bytes // 4  # code points of at most four bytes
    place = F.pmod(hashed, F.greatest(F.length("text") - size, F.lit(1))).cast("int")
    piece = F.when(F.octet_length("text") <= train_bytes, F.col("text")).otherwise(F.substring("text", place + 1, F.lit(size)))
    found = (usable.select("doc_id", "lang", piece.alias("text"))
             .join(F.broadcast(ids), ["doc_id", "lang"])  # per_lang ids a language
             .groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").collect())
    return train([r["text"] for r in found], [r["lang"] for r in found])


def _doc_result(model: Crf, text: pa.Array) -> pa.Array:
    raw, offsets = utf8(text)
    pred, score = [], []
    for lo, hi, counts, p in word_marginals(model, raw, offsets):
        first = np.cumsum(counts) - counts
        for i, n in enumerate(counts.tolist()):
            if n == 0 or not model.langs:
                pred.append("und"), score.append(0.0)
                continue
            mean = p[first[i]:first[i] + n].mean(axis=0)
            best = int(mean.argmax())
            pred.append(model.langs[best]), score.append(min(1.0, float(mean[best])))
    return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                      ["lang_pred", "score"])


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, learnable()))

    @F.arrow_udf("lang_pred string, score double")
    def predict(text: pa.Array) -> pa.Array:
        return _doc_result(shared.value, text)

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    got = docs.select("doc_id", (~learnable()).alias("held_out"), has_letter.alias("__l"),
                      predict(F.coalesce("text", F.lit(""))).alias("__p"))
    return got.select("doc_id", "held_out",
                      F.when(F.col("__l"), F.col("__p.lang_pred")).otherwise("und").alias("lang_pred"),
                      F.when(F.col("__l"), F.col("__p.score")).otherwise(0.0).alias("score"))


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, word_langs): the most probable language of each word."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<string>")
    def label(text: pa.Array) -> pa.Array:
        m, out = shared.value, []
        raw, offsets = utf8(text)
        for _, _, counts, p in word_marginals(m, raw, offsets):
            best = [m.langs[i] for i in p.argmax(axis=1).tolist()] if m.langs else []
            ends = np.cumsum(counts).tolist()
            out += [best[e - n:e] for e, n in zip(ends, counts.tolist())]
        return pa.array(out, pa.list_(pa.string()))

    return docs.select("doc_id", label(F.coalesce("text", F.lit(""))).alias("word_langs"))
