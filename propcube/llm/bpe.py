"""BPE encoding and decoding with a contiguous rank array per word.

Reads a tokenizer description (JSON of a BPE model with word ends) and encodes
as that tokenizer does without special tokens: special strings in the raw text
first, then composed and lower-cased text, split by the file's pattern, each
word's UTF-8 bytes written as the byte-level alphabet with the word-end suffix
on its last symbol, then merged by rank.

A word is held as boundaries between parts and, beside them, the merge rank of
each adjacent pair; the least rank is found by scanning, its boundary deleted
and the two neighbouring ranks refreshed, until no pair can merge. Results are
remembered by white-space-separated chunk and by word, in at most ``CACHE``
bytes each. The scan is for short words; above ``SHORT`` bytes the least rank,
leftmost first, comes from a heap instead, with the same ids in time that
grows little faster than the word.

Defined results: null text is empty; empty text has no tokens, the digest of
no bytes, and decodes to the empty text. Rows keep their multiplicity.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propcube.llm.common import ship

CACHE = 64 << 20
SHORT = 256
NO_RANK = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1
    characters stand for themselves, the others for 256, 257, ... in order."""
    printable = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Remembered:
    """Results by text in two generations of about CACHE / 2 bytes: a full one
    becomes the old one, whose texts come back when they are asked for, so the
    frequent ones stay."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def find(self, text: str) -> bytes | None:
        got = self.young.get(text)
        if got is None:
            got = self.old.get(text)
            if got is not None:
                self.keep(text, got)
        return got

    def keep(self, text: str, ids: bytes) -> None:
        size = 160 + 2 * len(text) + len(ids)  # two objects and a place in the table
        if self.held + size > CACHE // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.held += size
        self.young[text] = ids


class WordBpe:
    """The tokenizer of a description file's text."""

    def __init__(self, description: str):
        spec = json.loads(description)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: rank of a pair of ids, the key being first * 2^20 + second, and the id that each rank makes
        self.ranks = {(self.vocab[a] << 20) + self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        (split,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        # the same white space as the file's regular expressions have
        self.space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        self.words = regex.compile(split.replace("\\s", self.space))
        self.gap = regex.compile(f"[{self.space}]+")
        self.not_gap = regex.compile("[\\x1c-\\x1f]")
        self.is_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.final = [self.vocab[c + self.suffix] for c in alphabet]
        self.by_id = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.cache, self.known = Remembered(), Remembered()

    def word(self, text: str) -> list[int]:
        """Ids of one word."""
        raw = text.encode()
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        if len(parts) > SHORT:
            return self.long_word(parts)
        rank = self.ranks.get
        ranks = [rank((a << 20) + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            part = parts[i] = self.made[least]
            del parts[i + 1], ranks[i]  # the boundary between the two
            if i < len(ranks):
                ranks[i] = rank((part << 20) + parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank((parts[i - 1] << 20) + part, NO_RANK)
        return parts

    def long_word(self, parts: list[int]) -> list[int]:
        """Ids of a long word: links between the parts left, and a heap of
        (rank, place) whose outdated entries are passed over."""
        n, rank = len(parts), self.ranks.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        now = [rank((a << 20) + b, NO_RANK) for a, b in zip(parts, parts[1:])] + [NO_RANK]
        heap = [(r, i) for i, r in enumerate(now) if r != NO_RANK]
        heapq.heapify(heap)

        def refresh(i: int) -> None:
            j = right[i]
            now[i] = rank((parts[i] << 20) + parts[j], NO_RANK) if j < n else NO_RANK
            if now[i] != NO_RANK:
                heapq.heappush(heap, (now[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:
                continue
            gone = right[i]
            parts[i], now[gone] = self.made[r], -1
            right[i] = right[gone]
            if right[i] < n:
                left[right[i]] = i
            refresh(i)
            if left[i] >= 0:
                refresh(left[i])
        out, i = [], 0
        while i < n:
            out.append(parts[i])
            i = right[i]
        return out

    def plain(self, text: str) -> list[int]:
        """Ids of text without special strings."""
        lowered = "".join(c if c == "ς" else c.lower() for c in unicodedata.normalize("NFC", text)) \
            if "Σ" in text else unicodedata.normalize("NFC", text).lower()
        ids: list[int] = []
        for w in self.words.findall(lowered):
            kept = self.known.find(w)
            if kept is None:
                got = self.word(w)
                if len(w) <= 200:
                    self.known.keep(w, array("I", got).tobytes())
                ids += got
            else:
                ids += memoryview(kept).cast("I")
        return ids

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk without white space, as little-endian 32-bit integers."""
        got = self.cache.find(text)
        if got is not None:
            return got
        ids, at = [], 0
        for m in self.is_special.finditer(text):
            ids += self.plain(text[at:m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        ids += self.plain(text[at:] if at else text)
        made = array("I", ids).tobytes()
        if len(text) <= 200:
            self.cache.keep(text, made)
        return made

    def encode(self, text: str) -> bytes:
        known, chunk = self.cache.young.get, self.chunk
        # str.split() also splits at four control characters that the patterns keep
        chunks = self.gap.split(text) if self.not_gap.search(text) else text.split()
        # a full generation changes place meanwhile: what is found in it is right all the same
        return b"".join([known(c) or chunk(c) for c in chunks if c])

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space: the file names no decoder."""
        return " ".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, WordBpe] = {}


def _loaded(name: str) -> WordBpe:
    if name not in _LOADED:
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            _LOADED[name] = WordBpe(f.read())
    return _LOADED[name]


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoder(spark, path: str):
    """Column function: text -> (n_tokens, ids_sha256, decoded_sha256). The
    description file goes to the executors with the job's files."""
    ship(spark)
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    @F.arrow_udf(RESULT)
    def encode(text: pa.Array) -> pa.Array:
        bpe = _loaded(name)
        rows = []
        for t in text:
            ids = bpe.encode(t.as_py() or "")
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                         hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.StructArray.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
            ["n_tokens", "ids_sha256", "decoded_sha256"])

    return encode


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``."""
    encode = encoder(docs.sparkSession, path)
    return docs.select("doc_id", encode(F.coalesce("text", F.lit(""))).alias("__e")).select("doc_id", "__e.*")


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids themselves."""
    spark = docs.sparkSession
    ship(spark)
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        bpe = _loaded(name)
        return pa.array([np.frombuffer(bpe.encode(t.as_py() or ""), "<i4") for t in text], pa.list_(pa.int32()))

    return docs.select("doc_id", ids(F.coalesce("text", F.lit(""))).alias("ids"))
