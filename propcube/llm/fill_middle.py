"""Fill-in-the-middle transformation of whole texts.

A text is indexed by two Fenwick trees over blocks of ``BLOCK`` bytes of its
UTF-8 form: units that end in a block and code points that begin in it. The
block of a cut after k units is found by binary lifting over the unit tree,
which sums the code points before it on the way; the boundary itself is then
located inside that one block. Each row is cut on its own, without a shuffle.

``unit`` is ``line`` (``[^\\n]*\\n|[^\\n]+``) or ``char`` (a code point). The four
draws of a row are the first 8-digit groups of the SHA-256 of ``seed:id`` and
depend on nothing else, so a rerun cuts alike whatever the layout.

Defined results: null text is empty; an empty text, one that holds a mark, and
one that the rate leaves out are ``plain`` (null character counts, the text
itself as output). A null id counts as the empty text after ``seed:``. Repeated
rows are cut alike and stay separate; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propcube.llm.common import by_bytes, ship, utf8

BLOCK = 4096
PIECE = 4 << 20  # bytes of text whose outputs are held at a time
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _unit_ends(raw: np.ndarray, lo: int, hi: int, unit: str) -> np.ndarray:
    """Which of bytes lo..hi-1 end a unit; the text's last byte always does."""
    if unit == "line":
        ends = raw[lo:hi] == 10
    else:
        ends = np.ones(hi - lo, bool)
        follow = raw[lo + 1:hi + 1]
        ends[:len(follow)] = (follow & 0xC0) != 0x80
    if hi == len(raw) and hi > lo:
        ends[-1] = True
    return ends


def _begun(raw: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Which of bytes lo..hi-1 begin a code point."""
    return (raw[lo:hi] & 0xC0) != 0x80


class TextIndex:
    """Fenwick trees of unit ends and code points over a text's blocks."""

    def __init__(self, raw: np.ndarray, unit: str = "line", block: int = BLOCK):
        self.raw, self.unit, self.block = raw, unit, block
        n = len(raw)
        starts = np.arange(0, n, block)
        self.blocks = len(starts)
        sums = np.zeros((self.blocks + 1, 2), np.int64)
        if n:
            sums[1:, 0] = np.add.reduceat(_unit_ends(raw, 0, n, unit), starts, dtype=np.int64)
            sums[1:, 1] = np.add.reduceat(_begun(raw, 0, n), starts, dtype=np.int64)
        np.cumsum(sums, axis=0, out=sums)
        self.units, self.points = int(sums[-1, 0]), int(sums[-1, 1])
        node = np.arange(1, self.blocks + 1)
        self.tree = np.zeros_like(sums)  # node i sums blocks i - lowbit(i) + 1 .. i
        self.tree[1:] = sums[1:] - sums[node - (node & -node)]
        self.top = 1 << max(0, self.blocks.bit_length() - 1)

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, code point) right after the k-th unit, 0 <= k <= units."""
        if k <= 0:
            return 0, 0
        at, step, left, points = 0, self.top, k, 0
        while step:
            to = at + step
            if to <= self.blocks and self.tree[to, 0] < left:
                at, left, points = to, left - int(self.tree[to, 0]), points + int(self.tree[to, 1])
            step >>= 1
        lo, hi = at * self.block, min((at + 1) * self.block, len(self.raw))
        end = lo + int(np.flatnonzero(_unit_ends(self.raw, lo, hi, self.unit))[left - 1]) + 1
        return end, points + int(np.count_nonzero(_begun(self.raw, lo, end)))


def transform(raw: np.ndarray, draws: tuple[int, int, int, int], unit: str, rate: int,
              spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix and middle code points, output) of one text."""
    index, text = TextIndex(raw, unit), raw.tobytes()
    if not text or draws[2] % 100 >= rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return index.units, "plain", None, None, text
    one, two = (h % (index.units + 1) for h in draws[:2])
    (a, before), (b, upto) = index.cut(min(one, two)), index.cut(max(one, two))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return index.units, "spm", before, upto - before, b"".join((s, suffix, p, prefix, m, middle))
    return index.units, "psm", before, upto - before, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, unit: str = "line",
                   rate: int = 100, spm: int = 50) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row: ``rate``
    per cent of the rows are cut, ``spm`` per cent of those suffix first."""
    if unit not in ("line", "char"):
        raise ValueError(f"unknown unit {unit!r}")
    ship(docs.sparkSession)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(key, 256).alias("key"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8(b.column("text"))
            keys = b.column("key").to_pylist()
            for lo, hi in by_bytes(offsets, PIECE):
                made = [transform(raw[offsets[i]:offsets[i + 1]],
                                  tuple(int(keys[i][j:j + 8], 16) for j in range(0, 32, 8)), unit, rate, spm)
                        for i in range(lo, hi)]
                n, form, prefix, middle, output = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                     pa.array(output, pa.binary()).cast(pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType)]
                          + T._parse_datatype_string("n long, form string, prefix_chars long, middle_chars long, "
                                                     "output string").fields)
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of. Cut texts hold no
    mark, and no mark can arise where a mark meets a text, so an output splits
    at its three marks only."""
    part = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of outputs and of the texts rebuilt from them."""
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
