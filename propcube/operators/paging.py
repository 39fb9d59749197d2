"""SRT1-SRT3 for deep pages: find the page's range by counting, sort only that.

A page far down an order need not bring all rows before it anywhere. Rows are
counted by ranges of the first sort key (bins of a number or date, prefixes of a
text); the counts tell which ranges the page falls into and how many rows lie
before them. The range is counted again in finer ranges, and by the next key
where one value is left, until it holds few rows; those alone are sorted. Each
round is one narrow aggregation with the range pushed to the scan; at most
``BINS`` counts (prefixes: one for each next character) come back.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
#: Rows of a range that are sorted at once.
FEW = 50_000
#: Offsets from which pages are found by counting.
DEEP = 10_000


@dataclass(frozen=True)
class SortKey:
    """A column of a page's order; nulls come last either way."""
    name: str
    descending: bool = False

    def order(self) -> Column:
        c = F.col(self.name)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


def _number(df: DataFrame, name: str) -> Column:
    """A whole number that sorts as the column does."""
    kind = df.schema[name].dataType.typeName()
    return F.unix_date(name).cast("bigint") if kind == "date" else F.col(name).cast("bigint")


@dataclass(frozen=True)
class Range:
    """Consecutive values of a sort key: the rows in it, whether it is one
    value, and what bounds the next, finer ranges."""
    inside: Column
    rows: int
    single: bool
    within: object = None


def _number_ranges(df: DataFrame, key: SortKey, within: tuple[int, int] | None) -> list[Range]:
    value = _number(df, key.name)
    if within is None:
        ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        within = (ends["lo"], ends["hi"]) if ends["lo"] is not None else (0, 0)
    lo, hi = within
    width = -(-(hi - lo + 1) // BINS)
    counts = df.groupBy(F.call_function("div", value - F.lit(lo), F.lit(width)).alias("b")).count().collect()
    out = []
    for b, n in sorted(((r["b"], r["count"]) for r in counts if r["b"] is not None), reverse=key.descending):
        ends = (lo + b * width, min(hi, lo + (b + 1) * width - 1))
        out.append(Range(value.between(*ends), n, ends[0] == ends[1], ends))
    return out + [Range(F.col(key.name).isNull(), r["count"], True) for r in counts if r["b"] is None]


def _prefix_ranges(df: DataFrame, key: SortKey, within: str | None) -> list[Range]:
    c, n = F.col(key.name), len(within or "") + 1
    head = F.substring(c, 1, n)
    counts = df.groupBy(head.alias("b")).count().collect()
    # UTF-8 sorts by code point, as Python does
    out = [Range(head == b, m, len(b) < n, b)
           for b, m in sorted(((r["b"], r["count"]) for r in counts if r["b"] is not None), reverse=key.descending)]
    return out + [Range(c.isNull(), r["count"], True) for r in counts if r["b"] is None]


def pieces(df: DataFrame, keys: list[SortKey], offset: int, size: int, few: int = FEW, within=None) -> list[tuple[DataFrame, int, int]]:
    """[(rows, offset, size)] whose pages, one after another, are the page of
    ``df``. Usually one; more where the page reaches over the border of two
    values that both have many rows."""
    if not keys or size <= 0:
        return [(df, offset, size)] if size > 0 else []
    text = df.schema[keys[0].name].dataType.typeName() == "string"
    before, hit = 0, []
    for r in (_prefix_ranges if text else _number_ranges)(df, keys[0], within):
        if before + r.rows > offset and before < offset + size:
            hit.append((before, r))
        before += r.rows
    if not hit:
        return []
    if sum(r.rows for _, r in hit) <= few:
        return [(df.where(reduce(lambda a, b: a | b, [r.inside for _, r in hit])), offset - hit[0][0], size)]
    out = []
    for start, r in hit:
        lo, hi = max(offset, start), min(offset + size, start + r.rows)
        out += pieces(df.where(r.inside), keys[1:] if r.single else keys, lo - start, hi - lo, few, None if r.single else r.within)
    return out


def page(df: DataFrame, keys: list[SortKey], offset: int, size: int, deep: int = DEEP, few: int = FEW) -> DataFrame:
    """Rows ``offset`` .. ``offset + size - 1`` of ``df`` in the order of
    ``keys``, whose last column is unique."""
    order = [k.order() for k in keys]
    parts = pieces(df, keys, offset, size, few) if offset >= deep else [(df, offset, size)]
    cuts = [part.orderBy(*order).offset(at).limit(n) for part, at, n in parts]
    return reduce(DataFrame.unionAll, cuts).orderBy(*order) if cuts else df.limit(0)
