"""SRC1: header CSV files with line breaks inside quoted fields, read by many
tasks each.

Spark splits a file at physical lines; whether a line starts a record depends
on the quotes before it. Within quoted CSV a line starts a record exactly if
the number of quotes before it in the file is even (a doubled quote counts
two). So:

1. every line gets its number and the parity of the quotes before it *in its
   split*, and for either parity at the split's start the line on which its
   record would begin;
2. one row for each split carries lines, parity and last record start; prefix
   sums over a file's splits give each split's first line, its parity and
   the record that runs into it;
3. joined back, that settles each line. A line that is a record is done;
   only the lines of records that span several are grouped, by file and first
   line.

The fields come from ``from_csv``. A record with more fields than the header,
one whose quotes never close, and the lines of one that is longer than
``RECORD_LINES`` lines go to the rejects; missing fields are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD_LINES = 10_000
_LINE = "value string, file string, block long, line long, odd boolean, start0 long, start1 long"
_KEY = ["file", "block"]
_CSV = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a task, in order, with what step 1 needs. A task reads its
    splits one after another."""
    now, line, parity, starts = None, 0, 0, [-1, -1]
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        odd = pc.bit_wise_and(pc.count_substring(batch.column("value"), '"'), 1).to_numpy(zero_copy_only=False).astype(np.int64)
        change = [i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]]
        for lo, hi in zip([0, *change], [*change, len(files)]):
            if lo == hi:
                continue
            if (files[lo], blocks[lo]) != now:
                now, line, parity, starts = (files[lo], blocks[lo]), 0, 0, [-1, -1]
            at = line + np.arange(hi - lo)
            before = (parity + np.cumsum(odd[lo:hi]) - odd[lo:hi]) % 2
            begun = []
            for p in (0, 1):  # the latest line that starts a record, were p the parity before the split
                latest = np.maximum.accumulate(np.where((before + p) % 2 == 0, at, -1))
                begun.append(np.maximum(latest, starts[p]))
                starts[p] = int(begun[p][-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(lo, hi - lo) for c in ("value", "file", "block")]
                + [pa.array(at), pa.array(odd[lo:hi] == 1), pa.array(begun[0]), pa.array(begun[1])],
                [f.split()[0] for f in _LINE.split(", ")])
            line, parity = line + hi - lo, int(before[-1] + odd[hi - 1]) % 2


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, record, bad) of every record of the file or folder ``path``;
    ``line`` is the record's first line in its file, from 0; ``bad`` a reason."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    splits = lines.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    marked = lines.mapInArrow(_numbered, _LINE)
    ends = marked.groupBy(*_KEY).agg(F.max("start0").alias("last0"), F.max("start1").alias("last1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each split of a file
    splits = (splits.join(ends, _KEY)
              .withColumn("first", F.coalesce(F.sum("lines").over(before), F.lit(0)))
              .withColumn("p", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
              .withColumn("own", F.when(F.col("p") == 0, F.col("last0")).otherwise(F.col("last1")))
              .withColumn("running", F.coalesce(F.max(F.when(F.col("own") >= 0, F.col("first") + F.col("own"))).over(before), F.lit(0)))
              .withColumn("unclosed", F.sum("quotes").over(Window.partitionBy("file")) % 2 == 1)
              .withColumn("final", F.max(F.when(F.col("own") >= 0, F.col("first") + F.col("own"))).over(Window.partitionBy("file")))
              .select(*_KEY, "first", "p", "running", "unclosed", "final"))
    own = F.when(F.col("p") == 0, F.col("start0")).otherwise(F.col("start1"))
    start = F.when(own >= 0, F.col("first") + own).otherwise(F.col("running"))
    settled = marked.join(splits, _KEY).select(
        "file", (F.col("first") + F.col("line")).alias("line"), "value", "odd",
        start.alias("start"), (F.col("unclosed") & (start == F.col("final"))).alias("open"))
    whole = (F.col("start") == F.col("line")) & ~F.col("odd")
    bad = F.when(F.col("open"), F.lit("unclosed quote")).when(F.col("line") - F.col("start") >= RECORD_LINES, F.lit("record too long"))
    single = settled.where(whole | bad.isNotNull()).select("file", "line", F.col("value").alias("record"), bad.alias("bad"))
    several = (settled.where(~whole & bad.isNull()).groupBy("file", "start")
               .agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l"))
               .select("file", F.col("start").alias("line"),
                       F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("record"), F.lit(None).cast("string").alias("bad")))
    return single.unionByName(several).withColumn("record", F.regexp_replace("record", r"\r$", ""))


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of header CSV files: rows have the header's columns as
    text, ``file`` and ``line``; rejects (file, line, record, reason)."""
    columns = spark.read.options(**_CSV).option("header", True).csv(path).columns
    fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*columns, "__extra"])
    rows = records(spark, path).where("line > 0 AND record <> ''")  # line 0 is the header
    parsed = rows.select(F.col("file").alias("__file"), F.col("line").alias("__line"), "record", "bad",
                         F.inline(F.array(F.from_csv("record", fields, _CSV))))
    bad = F.coalesce("bad", F.when(F.col("__extra").isNotNull(), F.lit("too many fields")))
    good = parsed.where(bad.isNull()).select(*[F.col(f"`{c}`") for c in columns], F.col("__file").alias("file"), F.col("__line").alias("line"))
    return good, parsed.where(bad.isNotNull()).select(F.col("__file").alias("file"), F.col("__line").alias("line"), "record", bad.alias("reason"))

