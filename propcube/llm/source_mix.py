"""Mixing sources to target weights with hash-threshold histograms.

A document's size is its number of words. Sources in code-point order (null
last) weigh 1, 2, 3, 1, 2, 3, ... and share the total size by weight; no
target exceeds MAX_REPEAT times its source's size, and what is over is shared
by the others by weight. A source takes each document floor(target / size)
times, and once more those whose hash lies below the source's threshold.

The threshold is found without sorting documents: sizes are summed by source
and the hash's leading digits; the digit range in which the budget runs out is
the boundary bucket, and only its documents are summed again by the next
digits, until the digits are used up. Every sum is combined in the map tasks,
so a source with a third of all rows is as cheap as the others; the tables
that meet in one task have one row per source, or per source and digit.

Defined results: null or blank text has size 0 and is taken 0 words; a null id
hashes as the empty text; repeated rows of an id share its hash and are taken
alike; sources without words get target 0; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propcube.llm.common import SPACE, written

MAX_REPEAT = 3.0
LEVELS, DIGITS = 5, 3  # the hash has LEVELS groups of DIGITS hex digits


def hash_hex(col: str) -> Column:
    """The document's place in [0, 16^(LEVELS * DIGITS)), as hex digits."""
    return F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit(""))), 1, LEVELS * DIGITS)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long").alias("size"),
        hash_hex(id_col).alias("__hash"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target, base): one row per source.

    With sources in ascending order of cap / weight, the level up to which
    all sources are filled evenly is the first that leaves the rest uncapped.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    k = len(weights)
    nth = (F.row_number().over(order) - 1) % k
    per = per.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int")))
    cap = MAX_REPEAT * F.col("source_size")
    fill = Window.orderBy(cap / F.col("__w"), "__w", F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    per = per.withColumn("__level", left / F.sum("__w").over(onward))
    fits = F.when(F.col("__level") <= cap / F.col("__w"), F.col("__level"))
    per = per.withColumn("__level", F.max(fits).over(whole))  # it falls from the first that fits on
    target = F.least(cap, F.coalesce(F.col("__level") * F.col("__w"), cap))
    return per.select("source", "source_size", target.cast("double").alias("target"),
                      F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size")))
                      .otherwise(0).cast("long").alias("base"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, __cut, __in): documents whose hash is below ``__cut`` are
    taken once more; those at the cut too where ``__in`` (that is nearer)."""
    state = written(wanted.select("source", (F.col("target") - F.col("base") * F.col("source_size")).alias("__left"),
                                  F.lit("").alias("__path"), F.lit(0).cast("long").alias("__sum")), "mix-edge")
    for level in range(LEVELS):
        lo = level * DIGITS
        at = state.select(F.col("source").alias("__s"), "__left", "__path")
        inside = sized if level == 0 else sized.join(
            at.select("__s", "__path"), F.col("source").eqNullSafe(F.col("__s"))
            & (F.substring("__hash", 1, lo) == F.col("__path")))
        sums = inside.groupBy("source", F.substring("__hash", lo + 1, DIGITS).alias("__digits")).agg(
            F.sum("size").alias("__sum"))
        run = Window.partitionBy("source").orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(run), F.lit(0)))
        # the bucket in which the budget runs out: the last that starts within it
        edge = (sums.join(at, F.col("source").eqNullSafe(F.col("__s")))
                .where(F.col("__before") <= F.col("__left"))
                .groupBy("source").agg(F.max_by(F.struct("__digits", "__before", "__sum", "__left", "__path"),
                                                "__digits").alias("e")))
        state = written(edge.select(
            "source", (F.col("e.__left") - F.col("e.__before")).alias("__left"),
            F.concat("e.__path", "e.__digits").alias("__path"), F.col("e.__sum").alias("__sum")), "mix-edge")
    nearer = (2 * F.col("__left") >= F.col("__sum")) & (F.col("__left") > 0)
    return state.select(F.col("source").alias("__s"), F.col("__path").alias("__cut"), nearer.alias("__in"))


def mix_plan(sized: DataFrame) -> DataFrame:
    """(__s, source_size, target, base, __cut, __in): one row per source."""
    wanted = written(targets(sized), "mix-targets")
    plan = wanted.join(thresholds(sized, wanted), F.col("source").eqNullSafe(F.col("__s")), "left").select(
        F.col("source").alias("__s"), "source_size", "target", "base", "__cut", "__in")
    return written(plan, "mix-plan")


def times() -> Column:
    """How often a row with its source's plan beside it is taken."""
    below = (F.col("__hash") < F.col("__cut")) | (F.col("__in") & (F.col("__hash") == F.col("__cut")))
    more = F.coalesce(below, F.lit(False)).cast("long")
    return F.least(F.col("base") + more, F.lit(int(MAX_REPEAT))).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row."""
    sized = written(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    plan = mix_plan(sized)  # read by its size: sent to all tasks while small, else joined by a shuffle
    return sized.join(plan, F.col("source").eqNullSafe(F.col("__s"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each time taken; a
    row's source and hash decide, so texts are not shuffled."""
    plan = mix_plan(written(sizes(docs, id_col, text_col, source_col), "mix-sizes"))
    rows = docs.withColumn("__hash", hash_hex(id_col)).join(plan, F.col(source_col).eqNullSafe(F.col("__s")))
    rows = rows.withColumn("__times", times()).where(
        (F.col("__times") > 0) & F.coalesce(F.col(text_col), F.lit("")).rlike(f"[^{SPACE}]"))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(
        *[docs[c] for c in docs.columns])
