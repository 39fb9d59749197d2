"""From raw documents to token counts: five operators in a row.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

1. quality: documents that the byte-level classifier rejects go;
2. exact: of equal texts one row stays;
3. near: of each group linked by five-word shingles (Jaccard 0.8) one stays;
4. mix: sources are brought to their target weights (a document may be taken
   up to three times, once per row);
5. tokens: per row the token count and digests of its ids and decoded text.

No stage has an oracle in SQL: the classifier is trained, so ``ORACLE_SQL`` is
None and tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propcube.llm import bpe, exact_dedup, jaccard_join, quality_cnn, source_mix
from propcube.llm.common import read, written
from propcube.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    score = quality_cnn.scorer(spark, quality_cnn.fit(docs, labels, quality_cnn.learnable()))
    return docs.where(score(F.coalesce("text", F.lit(""))) >= quality_cnn.THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
