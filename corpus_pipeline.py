"""A corpus pipeline over ``documents``: language ID, near-duplicate join, suffix dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and reads it again as the next stage's input. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import language
from catalens.llm.common import among
from catalens.llm.jaccard_join import jaccard_components
from catalens.llm.packing import pack_documents
from catalens.llm.queries import CAPACITY, WORD_BPE, held_out, table
from catalens.llm.suffix_dedup import suffix_dedup
from catalens.plans.materialize import materialize


#: Rows in one Arrow batch. A row here is a whole document, and a batch lies in an executor's memory outside its heap
#: several times over (rows on their way to Python, and results on their way back, for every task of the executor).
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS``; a smaller setting stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(setting))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was learnt; rejected are texts without a letter and ambiguous ones."""
    small_batches(spark)
    return language.in_known_language(docs, language.fit(docs.where(~held_out())))


def unused(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates (5 words, J >= 0.8): the one with the smallest id, nulls last.

    Rows are told apart by numbers of their own, so repeated and null ids do not keep more. The numbers are fixed by
    writing the documents once.
    """
    small_batches(spark)
    number = unused("row", docs)
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    groups = jaccard_components(rows, words=5, percent=80, key=number).select(F.col(number).alias("row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")
    ids = rows.select(F.col(number).alias("row"), "doc_id")
    kept = groups.join(ids, "row").groupBy("component_id").agg(least).select(F.col("least.row").alias(number))
    return among(rows, F.col(number), F.col(number), kept).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings of 50 and more that an earlier document has; ``n_chars`` follows the text.

    Bytes of a character that was cut in two go with it. A document of which nothing is left goes.
    """
    small_batches(spark)
    others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    found = suffix_dedup(docs.withColumnsRenamed(others), length=50, carry=list(others.values()))
    left = found.where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return left.select(*((new[c] if c in new else F.col(others[c])).alias(c) for c in docs.columns))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of at most 4096 tokens."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path(WORD_BPE), CAPACITY)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", distinct_documents),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed_sequences),
]

#: No stage but the filters can be put in SQL, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "corpus")
    return STAGES[-1][1](spark, docs, sf_dir)
