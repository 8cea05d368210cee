"""A training-corpus pipeline: language identification, near-duplicates, decontamination, packing.

``run(spark, sf_dir)`` applies the stages to ``documents`` in order.  Each stage takes everything
its predecessor kept; all but the last return the columns of ``documents``.

Defined results: a null or letterless text is rejected with its language; repeated rows are near-duplicates of each
other, of which one stays; of a class the document with the smallest id stays; a document without benchmark words
stays; an empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acclaim.llm import decontamination, langid, packing, simhash
from acclaim.llm.common import prepare, remainder, stage, table
from acclaim.llm.queries import BYTE_BPE, vocabulary_path


def _small_batches(spark: SparkSession) -> None:
    """Whole documents pass through Python here, four times in a row in the same executors: keep what is under way small."""
    prepare(spark, 250)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language's model accepts; ``und`` and rejected ones go."""
    _small_batches(spark)
    model = langid.fit(docs, remainder(F.col("doc_id"), 5) != 0)
    return langid.accepted(docs, model)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    _small_batches(spark)
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages beyond the allowed share."""
    _small_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the remaining documents with its sequence and place."""
    _small_batches(spark)
    return packing.pack_documents(docs, vocabulary_path(BYTE_BPE))


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Character models and fingerprints of a hash that SQL lacks cannot be written as SQL.
ORACLE_SQL = None
