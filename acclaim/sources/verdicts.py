"""Judge answers: free text around one JSON object per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acclaim import schemas
from acclaim.functions.once import with_once
from acclaim.functions.text import first_json_object


def read_verdict_files(spark: SparkSession, path: str) -> DataFrame:
    """One response per file named ``<doc_id>_<batch_no>.<ext>``."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)_(\d+)\.[^.]+$", 1)
    batch = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)_(\d+)\.[^.]+$", 2)
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return raw.select(
        stem.cast("bigint").alias("doc_id"), batch.cast("int").alias("batch_no"), F.col("value").alias("response")
    )


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """Response rows -> (doc_id, cand_id, accept, reason, evaluated_paper), the last answer per id.

    A response without valid JSON gives no rows; the verdict join then accepts its batch.
    """
    # bound: the generator's own test for empty arrays would read every response again
    read = with_once(
        responses.select("doc_id", "batch_no", "response"), "r",
        F.from_json(first_json_object(F.col("response")), schemas.JUDGE_RESPONSE)["results"],
    )
    answers = read.select("doc_id", "batch_no", F.posexplode("r").alias("pos", "v"))
    return (
        answers.groupBy("doc_id", F.col("v.id").alias("cand_id"))
        .agg(F.max_by(F.col("v"), F.struct("batch_no", "pos")).alias("v"))
        .filter(F.col("cand_id").isNotNull())
        .select("doc_id", "cand_id", "v.accept", "v.reason", "v.evaluated_paper")
    )
