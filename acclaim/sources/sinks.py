"""Writers.  All are plain partitioned Spark writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acclaim.operators.ordering import numbered
from acclaim.operators.register import with_chinese_headers
from acclaim.operators.report import batch_summary, report_order
from acclaim.session import write_stage


def write_register(rows: DataFrame, path: str, fmt: str = "parquet", chinese_headers: bool = False) -> None:
    out = with_chinese_headers(rows) if chinese_headers else rows
    writer = out.write.mode("overwrite")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def write_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("overwrite").partitionBy("stage").parquet(path)


def write_results(results: DataFrame, path: str, buckets: int = 64) -> None:
    """Routes papers with and without records, replacing what an earlier run said about the same papers.

    The papers lie in ``buckets`` folders by a hash of their id.  Only folders that hold a paper of this run
    are rewritten: their other papers are carried over, and all other folders stay as they are.
    """
    spark = results.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    fresh = write_stage(results.withColumns({"has_result": F.col("n_records") > 0, "bucket": bucket}), "results")
    # at most ``buckets`` rows
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
    if not touched:
        return
    try:
        earlier = spark.read.schema(fresh.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = fresh
    else:
        kept = earlier.filter(F.col("bucket").isin(touched)).join(fresh.select("doc_id"), "doc_id", "left_anti")
        # stored apart before the folders it comes from are replaced
        merged = write_stage(fresh.unionByName(kept), "merged-results")
    ordered = merged.repartition("bucket").sortWithinPartitions("bucket", "has_result")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_results(spark: SparkSession, path: str, has_result: bool | None = None) -> DataFrame:
    """The latest row of every paper, or of those with (without) records."""
    rows = spark.read.parquet(path).drop("bucket")
    return rows if has_result is None else rows.filter(F.col("has_result") == has_result)


def write_report(results: DataFrame, items: DataFrame, path: str) -> None:
    """The report as JSON lines: ``path/papers`` in report order with every paper's items, ``path/summary`` with the totals.

    Every paper knows its ``position``.  Files hold ranges of the order, in the order of their names.
    """
    rows = numbered(results.join(items, "doc_id", "left"), *report_order(results), F.asc("doc_id"), name="position")
    rows.repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").json(f"{path}/papers")
    batch_summary(results).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The papers of a report: position, what ``paper_results`` says of each, and its items."""
    item = "struct<marker:string,author:string,sentence:string>"
    return spark.read.schema(f"doc_id long, name string, error string, n_records long, status string, items array<{item}>, position long").json(f"{path}/papers")
