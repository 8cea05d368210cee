"""Corpus scans: folders of text, markdown or HTML, parquet tables, positioned lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acclaim import schemas


def file_stem(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)\.[^.]+$", 1)


def read_text_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("txt", "md", "html"),
                     recursive: bool = True) -> DataFrame:
    """One row per file: doc_id (hash of the path), name (file stem), path, full_text.

    Extensions match in any case; dot-files are skipped.
    """
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=recursive)
    name = F.col("_metadata.file_name")
    wanted = f"(?i)^[^.].*\\.(?:{'|'.join(extensions)})$"
    return raw.select(
        F.xxhash64("_metadata.file_path").alias("doc_id"), name.alias("_name"), F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("full_text"),
    ).filter(F.col("_name").rlike(wanted)).withColumn("name", file_stem(F.col("_name"))).select(
        "doc_id", "name", "path", "full_text"
    )


def list_corpus(papers: DataFrame) -> DataFrame:
    """Papers in name order."""
    return papers.orderBy("name", "path")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Positioned lines; blank text is dropped."""
    return spark.read.schema(schemas.TEXT_LINES).parquet(path).filter(F.trim("text") != "")
