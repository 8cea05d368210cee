"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import acclaim
from acclaim.session import write_stage


#: a column name that tables are not expected to have
KEY = "_acclaim_row_key"
_SLOT, _HIT = "_acclaim_slot", "_acclaim_hit"
KEY_SLOTS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once to the cluster's shared folder and read it back."""
    return write_stage(df, f"llm-{name}")


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """What operators with Python workers rely on.

    Workers look for this package where the driver found it, unless it is installed for them.  Arrow
    batches get a bound on rows, so that long texts do not meet by the ten thousand in a worker.
    """
    root = str(Path(acclaim.__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; the contracts' way to hold documents out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def row_key(df: DataFrame) -> DataFrame:
    """Append the column ``KEY``: a hash of (doc_id, text), which repeated rows share and null ids survive."""
    return df.withColumn(KEY, F.xxhash64(F.lit(7), "doc_id", "text"))


def parted(keyed: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``KEY`` is certainly not among ``keys`` (stored), and the rest.

    The first part, mostly nearly all, then needs no join and its texts do not move.  What is broadcast are
    the occupied ones of ``KEY_SLOTS`` slots, so its size is bounded whatever the tables hold.
    """
    slot = F.pmod(F.col(KEY), F.lit(KEY_SLOTS)).cast("int").alias(_SLOT)
    occupied = keys.select(slot).distinct().withColumn(_HIT, F.lit(True))
    marked = keyed.withColumn(_SLOT, slot).join(F.broadcast(occupied), _SLOT, "left")
    return marked.filter(F.col(_HIT).isNull()).drop(_SLOT, _HIT), marked.filter(_HIT).drop(_SLOT, _HIT)


def by_size(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with at most ``most`` characters together, or one longer text."""
    low = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > most:
            yield low, i
            low, size = i, 0
        size += n
    if low < len(texts):
        yield low, len(texts)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, ``n`` of them."""
    if _powers[0].size < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 2 * _powers[i].size), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[s:e]`` for all spans, from one running sum; equal spans have equal hashes."""
    powers, inverse = _power_tables(values.size + 1)
    sums = np.zeros(values.size + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])
