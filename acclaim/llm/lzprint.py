"""Lempel-Ziv phrase fingerprints: likeness of documents as a compressor sees it.

A text is parsed into LZ78 phrases (each the shortest string not yet in the dictionary), the
phrase set is hashed, and the smallest hashes are the fingerprint.  The likeness of two
fingerprints estimates the Jaccard index of the phrase sets.  An edited text with the same
beginning shares the parse up to the last phrase before the edit.

Defined results: a null text is empty and has the empty fingerprint, which is like (1.0) another
empty one and unlike (0.0) anything else.  Rows are ordered by (doc_id descending, nulls last,
text); repeated rows follow each other.  One row's next document is itself.  Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acclaim.llm.common import prepare, span_hashes

#: hashes kept per fingerprint
SIGNATURE = 128


def phrase_ends(text: str, seen: set[str], at: int = 0) -> list[int]:
    """Ends of the LZ78 phrases of ``text[at:]``; ``seen`` is the dictionary and grows."""
    ends = []
    phrase = ""
    add, ended = seen.add, ends.append
    for end, character in enumerate(text[at:] if at else text, at + 1):
        phrase += character
        if phrase not in seen:
            add(phrase)
            ended(end)
            phrase = ""
    return ends


def phrase_hashes(text: str, starts: list[int], ends: list[int]) -> np.ndarray:
    """64-bit hashes of ``text[s:e]``, from one running sum over the code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return span_hashes(points, np.asarray(starts, np.int64), np.asarray(ends, np.int64))


def signature(hashes: np.ndarray, size: int = SIGNATURE) -> np.ndarray:
    """The smallest distinct upper halves, ascending."""
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    if upper.size > 4 * size:
        upper = np.partition(upper, 4 * size)[: 4 * size]
    return np.unique(upper)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIGNATURE) -> float:
    """Estimated Jaccard index: the share of the smallest hashes of the union that both have."""
    if not a.size and not b.size:
        return 1.0
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1]) / union.size)


def shown(signed: np.ndarray) -> str:
    """Fixed-width hexadecimal text of a signature."""
    return signed.astype(">u4").tobytes().hex()


class Parsed:
    """A text with its parse; can be re-parsed once for another ending."""

    def __init__(self, text: str, size: int):
        self.text, self.size = text, size
        self.seen: set[str] = set()
        self.ends = phrase_ends(text, self.seen)
        self.starts = [0, *self.ends[:-1]] if self.ends else []
        self.hashes = phrase_hashes(text, self.starts, self.ends)
        self.signature = signature(self.hashes, size)

    def edited(self, keep: int, ending: str) -> tuple[str, np.ndarray]:
        """The text with all but its first ``keep`` characters replaced, and its signature."""
        other = self.text[:keep] + ending
        shared = int(np.searchsorted(np.asarray(self.ends, np.int64), keep, side="right"))
        for s, e in zip(self.starts[shared:], self.ends[shared:]):
            self.seen.discard(self.text[s:e])
        at = self.ends[shared - 1] if shared else 0
        ends = phrase_ends(other, self.seen, at)
        added = phrase_hashes(other[at:], [x - at for x in [at, *ends[:-1]]], [x - at for x in ends]) if ends else self.hashes[:0]
        return other, signature(np.concatenate([self.hashes[:shared], added]), self.size)


def range_bucket(value: Column, bounds: list[int]) -> Column:
    """Number of ascending ``bounds`` that are not above ``value``, by binary search inside the row."""
    if not bounds:
        return F.lit(0)
    levels = len(bounds).bit_length()
    padded = F.lit([*bounds, *[2**63 - 1] * (2**levels - 1 - len(bounds))])
    steps = F.lit([2**k for k in reversed(range(levels))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.element_at(padded, at + step) <= value, at + step).otherwise(at)
    )


def neighbour_fingerprints(docs: DataFrame, size: int = SIGNATURE) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and their likeness to each other and to the next document.

    The texts move once, by ranges of doc_id.  The first row of each range also goes to the range
    before it, so no row needs another task to see its next document.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a list as long as the number of ranges, never as the table
    bounds = sorted({int(q) for q in docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)})
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(range_bucket(F.col("doc_id"), bounds))
    docs = docs.withColumn("_bucket", bucket)
    heads = docs.select("_bucket", "doc_id").groupBy("_bucket").agg(F.max("doc_id").alias("head")).collect()
    heads = sorted(heads, key=lambda r: -r["_bucket"])
    guests = [(r["head"], heads[i - 1]["_bucket"]) for i, r in enumerate(heads)]
    to_before = spark.createDataFrame(guests, "_head long, _before int")
    placed = docs.join(F.broadcast(to_before), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("guest"))
    placed = placed.select("doc_id", "text", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("_to"))
    placed = placed.select("doc_id", "text", "_to.bucket", "_to.guest").repartition("bucket")
    placed = placed.sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        before = None
        for batch in batches:
            rows = []
            for doc_id, text, at, visits in zip(*(c.to_pylist() for c in batch.columns)):
                here = Parsed(text or "", size)
                if before is not None and before[1] == at:
                    n = len(before[2].text)
                    other, edited = before[2].edited(n - n // 3, here.text[: n // 3])
                    rows.append((
                        before[0], n, hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), shown(before[2].signature),
                        shown(edited), likeness(before[2].signature, edited, size), likeness(before[2].signature, here.signature, size),
                    ))
                before = None if visits else (doc_id, at, here)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return placed.mapInArrow(compare, schema)
