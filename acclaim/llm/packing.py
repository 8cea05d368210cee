"""Best-fit packing of token sequences by exact-complement hashing.

Only the histogram of piece lengths decides which lengths share a sequence, and it has at most
``capacity`` entries whatever the size of the corpus.  The plan is therefore made for *patterns*
(multisets of lengths that fill one sequence) with the number of sequences each is used for;
pieces then take their places by rank among the pieces of their length.

Defined results: a null text counts as empty (its end id alone, one piece of length 1); repeated
rows are packed one by one; extra columns are ignored; an empty table gives no rows; a null
doc_id is packed like any other and stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acclaim.llm.common import prepare, stage
from acclaim.llm.tokens import encoder

CAPACITY = 2048
#: ranks inside one length are counted in this many independent parts
RANK_PARTS = 32

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Ids of every whole text, then ``end_id``; longer documents are cut, the first piece being the short one."""
    prepare(docs.sparkSession)

    def cut(batches):
        import pyarrow as pa

        encode = encoder(vocabulary).encode
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at = 0
                until = (n - 1) % capacity + 1
                piece = 0
                while at < n:
                    for values, value in zip(rows, (doc_id, piece, at, until - at, zlib.crc32(ids[4 * at:4 * until]))):
                        values.append(value)
                    at, until, piece = until, until + capacity, piece + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE_SCHEMA)


def complement(counts: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths whose sum is exactly ``gap``; longest member as long as possible."""
    if counts[gap]:
        return [gap]
    have = counts > 0
    # pair sums: a + b = gap, each length available (twice if a = b)
    low = np.arange(1, gap // 2 + 1)
    fits = have[low] & have[gap - low]
    if gap % 2 == 0 and gap >= 2 and counts[gap // 2] < 2:
        fits[-1:] = False
    found = low[fits]
    if found.size:
        a = int(found[0])
        return [gap - a, a]
    # triple sums: the longest first, the rest is a pair not longer than it
    for a in np.flatnonzero(have[: max(gap - 1, 0)])[::-1]:
        a = int(a)
        if 3 * a < gap:
            break
        rest = gap - a
        small = np.arange(max(1, rest - a), rest // 2 + 1)
        if not small.size:
            continue
        large = rest - small
        need = 1 + (small == a).astype(int) + (large == a)
        good = have[small] & have[large] & (counts[a] >= need) & ((small != large) | (counts[small] >= 2 + (small == a)))
        if good.any():
            b = int(small[good][0])
            return [a, rest - b, b]
    return None


def packing_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, number of such sequences)] that use every piece of the histogram once.

    Longest pieces open sequences.  A gap is filled exactly by one, two or three pieces while such
    a combination is available; otherwise the longest piece that fits goes in and the smaller gap
    is tried again.  Every step uses up a length, so there are at most a few patterns per length.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[: len(histogram)] = histogram
    plan: list[tuple[list[int], int]] = []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            pattern = [longest]
            left = counts.copy()
            left[longest] -= 1
            gap = capacity - longest
            while gap > 0:
                exact = complement(left, gap)
                if exact is None:
                    fitting = np.flatnonzero(left[: gap + 1])
                    if not fitting.size:
                        break
                    exact = [int(fitting[-1])]
                for length in exact:
                    left[length] -= 1
                    gap -= length
                pattern += exact
            used = counts - left
            times = int((counts[used > 0] // used[used > 0]).min())
            counts -= times * used
            plan.append((pattern, times))
    return plan


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Append sequence_id and offset to rows that have a ``length`` of 1 to ``capacity``.

    ``pieces`` must be a stored table: it is read for the histogram and again for the places.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_PARTS)))
    per_part = stage(salted.groupBy("length", "_part").agg(F.count("*").alias("_n")), "pack-counts")
    # at most `capacity` rows, whatever the corpus
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    slots = []
    next_rank = np.zeros(capacity + 1, dtype=np.int64)
    first_sequence = 0
    for pattern, times in packing_plan(histogram, capacity):
        at = 0
        for length in pattern:
            slots.append((length, int(next_rank[length]), int(next_rank[length]) + times, first_sequence, at))
            next_rank[length] += times
            at += length
        first_sequence += times
    plan = spark.createDataFrame(slots, "length long, _from long, _until long, _first long, _offset long")
    plan = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_from", "_until", "_first", "_offset"))).alias("_slots"))
    by_part = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("length", "_part", F.coalesce(F.sum("_n").over(by_part), F.lit(0)).alias("_before"))
    # at most capacity * RANK_PARTS and capacity rows
    in_part = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_in", F.row_number().over(in_part) - 1)
    ranked = ranked.join(F.broadcast(before), ["length", "_part"]).join(F.broadcast(plan), "length")
    rank = F.col("_before") + F.col("_in")
    slot = F.filter("_slots", lambda s: (s["_from"] <= rank) & (rank < s["_until"]))[0]
    return (
        ranked.withColumn("_slot", slot)
        .withColumn("sequence_id", F.col("_slot._first") + rank - F.col("_slot._from"))
        .withColumn("offset", F.col("_slot._offset"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and place in it."""
    return place_pieces(stage(token_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
