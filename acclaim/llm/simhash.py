"""SimHash near-duplicates found with vantage-point trees.

A fingerprint is 64 bits, each the majority of that bit over the hashes of a text's word shingles.
Two fingerprints link at ``radius`` or fewer differing bits.

Search.  The 64 bits are cut into ``BLOCKS`` blocks; linked fingerprints differ by at most
``radius // BLOCKS`` bits in one of them (pigeonhole), so one vantage-point tree per block is
searched with that small radius.  A node holds a vantage point and a median distance m: a
fingerprint at block distance d goes to the near side if d <= m and to the far side if d > m - r.
By the triangle inequality the block distances of linked fingerprints to the vantage point differ
by at most r, so the pair always meets in some shard: both near, both far, or the near one lies in
the boundary band (m - r, m] that the far side receives as well.  Shards are compared exactly on
all 64 bits.

Trees are fitted on a bounded sample (about ``SAMPLE`` distinct fingerprints, chosen by hash) and
decide only how evenly shards fill, never which links are found.  A shard gives the links of a
spanning forest of its linked fingerprints: enough for the classes, without emitting all pairs.

Defined results: null and wordless texts have fingerprint zero and link like any other; equal
texts share a fingerprint; repeated rows give a row each; a null doc_id never names a class (a
class without any id has a null one); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acclaim.llm.common import KEY, parted, prepare, row_key, stage

RADIUS = 4
SHINGLE = 4
BLOCKS = 3
#: distinct fingerprints the trees are fitted on (at most about twice as many)
SAMPLE = 32_768
#: distinct fingerprints wanted in a shard
SHARD = 2_048


def simhash(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[words - 1:] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        part = [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[at:at + (1 << 16)], stops[at:at + (1 << 16)])]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = 2 * ones > len(starts)
    return int.from_bytes(np.packbits(majority).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = SHINGLE) -> DataFrame:
    """The kept columns and the signed 64-bit ``print`` of every whole text."""
    prepare(docs.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for name in keep for f in docs.schema.fields if f.name == name]

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            values = [simhash(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()]
            signed = np.array(values, dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(signed)], names=[*keep, "print"])

    return docs.select(*keep, "text").mapInArrow(scan, ", ".join([*fields, "print long"]))


def block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


class VantageTree:
    """Routes fingerprints to shards by block distance; built from a sample."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, depth: int):
        self.mask, self.radius = np.uint64(mask), radius
        self.shards = 0
        self.root = self._grow(np.unique(sample & self.mask), depth)

    def _distance(self, prints: np.ndarray, point: int) -> np.ndarray:
        return np.bitwise_count((prints ^ np.uint64(point)) & self.mask)

    def _grow(self, sample: np.ndarray, depth: int):
        if depth and sample.size > 2 * self.radius + 2:
            # of a few candidates the vantage point with the smallest boundary band, then the fairest halves
            best = None
            for point in sample[:: max(1, sample.size // 8)][:8].tolist():
                d = self._distance(sample, point)
                median = int(np.median(d))
                for m in (median - 1, median):
                    near = int((d <= m).sum())
                    both = int(((d <= m) & (d > m - self.radius)).sum())
                    larger = max(near, sample.size - near + both)
                    if near and near < sample.size and larger < sample.size and (best is None or larger < best[0]):
                        best = (larger, point, m, d)
            if best is not None:
                _, point, m, d = best
                return point, m, self._grow(sample[d <= m], depth - 1), self._grow(sample[d > m - self.radius], depth - 1)
        self.shards += 1
        return self.shards - 1

    def route(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of fingerprint, shard) for every shard that a fingerprint belongs to."""
        where, shards = [], []
        waiting = [(self.root, np.arange(prints.size))]
        while waiting:
            node, index = waiting.pop()
            if not index.size:
                continue
            if isinstance(node, tuple):
                d = self._distance(prints[index], node[0])
                waiting += [(node[2], index[d <= node[1]]), (node[3], index[d > node[1] - self.radius])]
            else:
                where.append(index)
                shards.append(np.full(index.size, node))
        return (np.concatenate(where), np.concatenate(shards)) if where else (np.zeros(0, int), np.zeros(0, int))


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over distinct fingerprints that are ``radius`` or less apart.

    Breadth first: what a fingerprint reaches leaves the unvisited ones, so a dense group is
    passed over once and not pair by pair.
    """
    prints = np.sort(prints)
    near, far = [], []
    waiting = prints
    queue: list[int] = []
    while waiting.size:
        if not queue:
            queue.append(int(waiting[0]))
            waiting = waiting[1:]
        point = np.uint64(queue.pop())
        close = np.bitwise_count(waiting ^ point) <= radius
        if close.any():
            reached = waiting[close]
            waiting = waiting[~close]
            near.append(np.full(reached.size, point))
            far.append(reached)
            queue += reached.tolist()
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(near), np.concatenate(far)) if near else (empty, empty)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect every class of the distinct ``print`` values; ``distinct`` must be stored."""
    spark = distinct.sparkSession
    n = distinct.count()
    chosen = distinct.filter(F.pmod(F.xxhash64(F.lit(1), "print"), F.lit(max(1, n // SAMPLE))) == 0)
    sample = np.array([r["print"] for r in chosen.select("print").collect()], dtype=np.int64).astype(np.uint64)
    depth = max(0, math.ceil(math.log2(max(1, n / shard))) + 2)
    trees = [VantageTree(sample, mask, radius // blocks, depth) for mask in block_masks(blocks)]
    shared = spark.sparkContext.broadcast([(t.root, int(t.mask), t.radius) for t in trees])

    def deal(batches):
        import pyarrow as pa

        own = []
        for root, mask, r in shared.value:
            tree = VantageTree.__new__(VantageTree)
            tree.root, tree.mask, tree.radius = root, np.uint64(mask), r
            own.append(tree)
        for batch in batches:
            prints = np.asarray(batch.column(0), dtype=np.int64).astype(np.uint64)
            for number, tree in enumerate(own):
                where, shards = tree.route(prints)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards.astype(np.int64) * len(own) + number), pa.array(prints[where].astype(np.int64))], names=["shard", "print"]
                )

    def compare(table):
        import pyarrow as pa

        a, b = forest(np.asarray(table.column("print"), dtype=np.int64).astype(np.uint64), radius)
        return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})

    dealt = distinct.select("print").mapInArrow(deal, "shard long, print long")
    return dealt.groupBy("shard").applyInArrow(compare, "a long, b long")


def classes(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the edges, for every node that has one.

    Every node takes the smallest label around it, and labels follow labels, until none changes.
    The node's own label moves along the joins only as one long value; hubs are combined before
    they are shuffled.  Each round is written to the shared folder.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    both = stage(both, "links")
    labels = stage(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        # jump: my label's label
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        nearer = nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label"))
        nearer = stage(nearer, "labels")
        labels = nearer.select("node", "label")
        if nearer.filter("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, radius: int = RADIUS, keep: tuple[str, ...] = ("doc_id",), words: int = SHINGLE) -> DataFrame:
    """The kept columns (doc_id among them) with ``print`` and component_id, the smallest doc_id reachable over links."""
    prints = stage(fingerprints(docs, keep, words), "prints")
    distinct = stage(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-prints")
    edges = stage(links(distinct, radius), "print-links")
    labels = classes(edges).withColumnRenamed("node", "print")
    joined = distinct.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print"))
    joined = stage(joined, "print-classes")
    ids = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    members = joined.join(ids, "label").select("print", "component_id", "label")
    return prints.join(members, "print").select(*keep, "print", "component_id", "label")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """One document of each class: the one with the smallest doc_id, all its columns.

    Of repeated rows one stays; in a class without any doc_id, the row with the smallest text hash.
    """
    keyed = row_key(docs)
    found = near_duplicates(keyed, radius, ("doc_id", KEY), words)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(KEY))
    per_key = stage(found.groupBy(KEY).agg(F.count("*").alias("n"), F.min("label").alias("label"), F.min("doc_id").alias("doc_id")), "class-keys")
    kept = per_key.groupBy("label").agg(F.min_by(KEY, order).alias(KEY)).select(KEY)
    # only rows that go, or that stand several times, have to be looked at
    gone = per_key.join(kept, KEY, "left_anti").select(KEY).union(per_key.filter("n > 1").select(KEY))
    alone, others = parted(keyed, stage(gone.distinct(), "class-copies"))
    # an inner join on unique keys: a semi join would be pushed below and move every text
    return alone.unionByName(others.join(kept, KEY).dropDuplicates([KEY])).select(*docs.columns)
