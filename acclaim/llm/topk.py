"""Exact top-k inner-product search by distributed histogram selection.

Vectors become whole numbers, floor(scale * x).  The queries go in blocks of a bounded number of
values; a block is broadcast, every task scores all its rows against it and counts scores by bins of
a histogram per query.  The sums over all tasks tell in which bin the k-th highest score lies; the
next pass divides that bin, until a bin is one value.  A last pass keeps the scores above that value
and, of those equal to it, as many as are still wanted, smallest ids first.

What a task sends is bounded: bins below its own k-th score cannot matter and stay behind, and of
equal scores no more than are wanted leave a task.  A first search among the query rows alone gives
each query a lower bound, so that later passes count only scores that may be among the highest.
Nothing is sampled away: the bound is the k-th score of a part of the candidates.

Defined results: a vector that is null or holds a null or non-finite component takes no part; vectors of
different length are not compared; a product beyond a long is held at the long's end; ties go
to the smaller id, null ids last, repeated rows among themselves in any order; every row but the
query's own is a candidate, also one with the same id; a null id is no query; fewer than k candidates
are all returned; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acclaim.llm.common import prepare, stage
from acclaim.session import scratch_folder

#: numbers in a block of queries (on average half as many), in a chunk of candidates, and scores held at once
BLOCK_VALUES, CHUNK_VALUES, TILE = 1 << 22, 1 << 21, 1 << 20
BIN_BITS = 10
_NONE = np.iinfo(np.int64).min
_END = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v array<bigint>) of the vectors that take part."""
    x = F.col(embedding).cast("array<double>")
    broken = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * float(scale)))
    return vectors.filter(x.isNotNull() & ~broken).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows as longs."""
    most = [int(max(abs(int(m.max())), abs(int(m.min())))) if m.size else 0 for m in (left, right)]
    if left.shape[1] * most[0] * most[1] < 1 << 53:
        # sums below 2**53 are exact in floating point, whatever their order
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    exact = left.astype(object) @ right.astype(object).T
    return np.clip(exact, -_END, _END).astype(np.int64)


class Queries:
    """A block of queries and how far each one's k-th score is known."""

    def __init__(self, rows: np.ndarray, vectors: list[np.ndarray], longest: float, k: int):
        self.rows, self.vectors = rows, vectors
        norms = [math.sqrt(float((v.astype(np.float64) ** 2).sum())) for v in vectors]
        # no product is larger than the product of the norms; a little more for rounding
        self.most = np.array([min(int(min(n * longest * 1.000001, 2.0**62)) + 1 if n * longest < 2.0**62 else _END, _END) for n in norms], np.int64)
        self.low = -self.most
        self.need = np.full(rows.size, k, np.int64)
        self.shift = np.zeros(rows.size, np.uint64)
        self.open = np.ones(rows.size, bool)

    def restart(self, k: int) -> None:
        """Count again from the lower bounds found so far."""
        self.need[:] = k
        # whole steps of BIN_BITS, so that every pass divides just the bin of the pass before
        spans = [(int(m) - int(low) + 1).bit_length() for m, low in zip(self.most, self.low)]
        self.shift = np.array([max(0, -(-s // BIN_BITS) - 1) * BIN_BITS for s in spans], np.uint64)
        self.open[:] = True

    def narrow(self, found: dict[int, tuple[int, int]]) -> None:
        """Take the bin and the number of scores above it; a query without one has fewer candidates than wanted."""
        for q in np.flatnonzero(self.open):
            if q not in found:
                self.open[q] = False
                continue
            bin_no, above = found[q]
            self.low[q] = int(self.low[q]) + (bin_no << int(self.shift[q]))
            self.need[q] -= above
            self.open[q] = self.shift[q] > 0
            self.shift[q] -= self.open[q] * BIN_BITS

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, matrix) per length of vectors."""
        sizes = np.array([v.size for v in self.vectors])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            yield at, np.stack([self.vectors[i] for i in at])


def _chunks(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, id, id is null, matrix) of candidates with vectors of one length, sorted by id with nulls last."""
    import pyarrow as pa

    held: dict[int, list] = {}
    for batch in batches:
        row, vec_id, v = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
        missing = vec_id.is_null().to_numpy(zero_copy_only=False)
        ids = vec_id.fill_null(0).to_numpy()
        offsets = v.offsets.to_numpy()
        values = (v.values if isinstance(v, pa.ListArray) else v.flatten()).to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            matrix = values[offsets[at][:, None] + np.arange(size)]
            parts = held.setdefault(int(size), [])
            parts.append((row[at], ids[at], missing[at], matrix))
            if sum(p[0].size for p in parts) * max(int(size), 1) >= CHUNK_VALUES:
                yield _sorted(held.pop(int(size)))
    for parts in held.values():
        yield _sorted(parts)


def _sorted(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, ids, missing, matrix = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((row, ids, missing))
    return row[order], ids[order], missing[order], matrix[order]


def _scored(batches, queries: Queries) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    """(query positions, scores per query and candidate, chunk); a query's own row is marked as no score."""
    groups = {matrix.shape[1]: (at, matrix) for at, matrix in queries.groups()}
    for chunk in _chunks(batches):
        row, size = chunk[0], chunk[3].shape[1]
        if size not in groups:
            continue
        at, matrix = groups[size]
        by_row = np.argsort(row)
        step = max(1, TILE // row.size)
        for low in range(0, at.size, step):
            here = at[low:low + step]
            scores = products(matrix[low:low + step], chunk[3])
            own = queries.rows[here]
            place = np.minimum(np.searchsorted(row, own, sorter=by_row), row.size - 1)
            mine = row[by_row[place]] == own
            scores[np.flatnonzero(mine), by_row[place[mine]]] = _NONE
            yield here, scores, chunk


def _histograms(candidates: DataFrame, shared) -> DataFrame:
    """(q, need, bin, n): scores of all candidates by bins, for the queries that are still open."""

    def count(batches):
        import pyarrow as pa

        queries = shared.value
        bins = 1 << BIN_BITS
        for here, scores, _ in _scored(batches, queries):
            keep = queries.open[here]
            here, scores = here[keep], scores[keep]
            low, shift, need = queries.low[here], queries.shift[here], queries.need[here]
            # differences of longs as unsigned numbers do not overflow
            bin_no = (scores.view(np.uint64) - low.view(np.uint64)[:, None]) >> shift[:, None]
            inside = (scores >= low[:, None]) & (bin_no < bins)
            flat = (np.arange(here.size)[:, None] * bins + bin_no.astype(np.int64))[inside]
            counts = np.bincount(flat, minlength=here.size * bins).reshape(here.size, bins)
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (above < need[:, None]))
            columns = [here[q].astype(np.int32), need[q], b.astype(np.int32), counts[q, b].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "need", "bin", "n"])

    return candidates.mapInArrow(count, "q int, need long, bin int, n long")


def _located(histograms: DataFrame) -> dict[int, tuple[int, int]]:
    """Per query the bin that holds the wanted score and the number of scores above it; one row per query of a block."""
    higher = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    summed = histograms.groupBy("q", "need", "bin").agg(F.sum("n").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    hit = summed.filter((F.col("above") < F.col("need")) & (F.col("need") <= F.col("above") + F.col("n")))
    return {r.q: (r.bin, r.above) for r in hit.select("q", "bin", "above").collect()}


def _selected(candidates: DataFrame, shared) -> DataFrame:
    """(query_row, row, vec_id, score) at or above the k-th scores; of equals no more than wanted per chunk."""

    def select(batches):
        import pyarrow as pa

        queries = shared.value
        for here, scores, (row, ids, missing, _) in _scored(batches, queries):
            low, need = queries.low[here], queries.need[here]
            q, c = np.nonzero((scores > low[:, None]))
            tq, tc = np.nonzero(scores == low[:, None])
            # candidates lie in the order of their ids
            rank = np.arange(tq.size) - np.searchsorted(tq, tq)
            few = rank < need[tq]
            q, c = np.concatenate([q, tq[few]]), np.concatenate([c, tc[few]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries.rows[here[q]]), pa.array(row[c]), pa.array(ids[c], mask=missing[c]), pa.array(scores[q, c])],
                ["query_row", "row", "vec_id", "score"],
            )

    return candidates.mapInArrow(select, "query_row long, row long, vec_id long, score long")


def _locate(queries: Queries, candidates: DataFrame, k: int) -> None:
    spark = candidates.sparkSession
    queries.restart(k)
    while queries.open.any():
        shared = spark.sparkContext.broadcast(queries)
        found = _located(_histograms(candidates, shared))
        shared.destroy()
        queries.narrow(found)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest inner products of every query row.

    ``vectors`` has vec_id and v (whole numbers); ``is_query`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    prepare(spark, 4096)
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    stored = stage(numbered, "topk-vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    size = stored.agg(F.count_if("is_query").alias("n"), F.max(F.when(F.col("is_query"), F.size("v"))).alias("dims"), F.max(F.sqrt(square)).alias("longest")).first()
    blocks = max(1, -(-2 * size.n * max(size.dims or 0, 1) // BLOCK_VALUES))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    asked = stored.filter("is_query").select("row", "vec_id", "v", block.alias("block"))
    asked = stage(asked.repartitionByRange("block") if blocks > 1 else asked, "topk-queries")
    candidates, among = stored.select("row", "vec_id", "v"), asked.select("row", "vec_id", "v")
    path = f"{scratch_folder(spark)}/acclaim/llm-topk-selected-{uuid.uuid4().hex}"
    schema = "query_row long, row long, vec_id long, score long"
    spark.range(0).selectExpr(*[f"id AS {c}" for c in ("query_row", "row", "vec_id", "score")]).write.parquet(path)
    for b in range(blocks):
        # a block holds a bounded number of values
        rows = asked.filter(F.col("block") == b).select("row", "v").toArrow()
        if not rows.num_rows:
            continue
        queries = Queries(rows["row"].to_numpy(), [np.array(v, np.int64) for v in rows["v"].to_pylist()], size.longest, k)
        _locate(queries, among, k)
        _locate(queries, candidates, k)
        shared = spark.sparkContext.broadcast(queries)
        _selected(candidates, shared).write.mode("append").parquet(path)
        shared.destroy()
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ids = asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return best.join(ids, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
