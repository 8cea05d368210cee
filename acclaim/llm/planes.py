"""Token-id files: fixed-size blocks of ids, transposed into byte or bit planes, each compressed with zstandard.

A file set is a folder with ``chunks`` (Parquet rows without compression of their own, so that
Spark's committer and any file system serve) and ``shards``.  A chunk holds whole documents:

    magic "IDP1" | ids u32 | block size u32 | planes u32 (8 bits a plane: 4, 1 bit a plane: 32)
    | compressed size u32 of every plane of every block, 0 for a plane of zeros | the planes

with little-endian numbers.  The sizes are the chunk's index: any block can be read alone.  Each
row also has the documents' ids and sizes, and the place of the chunk in its shard; ``shards`` has
the number of ids before each shard.  Shards are ranges of doc_id in ascending order.

Defined results: a null text is empty (its end id alone); null doc_ids come last; rows with equal
doc_id are ordered by text; extra columns are ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acclaim.llm.common import prepare
from acclaim.llm.tokens import encoder
from acclaim.session import scratch_folder

MAGIC = b"IDP1"
BLOCK = 1 << 15
#: ids after which a chunk is closed; a longer document has a chunk of its own
CHUNK = 1 << 18


def to_planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """One row of bytes per plane."""
    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return np.ascontiguousarray(as_bytes.T)
    return np.packbits(np.unpackbits(as_bytes, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    each = np.unpackbits(planes, axis=1, count=n, bitorder="little")
    return np.packbits(each.T, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack_ids(ids: np.ndarray, block: int = BLOCK, bits: bool = False) -> bytes:
    """A chunk of the file format."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    sizes, data = [], []
    for at in range(0, ids.size, block):
        for plane in to_planes(ids[at:at + block], bits):
            packed = compress(plane.tobytes()) if plane.any() else b""
            sizes.append(len(packed))
            data.append(packed)
    header = MAGIC + struct.pack("<III", ids.size, block, 32 if bits else 4)
    return header + np.array(sizes, "<u4").tobytes() + b"".join(data)


def unpack_ids(chunk: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a chunk, or of some neighbouring blocks of it."""
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    if chunk[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    n, block, planes = struct.unpack_from("<III", chunk, 4)
    count = -(-n // block)
    sizes = np.frombuffer(chunk, "<u4", count * planes, 16).astype(np.int64).reshape(count, planes)
    starts = 16 + 4 * sizes.size + np.concatenate([[0], np.cumsum(sizes.reshape(-1))])
    out = []
    for b in range(count) if blocks is None else blocks:
        here = min(block, n - b * block)
        width = here if planes == 4 else -(-here // 8)
        rows = np.zeros((planes, width), np.uint8)
        for p in range(planes):
            if sizes[b, p]:
                at = int(starts[b * planes + p])
                rows[p] = np.frombuffer(decompress(chunk[at:at + int(sizes[b, p])], max_output_size=width), np.uint8)
        out.append(from_planes(rows, here, planes == 32))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


_CHUNKS = "shard int, chunk int, before long, n_ids long, doc_ids array<long>, sizes array<long>, payload binary"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, block: int = BLOCK, chunk: int = CHUNK, bits: bool = False) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    order = F.asc_nulls_last("doc_id")
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(order).sortWithinPartitions(order, "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(vocabulary).encode
        end = int(end_id).to_bytes(4, "little")
        shard = TaskContext.get().partitionId()
        number = before = held = 0
        doc_ids: list = []
        sizes: list[int] = []
        parts: list[bytes] = []
        schema = pa.schema([
            ("shard", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary()),
        ])

        def closed():
            payload = pack_ids(np.frombuffer(b"".join(parts), "<u4"), block, bits)
            row = {"shard": shard, "chunk": number, "before": before, "n_ids": held, "doc_ids": list(doc_ids), "sizes": list(sizes), "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                doc_ids.append(doc_id)
                sizes.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
                if held >= chunk:
                    yield closed()
                    number, before, held = number + 1, before + held, 0
                    doc_ids.clear(), sizes.clear(), parts.clear()
        if parts:
            yield closed()

    placed.mapInArrow(write, _CHUNKS).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    # one row per shard, that is per writing task
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).write.parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian u32 bytes) of every document."""
    return _read(spark, path, "ids binary", lambda ids: ids)


def read_token_sums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, counted where its ids are read."""
    return _read(spark, path, "ids_crc32 long", zlib.crc32)


def _read(spark: SparkSession, path: str, column: str, made_of) -> DataFrame:
    prepare(spark)
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    shards = spark.read.schema("shard int, shard_start long").parquet(f"{path}/shards")

    name = column.split()[0]

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for first, doc_ids, sizes, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpack_ids(payload).tobytes()
                ends = np.cumsum(sizes)
                starts = ends - np.asarray(sizes)
                made = [made_of(ids[4 * s:4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(sizes, pa.int64()), pa.array(made)],
                    names=["doc_id", "start", "n_tokens", name],
                )

    placed = chunks.join(shards, "shard").select((F.col("shard_start") + F.col("before")).alias("first"), "doc_ids", "sizes", "payload")
    return placed.mapInArrow(read, f"doc_id long, start long, n_tokens long, {column}")


def new_path(spark: SparkSession) -> str:
    """A new place for a file set in the cluster's shared folder."""
    return f"{scratch_folder(spark)}/acclaim/token-files-{uuid.uuid4().hex}"
