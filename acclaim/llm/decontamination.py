"""Benchmark decontamination by winnowing.

Of the hashed word k-grams in every run of w neighbouring k-grams the smallest one (the last of
equal ones) is kept.  Two texts that share k + w - 1 consecutive words keep the same k-gram inside
that span, so with k + w - 1 equal to the window length no shared window is missed.  Kept
fingerprints of documents and benchmark items meet in a join, and each meeting is extended word by
word, on the words themselves, as far as a window can reach.

Items shorter than a window are windows of their own length; documents are winnowed once more for
each such length that occurs, with a smaller k where needed.

Defined results: null texts have no words; an item without words is no window; repeated benchmark
rows count once per item_id; a null item_id never counts as an item but its windows hit; repeated
documents give one row each; extra columns are ignored; an empty table gives no rows, an empty
benchmark no hits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acclaim.llm.common import KEY, by_size, mixed, parted, prepare, row_key, span_hashes, stage

WINDOW = 13
GRAM = 5
#: a document is contaminated from one hit word in this many words
SHARE = 20
#: bits of the set that says which document fingerprints may have a partner; false ones only cost join rows
FILTER_BITS = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# digits, small letters after lowering, and every byte of a character beyond ASCII
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


class Words:
    """The words of several texts, found and hashed in one sweep over their bytes."""

    def __init__(self, texts: list[str | None]):
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        # one separator after each text keeps words of neighbours apart
        data = _LOWER[np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)]
        inside = np.zeros(data.size + 2, dtype=np.int8)
        inside[1:-1] = _IN_WORD[data]
        edges = np.flatnonzero(np.diff(inside))
        self.data, self.start, self.end = data.tobytes(), edges[::2], edges[1::2]
        text_ends = np.cumsum([len(e) + 1 for e in encoded]) if encoded else np.zeros(0, np.int64)
        self.text = np.searchsorted(text_ends, self.start, side="right")
        self.counts = np.bincount(self.text, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.hashes = span_hashes(data, self.start, self.end)

    def word(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].decode("utf-8", "surrogatepass")

    def winnow(self, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the kept k-grams; every run of w k-grams inside a text keeps its smallest, rightmost one."""
        n = self.hashes.size - k + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams = grams * np.uint64(0xD6E8FEB86659FD93) + self.hashes[j:j + n]
        grams = mixed(grams) | np.uint64(1)
        crossing = self.text[:n] != self.text[k - 1:]
        grams[crossing] = np.uint64(2**64 - 1)
        if n < w:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        best = grams[: n - w + 1].copy()
        where = np.arange(n - w + 1)
        for j in range(1, w):
            other = grams[j:j + n - w + 1]
            better = other <= best
            best[better] = other[better]
            where[better] = np.flatnonzero(better) + j
        kept = np.unique(where)
        kept = kept[~crossing[kept]]
        return kept, grams[kept]


def _parameters(length: int, gram: int) -> tuple[int, int]:
    k = min(gram, length)
    return k, length - k + 1


def _prints(words: Words, length: int, gram: int, only: np.ndarray | None) -> dict[int, list[tuple]]:
    """Kept k-grams by text, each with the words a window through it can reach and the k-gram's place among them."""
    k, w = _parameters(length, gram)
    at, hashes = words.winnow(k, w)
    if only is not None and at.size:
        bits = (hashes >> np.uint64(32)) % np.uint64(8 * only.size)
        has = (only[(bits >> np.uint64(3)).astype(np.int64)] >> (bits & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        at, hashes = at[has.astype(bool)], hashes[has.astype(bool)]
    found: dict[int, list[tuple]] = {}
    for a, h in zip(at.tolist(), hashes.astype(np.int64).tolist()):
        t = int(words.text[a])
        low, high = int(words.first[t]), int(words.first[t + 1])
        left, right = max(low, a - (length - k)), min(high, a + length)
        found.setdefault(t, []).append((length, h, a - low, [words.word(i) for i in range(left, right)], a - left))
    return found


def benchmark_prints(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per kept k-gram of each item: item_id, length, hash, the words around it, the k-gram's place among them."""

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            items, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = Words(texts)
            rows = []
            for length in sorted({int(min(c, window)) for c in words.counts if c}):
                for t, prints in _prints(words, length, gram, None).items():
                    if min(int(words.counts[t]), window) == length:
                        rows += [(items[t], *p) for p in prints]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32())
            names = ["item_id", "length", "hash", "at", "words", "reach"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropDuplicates()
    return items.mapInArrow(kept, "item_id string, length int, hash long, at int, words array<string>, reach int")


def document_prints(docs: DataFrame, lengths: list[int], gram: int, only: bytes, keep: list[str]) -> DataFrame:
    """One row per document: the kept columns, n_words, and its kept k-grams that may have a partner."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(only)
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def scan(batches):
        import pyarrow as pa

        bits = np.frombuffer(shared.value, dtype=np.uint8)
        names = ("length", "hash", "at", "words", "reach")
        print_type = pa.struct(list(zip(names, (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32()))))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts: list[int] = []
            prints: list[list] = [[] for _ in texts]
            for low, high in by_size(texts):
                words = Words(texts[low:high])
                counts += words.counts.tolist()
                for length in lengths:
                    for t, found in _prints(words, length, gram, bits).items():
                        prints[low + t] += [dict(zip(names, p)) for p in found]
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(prints, pa.list_(print_type))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "prints"])

    prints = "array<struct<length:int,hash:bigint,at:int,words:array<string>,reach:int>>"
    return docs.select(*keep, "text").mapInArrow(scan, f"{schema}, n_words long, prints {prints}")


def _extend(batches):
    """Longest equal run of words through the meeting k-grams; hits are runs of at least a window."""
    import pyarrow as pa

    for batch in batches:
        doc, item, length, at, ours, our_place, theirs, their_place = (c.to_pylist() for c in batch.columns)
        rows = []
        for i in range(batch.num_rows):
            a, b, p, q = ours[i], theirs[i], our_place[i], their_place[i]
            left = 0
            while left < min(p, q) and a[p - left - 1] == b[q - left - 1]:
                left += 1
            right = 0
            while right < min(len(a) - p, len(b) - q) and a[p + right] == b[q + right]:
                right += 1
            if left + right >= length[i]:
                rows.append((doc[i], item[i], at[i] - left, at[i] + right))
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["_row", "item_id", "first", "past"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, share: int = SHARE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_words, n_hit, items (array of item_ids, sorted), contaminated."""
    spark = docs.sparkSession
    items = stage(benchmark_prints(benchmark, window, gram), "benchmark-prints")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most `window` numbers
    # a set of bits of fixed size, whatever the benchmark holds
    bit = F.pmod(F.shiftrightunsigned("hash", 32), F.lit(FILTER_BITS)).cast("int")
    only = np.zeros(FILTER_BITS, dtype=bool)
    only[[r["bit"] for r in items.select(bit.alias("bit")).distinct().collect()]] = True
    packed = np.packbits(only, bitorder="little").tobytes()
    scanned = document_prints(docs, lengths, gram, packed, list(keep)).withColumn("_row", F.monotonically_increasing_id())
    scanned = stage(scanned, "document-prints")
    ours = scanned.select("_row", F.explode("prints").alias("p")).select("_row", "p.length", "p.hash", "p.at", F.col("p.words").alias("ours"), F.col("p.reach").alias("our_place"))
    theirs = items.select("length", "hash", "item_id", F.col("words").alias("theirs"), F.col("reach").alias("their_place"))
    met = ours.join(theirs, ["hash", "length"]).select("_row", "item_id", "length", "at", "ours", "our_place", "theirs", "their_place")
    hits = stage(met.mapInArrow(_extend, "_row long, item_id string, first int, past int").distinct(), "hits")
    n_hit = (
        hits.select("_row", "first", "past").distinct()
        .select("_row", F.explode(F.sequence("first", F.col("past") - 1)).alias("word")).distinct()
        .groupBy("_row").agg(F.count("*").alias("n_hit"))
    )
    found = hits.filter("item_id is not null").select("_row", "item_id").distinct().groupBy("_row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    judged = scanned.select("_row", *keep, "n_words").join(n_hit, "_row", "left").join(found, "_row", "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return judged.select(
        *keep, "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
    )


_BAD = "_acclaim_contaminated"


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    keyed = row_key(docs)
    bad = stage(contamination(keyed, benchmark, keep=(KEY,), **options).filter("contaminated").select(KEY).distinct(), "contaminated")
    clean, others = parted(keyed, bad)
    # an anti join would be pushed below and move every text
    innocent = others.join(bad.withColumn(_BAD, F.lit(True)), KEY, "left").filter(F.col(_BAD).isNull()).drop(_BAD)
    return clean.unionByName(innocent).select(*docs.columns)
