"""Encoder, packing, token files and edit-aware counts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from acclaim.llm import editcounts, packing, planes
from acclaim.llm.tokens import TextEncoder, encoder

PIECES = st.sampled_from([" ", "  ", "\n", "\t", " ", "ab", "Don't", "é", "漢", "12", "½", "_", "😀", ".", "'s", "\x1c", "word", "<|endoftext|>"])


def ids_of(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_chunked_encoding_equals_the_library(text):
    from tokenizers import Tokenizer

    from acclaim.llm.queries import BYTE_BPE, vocabulary_path

    path = vocabulary_path(BYTE_BPE)
    if not hasattr(test_chunked_encoding_equals_the_library, "whole"):
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        test_chunked_encoding_equals_the_library.whole = whole
    whole = test_chunked_encoding_equals_the_library.whole
    assert ids_of(encoder(path).encode(text)) == whole.encode(text, add_special_tokens=False).ids


def test_small_caches_change_nothing(vocabulary, tokenizer, odd_rows):
    small = TextEncoder(vocabulary, cached=2)
    for _, text, _ in odd_rows:
        assert ids_of(small.encode(text or "")) == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_plan_uses_every_piece_once_and_fills_gaps():
    pick = np.random.default_rng(5)
    for n in (0, 1, 7, 400, 5000):
        lengths = np.clip(pick.lognormal(5.5, 1.2, n).astype(int), 1, 2048)
        histogram = np.bincount(lengths, minlength=2049)
        used = np.zeros(2049, int)
        sequences = 0
        for pattern, times in packing.packing_plan(histogram):
            assert times > 0 and sum(pattern) <= 2048
            sequences += times
            for length in pattern:
                used[length] += times
        assert (used == histogram).all()
        assert sequences <= -(-int(lengths.sum()) // 2048) + max(2, n // 50)


def test_complement_needs_enough_pieces():
    counts = np.zeros(11, np.int64)
    counts[5] = 1
    assert packing.complement(counts, 10) is None and packing.complement(counts, 5) == [5]
    counts[5] = 2
    assert packing.complement(counts, 10) == [5, 5]
    counts[:] = 0
    counts[2], counts[6] = 2, 1
    assert sorted(packing.complement(counts, 10)) == [2, 2, 6]
    counts[2] = 1
    assert packing.complement(counts, 10) is None


def test_packing_of_odd_rows(odd_docs, odd_rows, vocabulary, tokenizer):
    capacity = 256
    rows = packing.pack_documents(odd_docs, vocabulary, capacity).collect()
    want = Counter()
    for doc_id, text, _ in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_of_nothing(no_docs, vocabulary):
    assert packing.pack_documents(no_docs, vocabulary).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans(), st.integers(1, 70))
def test_planes_round_trip(ids, bits, block):
    ids = np.array(ids, "<u4")
    chunk = planes.pack_ids(ids, block, bits)
    assert (planes.unpack_ids(chunk) == ids).all()
    if ids.size > block:
        assert (planes.unpack_ids(chunk, range(1, 2)) == ids[block:2 * block]).all()


def test_token_files_of_odd_rows(spark, odd_docs, odd_rows, vocabulary, tokenizer):
    for bits in (False, True):
        path = planes.new_path(spark)
        planes.write_token_files(odd_docs, path, vocabulary, block=64, chunk=500, bits=bits)
        rows = sorted(planes.read_token_files(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted((d for d, *_ in odd_rows if d is not None)) + [None]
        at = 0
        for r in rows:
            assert r.start == at
            at += len(r.ids) // 4
        want = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for d, t, _ in odd_rows)
        assert Counter((r.doc_id, tuple(ids_of(r.ids))) for r in rows) == want


def test_token_files_of_nothing(spark, no_docs, vocabulary):
    path = planes.new_path(spark)
    planes.write_token_files(no_docs, path, vocabulary)
    assert planes.read_token_files(spark, path).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join), st.lists(st.tuples(st.integers(-5, 120), st.integers(-1, 60), st.lists(PIECES, max_size=4).map("".join)), max_size=5))
def test_edits_keep_counts_right(text, edits):
    from acclaim.llm.queries import BYTE_BPE, vocabulary_path

    encode = encoder(vocabulary_path(BYTE_BPE)).encode
    count = lambda s: len(encode(s)) // 4
    segments = editcounts.segments_of(text, 8)
    assert "".join(segments) == text
    tree = editcounts.CountTree(segments, [count(s) if s else 0 for s in segments], count)
    for at, remove, insert in edits:
        tree.edit(at, remove, insert)
        at = min(max(at, 0), len(text))
        text = text[:at] + insert + text[at + max(remove, 0):]
        assert "".join(tree.segments) == text
        assert tree.tokens[1] == count(text) and tree.chars[1] == len(text)


def test_edit_counts_of_odd_rows(spark, odd_docs, odd_rows, no_docs, vocabulary, tokenizer):
    from pyspark.sql import functions as F

    trees = editcounts.count_trees(odd_docs, vocabulary)
    edits = F.when(F.col("doc_id") != 7, F.array(
        F.struct(F.lit(3).alias("at"), F.lit(2).alias("remove"), F.lit("new ").alias("insert")),
        F.struct(F.lit(9000).alias("at"), F.lit(5).alias("remove"), F.lit(None).cast("string").alias("insert")),
    ))
    out = editcounts.apply_edits(trees.withColumn("edits", edits), vocabulary).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        text = "".join(r.segments)
        assert r.n_tokens == sum(r.segment_tokens) == len(tokenizer.encode(text, add_special_tokens=False).ids)
        if r.doc_id == 5:
            assert r.encoded_chars < 2000
    assert editcounts.count_trees(no_docs, vocabulary).collect() == []
