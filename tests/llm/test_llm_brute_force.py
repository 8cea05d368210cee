"""Models and fingerprints against plain versions that share no code with the operators."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from acclaim.llm import langid, lzprint, mixing
from acclaim.llm.common import remainder
from test_llm_near_and_shared_text import brute_contamination, brute_simhash, components
from texts import prose

# --- phrase fingerprints ---------------------------------------------------------------

WORD = (1 << 64) - 1


def plain_hash(phrase):
    h = sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(phrase)) & WORD
    h ^= h >> 31
    h = h * 0xBF58476D1CE4E5B9 & WORD
    h ^= h >> 29
    h = h * 0x94D049BB133111EB & WORD
    return h ^ (h >> 32)


def plain_print(text):
    phrases, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in phrases:
            phrases.add(phrase)
            phrase = ""
    return sorted({plain_hash(p) >> 32 for p in phrases})[:128]


def plain_likeness(a, b):
    if not a and not b:
        return 1.0
    union = sorted({*a, *b})[:128]
    return sum(h in a and h in b for h in union) / len(union)


def test_fingerprints_equal_the_plain_ones(odd_docs, odd_rows):
    ordered = sorted(((d, t or "") for d, t, _ in odd_rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        n = len(text)
        edited = text[:n - n // 3] + following[:n // 3]
        own, other, after = plain_print(text), plain_print(edited), plain_print(following)
        shown = lambda hashes: "".join(f"{h:08x}" for h in hashes)
        want[doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(other), round(plain_likeness(own, other), 9), round(plain_likeness(own, after), 9)] += 1
    got = Counter(
        (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
        for r in lzprint.neighbour_fingerprints(odd_docs).collect()
    )
    assert got == want


# --- language identification -----------------------------------------------------------


class PlainKneserNey:
    """Interpolated Kneser-Ney over the characters of words, by dictionaries of strings."""

    def __init__(self, words, order):
        self.order, self.counts = order, {}
        counts = Counter()
        for word in words:
            padded = "\x02" * (order - 1) + word + "\x03"
            counts.update(padded[i - order + 1:i + 1] for i in range(order - 1, len(padded)))
        for n in range(order, 0, -1):
            self.counts[n] = counts
            counts = Counter(gram[1:] for gram in counts)
        self.discounts = {}
        for n, c in self.counts.items():
            once, twice = (sum(v == x for v in c.values()) for x in (1, 2))
            self.discounts[n] = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
        self.after = {n: defaultdict(list) for n in self.counts}
        for n, c in self.counts.items():
            for gram, v in c.items():
                self.after[n][gram[:-1]].append(v)

    def p(self, gram):
        if not gram:
            return 1 / langid.ALPHABET
        n, lower = len(gram), self.p(gram[1:])
        if not (seen := self.after[n].get(gram[:-1])):
            return lower
        return (max(self.counts[n][gram] - self.discounts[n], 0) + self.discounts[n] * len(seen) * lower) / sum(seen)

    def bits(self, words):
        total = n = 0
        for word in words:
            padded = "\x02" * (self.order - 1) + word + "\x03"
            for i in range(self.order - 1, len(padded)):
                total, n = total - math.log2(self.p(padded[i - self.order + 1:i + 1])), n + 1
        return total / n


def test_languages_equal_plain_kneser_ney(spark):
    order, languages = langid.ORDER, ["en", "fr"]
    fitted = {lang: " ".join(prose(s, 30, lang) for s in range(5)).split() for lang in languages}
    lang, grams, contexts = [], [[] for _ in range(order)], [[] for _ in range(order)]
    for i, name in enumerate(languages):
        g, x, word = langid._gram_hashes([w.encode() for w in fitted[name]], order)
        lang += [i] * word.size
        for n in range(order):
            grams[n] += g[n].tolist()
            contexts[n] += x[n].tolist()
    _, first, times = np.unique(np.array([lang, grams[-1]], np.uint64), axis=1, return_index=True, return_counts=True)
    dealt = lambda columns: [np.array(c, np.uint64)[first] for c in columns]
    model = langid.kneser_ney(np.array(lang)[first], times, dealt(grams), dealt(contexts), languages)
    plain = [PlainKneserNey(fitted[name], order) for name in languages]
    texts = [prose(50 + i, 8, languages[i % 2]) for i in range(10)] + ["zzz quark", "thé", "e", "où the", "漢字 riverside"]
    rows = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(rows) == len(texts)
    for row in rows:
        bits = [p.bits(texts[row.doc_id].split()) for p in plain]
        assert row._bits == pytest.approx(min(bits), rel=1e-5)
        if abs(bits[0] - bits[1]) > 1e-4:
            assert row.lang_pred == languages[int(np.argmin(bits))]


# --- context mixing --------------------------------------------------------------------


def test_kinds_count_every_training_text(spark):
    texts = [prose(i, 20 + i, "fr" if i % 3 else "en") for i in range(60)] + [None, "", "a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    start = mixing.seeded_kinds(docs, 2, seed_texts=4)
    table, members = np.zeros((2, 1 << 16)), np.zeros(2)
    for t in texts:
        data = (t or "").lower().encode()
        pairs = [a * 256 + b for a, b in zip(data, data[1:])]
        kind = int(np.argmax([start.log_prior[k] + sum(float(start.log_p[p, k]) for p in pairs) for k in range(2)]))
        members[kind] += 1
        for p in pairs:
            table[kind, p] += 1
    settled = mixing.corpus_kinds(docs, start)
    assert np.allclose(settled.log_prior, np.log((members + 1) / (members + 1).sum()))
    smooth = 50 * table.sum(axis=0) / table.sum() + 0.01
    used = table.sum(axis=0) > 0
    want = (table + smooth)[:, used] / (table + smooth)[:, used].sum(axis=1, keepdims=True)
    want /= 1 + 1e-6 * np.count_nonzero(~used)  # a pair that no text has is held possible, too
    assert np.allclose(np.exp(settled.log_p.T[:, used]), want, rtol=1e-4)


def test_spelling_learns_from_every_once_seen_token(spark, monkeypatch):
    """Groups add up to what plain learning of the same groups gives, whatever the partitions."""
    monkeypatch.setattr(mixing, "GROUP_BYTES", 300)
    tokens = sorted({w.encode() + bytes([97 + i % 26]) for i in range(40) for w in prose(i, 3).split()})
    rows = [(t, 1 + (i % 4 == 0)) for i, t in enumerate(tokens)]
    vocabulary = spark.createDataFrame([(bytearray(t), n) for t, n in rows], "token binary, trained long").repartition(4)
    counts = mixing.corpus_counts(vocabulary)
    plain = np.zeros_like(counts)
    mixing.count_bits(plain, tokens)
    assert (counts == plain).all()
    once = [t for t, n in rows if n == 1]
    size = sum(map(len, once))
    learned = mixing.learned_mixer(counts, vocabulary, size)
    groups = defaultdict(list)
    for t, h in vocabulary.filter("trained = 1").select("token", F.xxhash64(F.lit(6), "token")).collect():
        groups[h % (size // 300 + 1)].append((h, bytes(t)))
    assert len(groups) > 1 and sum(map(len, groups.values())) == len(once)
    weights = seen = 0
    for held in groups.values():
        mixer = mixing.Mixer.of(counts, left_out=True)
        mixer.learn([t for _, t in sorted(held)], 0.05, 0.1)
        weights, seen = weights + mixer.weights * mixer.visits[:, None], seen + mixer.visits[:, None]
    used = seen[:, 0] > 0
    assert np.allclose(learned.weights[used], weights[used] / seen[used]) and np.allclose(learned.weights[~used], 0.2)


def test_ways_equal_plain_expectation_maximisation(spark):
    vocabulary = [(b"the", [(0, 30), (1, 5)], -2.0), (b"la", [(1, 20)], -2.5), (b"zq", [(0, 1)], -9.0), (b"far", [(0, 1), (1, 1)], -400.0), (b"new", [], -5.0)]
    rows = [(bytearray(t), sum(n for _, n in by), by, p) for t, by, p in vocabulary]
    scored = spark.createDataFrame(rows, "token binary, trained long, by_kind array<struct<kind:int,n:long>>, spelled_p double")
    of_kind = np.array([32.0, 26.0, 0.0])
    got = mixing.learned_ways(scored, 58, of_kind, rounds=3).shares
    want = [[0.85, 0.1, 0.05] for _ in of_kind]
    for _ in range(3):
        for kind in range(2):
            took = [0.0, 0.0, 0.0]
            for _, by, p in vocabulary:
                for k, n in by:
                    if k == kind:
                        parts = [want[kind][0] * (n - 1) / of_kind[kind], want[kind][1] * (sum(x for _, x in by) - 1) / 58, want[kind][2] * 10**p]
                        parts = parts if sum(parts) > 0 else [0, 0, 1]
                        took = [a + n * x / sum(parts) for a, x in zip(took, parts)]
            floor = [max(a / sum(took), 1e-3) for a in took]
            want[kind] = [a / sum(floor) for a in floor]
    assert np.allclose(got, want)


# --- pipeline --------------------------------------------------------------------------


def test_pipeline_equals_plain_stages(spark, odd_rows, tokenizer, tmp_path):
    passage = prose(777, 30) + " " + prose(778, 20, "fr")
    rows = [*odd_rows, (300, "river " + passage + " house", "en"), (301, prose(12, 900) + " " + passage[:60], "en"), (302, odd_rows[-1][1], "en"), (303, odd_rows[-1][1] + " ", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", passage), ("j", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    judged = langid.identify(docs, langid.fit(docs, remainder(F.col("doc_id"), 5) != 0), ("doc_id", "text")).collect()
    kept = [(r.doc_id, r.text) for r in judged if not r.rejected]
    assert {1, 2, 3, 4}.isdisjoint(d for d, _ in kept) and len(kept) > 40
    prints = {t: brute_simhash(t) for _, t in kept}
    label = components(sorted(set(prints.values())), 4)
    classes = defaultdict(list)
    for d, t in kept:
        classes[label[prints[t]]].append((d is None, d or 0, t))
    kept = [(None if null else d, t) for null, d, t in map(min, classes.values())]
    hit = {key[0] for key in brute_contamination(kept, [("i", passage), ("j", None)]) if key[4]}
    assert 300 in hit
    kept = {d: t for d, t in kept if d not in hit}
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == kept.keys()
    for d, parts in pieces.items():
        at = 0
        for i, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (i, at)
            at += length
        assert at == len(tokenizer.encode(kept[d], add_special_tokens=False).ids) + 1
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
