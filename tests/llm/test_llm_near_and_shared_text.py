"""Phrase fingerprints, decontamination, SimHash classes, license lookup."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from acclaim.llm import decontamination, licenses, lzprint, simhash

from texts import prose


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- phrase fingerprints ------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text("abé漢", max_size=80), st.text("ab", max_size=40), st.integers(0, 80))
def test_reparsed_text_has_its_own_signature(text, ending, keep):
    keep = min(keep, len(text))
    other, changed = lzprint.Parsed(text, 128).edited(keep, ending)
    assert other == text[:keep] + ending
    assert (changed == lzprint.Parsed(other, 128).signature).all()


def test_likeness_follows_shared_phrases():
    a = lzprint.Parsed(prose(1, 400), 128)
    b = lzprint.Parsed(prose(1, 300) + prose(2, 100), 128)
    c = lzprint.Parsed("zyx wvu " * 200, 128)
    nothing = lzprint.Parsed("", 128)
    assert lzprint.likeness(a.signature, a.signature) == 1.0
    assert lzprint.likeness(a.signature, b.signature) > lzprint.likeness(a.signature, c.signature)
    assert lzprint.likeness(nothing.signature, nothing.signature) == 1.0 and lzprint.likeness(nothing.signature, a.signature) == 0.0


def test_neighbour_fingerprints_of_odd_rows(odd_docs, odd_rows, no_docs):
    rows = lzprint.neighbour_fingerprints(odd_docs).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for (doc_id, text, _), (_, following, _) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        n = len(text)
        edited = text[: n - n // 3] + following[: n // 3]
        want[doc_id, n, hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].fingerprint == by_id[7].fingerprint and by_id[1].fingerprint == by_id[2].fingerprint == ""
    assert lzprint.neighbour_fingerprints(no_docs).collect() == []
    one = odd_docs.filter("doc_id = 12")
    assert lzprint.neighbour_fingerprints(one).first().near_next == 1.0


# --- decontamination -----------------------------------------------------------------


def brute_contamination(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = [(i, tuple(w[p:p + min(window, len(w))])) for i, t in set(items) if (w := word.findall(lower(t))) for p in range(len(w) - min(window, len(w)) + 1)]
    out = Counter()
    for doc_id, text in docs:
        w = word.findall(lower(text))
        hit, found = set(), set()
        for item, part in windows:
            for p in range(len(w) - len(part) + 1):
                if tuple(w[p:p + len(part)]) == part:
                    hit.update(range(p, p + len(part)))
                    found.add(item)
        out[doc_id, len(w), len(hit), tuple(sorted(f for f in found if f is not None)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def contamination_rows(spark, docs, items):
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_words string").repartition(2)
    bench = spark.createDataFrame(items, "item_id string, text string")
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontamination.contamination(frame, bench).collect())


def test_contamination_against_brute_force(spark):
    pick = random.Random(3)
    few = ["a", "b", "C", "d1", "é"]
    text = lambda n, words=few: pick.choice([" ", ", ", "\n"]).join(pick.choice(words) for _ in range(n))
    rich = [f"w{i}" for i in range(60)]
    items = [("short", "a b C"), ("one", "zebra"), ("twelve", text(12)), ("exact", text(13)), ("long", text(40, rich)), ("other", text(30, rich)),
             ("none", " ..! "), ("null", None), (None, text(20, rich)), ("again", text(25, rich))]
    items += [items[4], ("copy", items[4][1])]
    docs = [(i, text(pick.randrange(0, 60))) for i in range(12)]
    docs += [(20, text(30, rich) + " " + items[4][1] + " " + text(30, rich)), (21, items[5][1].upper()), (22, "x " + items[8][1]), (23, None), (24, ""),
             (25, " ".join(items[4][1].split()[5:18])), (25, " ".join(items[4][1].split()[5:17])), (26, items[1][1]), (None, items[3][1]), (27, text(900, rich) + " " + items[9][1])]
    assert contamination_rows(spark, docs, items) == brute_contamination(docs, items)


def test_contamination_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    items = [("i", prose(12, 4) + " " + prose(4, 700)[:200]), ("j", prose(1, 60)), ("k", "word")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontamination.contamination(odd_docs, bench).collect())
    assert got == brute_contamination([(d, t) for d, t, _ in odd_rows], items)
    assert decontamination.contamination(no_docs, bench).collect() == []
    clean = decontamination.contamination(odd_docs, bench.filter("false")).collect()
    assert len(clean) == len(odd_rows) and not any(r.contaminated for r in clean)
    kept = decontamination.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    bad = {k[0] for k in got if k[4]}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, *_ in odd_rows if d not in bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=13, max_size=60), st.lists(st.integers(0, 4), max_size=60), st.integers(0, 40))
def test_winnowing_keeps_a_gram_in_every_shared_window(shared, rest, at):
    spell = lambda xs: " ".join("w%d" % x for x in xs)
    one, two = spell(shared), spell(rest[:at] + shared + rest[at:])
    a, b = decontamination.Words([one]).winnow(5, 9), decontamination.Words([two, "w9"]).winnow(5, 9)
    for p in range(len(shared) - 12):
        inside = {int(h) for x, h in zip(*a) if p <= x <= p + 8}
        q = min(at, len(rest)) + p
        assert inside & {int(h) for x, h in zip(*b) if q <= x <= q + 8}


# --- SimHash -------------------------------------------------------------------------


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for p in prints:
            for q in prints:
                if (p ^ q).bit_count() <= radius and label[q] < label[p]:
                    label[p] = label[q]
                    changed = True
    return label


def test_simhash_of_odd_rows(odd_docs, odd_rows, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    prints = {t: brute_simhash(t) for _, t, _ in odd_rows}
    assert Counter((r.doc_id, r.print & (2**64 - 1)) for r in rows) == Counter((d, prints[t]) for d, t, _ in odd_rows)
    label = components(sorted(set(prints.values())), 4)
    least = {}
    for d, t, _ in odd_rows:
        if d is not None:
            least[label[prints[t]]] = min(d, least.get(label[prints[t]], d))
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter((d, least.get(label[prints[t]])) for d, t, _ in odd_rows)
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert len(kept.collect()) == len(set(label.values()))
    assert {r.doc_id for r in kept.collect()} >= {5, 8, 12} and 7 not in {r.doc_id for r in kept.collect()}


def test_links_connect_all_classes(spark):
    """Chains and dense clouds of fingerprints, through small shards."""
    pick = random.Random(8)
    prints = [pick.getrandbits(64) for _ in range(600)]
    for centre in prints[:6]:
        p = centre
        for _ in range(60):  # a chain
            for b in pick.sample(range(64), pick.choice([2, 3, 4])):
                p ^= 1 << b
            prints.append(p)
        prints += [centre ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) for _ in range(60)]  # a cloud
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "print long").repartition(4)
    edges = simhash.links(table, shard=16)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in edges.collect())
    got = {r.node: r.label for r in simhash.classes(edges).collect()}
    # brute force by union-find
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 4):
            parent[find(i)] = find(i + 1 + int(j))
    groups = {}
    for i, p in enumerate(signed):
        groups.setdefault(find(i), []).append(p)
    for members in groups.values():
        assert {got.get(p, p) for p in members} == {min(members)}


# --- licences ------------------------------------------------------------------------


def test_license_scan(spark, odd_docs, odd_rows, no_docs):
    mit = licenses.KNOWN_TEXTS[0][1]
    noisy = "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper().replace(".", " .  ").replace("'", "’")
    texts = [(1, mit), (2, noisy), (3, mit + " and more"), (4, None), (5, ""), (6, "Copyright 1999 X"), (7, "a line\nReleased under the MIT Licence\nb\nreleased under the mit license."),
             (7, "a line\nReleased under the MIT Licence\nb\nreleased under the mit license.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter((r.doc_id, r.license, r.line_licenses, r.n_license_lines, r.digest is None) for r in licenses.scan(docs, licenses.known_digests(spark)).collect())
    assert got == Counter({(1, "MIT", "", 0, False): 1, (2, "MIT", "", 0, False): 1, (3, None, "", 0, False): 1, (4, None, "", 0, True): 1, (5, None, "", 0, True): 1,
                           (6, None, "", 0, True): 1, (7, None, "MIT", 2, False): 2})
    known = licenses.known_digests(spark, spark.createDataFrame([("own", "My  own, text")], "license string, text string"))
    assert licenses.scan(spark.createDataFrame([(1, "my own text!")], "doc_id long, text string"), known).first().license == "own"
    assert len(licenses.scan(odd_docs, known).collect()) == len(odd_rows)
    assert licenses.scan(no_docs, known).collect() == []
