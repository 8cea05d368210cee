"""Exact top-k search, conversation repair and prefix tries against plain programs."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from acclaim.llm import prefixtrie, repair, topk
from acclaim.llm.queries import op12_structure_repair, op13_prefix_trie


def clashing(df):
    for name in ("row", "score", "rank", "pos", "part", "n", "digest", "block", "edge", "audit", "name", "v", "copy", "rep"):
        df = df.withColumn(name, F.lit("clash"))
    return df


# --- top-k ------------------------------------------------------------------------


def odd_vectors():
    pick = random.Random(5)
    rows = [(i, [pick.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(4)]) for i in range(160)]
    rows += [(200 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(60)]  # one very common vector
    rows += [(100, [0.3, 0.1, 0.2, 0.9]), (100, [0.3, 0.1, 0.2, 0.9]), (7, [1.0, 1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (300, None), (400, [1.0, None, 0.0, 0.0]), (401, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(500, [float("inf"), 0.0, 0.0, 0.0]), (600, [0.5, 0.5]), (601, [0.5, 1.0]), (700, []), (701, []), (-100, [0.1, 0.2, 0.3, 0.4])]
    rows += [(800, [1e300, 0.0, 0.0, 0.0]), (801, [3e15, -2e15, 1e12, 0.5]), (900, [-3e15, 2e15, 7.5, 1e14])]
    return rows


def brute_top_k(rows, k):
    whole = []
    for vec_id, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((vec_id, [max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * x))) for x in v]))
    out = []
    for i, (query, q) in enumerate(whole):
        if query is None or query % 100:
            continue
        scored = []
        for j, (vec_id, v) in enumerate(whole):
            if i != j and len(v) == len(q):
                score = max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(q, v))))
                scored.append((-score, vec_id is None, vec_id or 0, vec_id))
        out += [(query, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, block", [(10, 1 << 22), (3, 16)])
def test_top_k_equals_brute_force_with_ties_repeats_and_odd_vectors(spark, monkeypatch, k, block):
    monkeypatch.setattr(topk, "BLOCK_VALUES", block)
    rows = odd_vectors()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    found = topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 100 == 0, k)
    assert sorted([tuple(r) for r in found.collect()], key=repr) == brute_top_k(rows, k)


def test_top_k_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.whole_vectors(df), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(topk.whole_vectors(df.filter("false")), F.col("vec_id") % 100 == 0).count() == 0


# --- repair -----------------------------------------------------------------------


def plain_repair(rows):
    """(figures, repaired lines) of one conversation, row by row; rows are (turn, role, text)."""
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def filled(best):
        for _ in range(3):
            for (state, added), to in follow.items():
                if added != "s" and state in best:
                    cost, audit, lines = best[state]
                    new = (cost + 2, audit + "I", lines + [names[added] + ":"])
                    if to not in best or new < best[to]:
                        best[to] = new
        return best

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        best, after = filled(best), {}
        for state, (cost, audit, lines) in best.items():
            options = [(state, (cost + 3, audit + "D", lines))]
            if fault in ("", "truncated"):
                cut = fault == "truncated"
                for added in "sua":
                    to = follow.get((state, added))
                    if to and role[:1] == added:
                        options.append((to, (cost + cut, audit + "K", [*lines, f"{role}:{text}"])))
                    if to and added != "s":
                        options.append((to, (cost + 2 + cut, audit + "R", [*lines, f"{names[added]}:{text}"])))
            for to, option in options:
                if to not in after or option < after[to]:
                    after[to] = option
        best = after
    best = filled(best)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit), "\n".join(lines)


def random_rows(pick, n):
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "sage"]
    texts = ["Good.", "Good.", "Cut off", "", " \n", None, "Is it?", "漢字!", "end. \t"]
    return [(None if pick.random() < 0.05 else pick.randrange(n), pick.choice(roles), pick.choice(texts) if pick.random() < 0.5 else f"text {pick.random()}.") for _ in range(n)]


def repair_all(spark, rows):
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))
    found = repair.repairs(df)
    hashes = {r.conv_id: r.sha256 for r in repair.turn_digests(repair.repaired_turns(df, found)).collect()}
    return {r.conv_id: (tuple(r)[1:], hashes.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in found.collect()}


def test_repairs_equal_the_plain_programme_also_across_ranges(spark):
    pick = random.Random(3)
    by_conv = {c: random_rows(pick, pick.randrange(1, 9)) for c in range(60)}
    by_conv[None] = random_rows(pick, 6)
    by_conv[1000] = random_rows(pick, 700)  # most of all rows: lies in several ranges
    by_conv[1001] = [(3, "user", "The same.")] * 300 + [(None, "assistant", "x")]
    by_conv[1002] = [(i, "user", f"{i}.") for i in range(200)] + [(i, "assistant", f"{i}.") for i in range(200, 333)]
    rows = [(c, *r) for c, part in by_conv.items() for r in part]
    got = repair_all(spark, rows)
    assert set(got) == set(by_conv)
    for c, part in by_conv.items():
        figures, lines = plain_repair(part)
        assert got[c] == (figures, hashlib.sha256(lines.encode()).hexdigest()), c


def test_runs_of_equal_symbols_unroll_like_single_rows():
    pick = random.Random(8)
    for _ in range(200):
        runs = [(pick.randrange(9), pick.choice([1, 2, 3, 7, 20])) for _ in range(pick.randrange(1, 5))]
        single = [(sym, 1) for sym, n in runs for _ in range(n)]
        for state in repair.STATES:
            assert repair.unroll(runs, state, repair.AT_END) == repair.unroll(single, state, repair.AT_END)
    assert repair._cost([(1 + 2 * 1, 1 << 30)]) == 1 << 30  # of a billion users every second one becomes an assistant


def test_damage_and_missing_conversations(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}. Really? Yes!") for c in range(80) for t in range(3)]
    rows += [(None, None, None, None), (500, None, "user", "Hm."), (501, 2, None, None)]
    clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op12_structure_repair(spark, str(tmp_path)).collect()}
    damaged = defaultdict(list)
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        damaged[conv_id] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv_id, part in damaged.items():
        figures, lines = plain_repair(part)
        r = got.pop(conv_id)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == figures
        assert r.repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()
    assert not got
    assert repair_all(spark, []) == {}


# --- prefix trie ------------------------------------------------------------------


def plain_trie(rows):
    by_conv = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            by_conv[conv_id].append(((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest()), (role, text)))
    original = {c: [t for _, t in sorted(part)] for c, part in by_conv.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(math.fmod(c, 20))
        seq = tuple(original.get(c - base, [])[:h] + own[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    words = lambda t: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w])
    children, total, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for seq in members:
        if seq:
            children[seq[:-1]] += 1
    for seq, who in members.items():
        for d in range(len(seq) + 1):
            total[seq[:d]] += (len(who) - 1) * words(seq[-1][1]) if seq else 0
            leaves[seq[:d]] += seq not in children
    return {
        (min(who), len(seq), min(members[seq[:-1]]) if seq else None, len(who), children.get(seq, 0), leaves[seq], total[seq],
         hashlib.sha256(",".join(map(str, sorted(ends.get(seq, [])))).encode()).hexdigest())
        for seq, who in members.items()
    }


def trie_of(spark, rows, folder):
    clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).write.parquet(f"{folder}/conversations.parquet")
    found = [tuple(r) for r in op13_prefix_trie(spark, str(folder)).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_trie_equals_the_plain_one(spark, tmp_path):
    pick = random.Random(11)
    rows = []
    for c in [*range(-25, 90), 1 << 40]:
        if c != 20:
            for t in range(pick.choice([0, 1, 1, 2, 3, 5, 9])):
                rows.append((c, None if pick.random() < 0.1 else t, pick.choice(["user", "assistant", None]), pick.choice(["a b", "a  b\tc", "", None, "ab c"])))
    rows += [(200, 0, "user", "x")] * 3 + [(None, 0, "user", "lost")]
    # two long ones that part after 170 turns, and one that ends inside them
    for c, n in ((300, 300), (301, 333), (302, 150)):
        rows += [(c, t, "user", f"turn {t if t < 170 else t * c}") for t in range(n)]
    assert trie_of(spark, rows, tmp_path) == plain_trie(rows)


def test_trie_of_turnless_conversations_and_of_nothing(spark, tmp_path):
    turnless = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1][:3]  # no conversation 20 to open them
    rows = [(c, 0, "user", "only turn") for c in turnless]
    assert trie_of(spark, rows, tmp_path / "turnless") == plain_trie(rows)
    assert trie_of(spark, [], tmp_path / "none") == set()
