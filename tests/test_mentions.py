"""Golden rows and properties of sentence, marker, year and author extraction."""

import pytest
from pyspark.sql import functions as F

from acclaim.operators import markers as M
from acclaim.operators.authors import add_author_mentions
from acclaim.operators.sentences import split_sentences
from acclaim.operators.years import add_year_mentions
from acclaim.sources.lexicon import default_lexicon, default_phrases, read_lexicon


def rows(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id bigint, sent_idx int, text string")


def by_doc(df, column):
    return [r[column] for r in df.select("doc_id", column).orderBy("doc_id").collect()]


def test_split_sentences(spark):
    text = (
        "Smith et al. (2010) first reported it [1]. See Fig. 3 for it.\n12\nNext\nline. 3.1 Heading goes here! Yes?\n"
        "中文句子。另一句！A. B. Smith did.\nReferences\n[1] Smith A. T [J]. J, 2010, 1(2): 3-4."
    )
    papers = spark.createDataFrame([(1, text)], "doc_id bigint, full_text string")
    got = split_sentences(papers).orderBy("sent_idx").collect()
    assert [r.text for r in got] == [
        "Smith et al. (2010) first reported it [1].", "See Fig. 3 for it.", "Next line.", "3.1 Heading goes here!",
        "中文句子。", "A. B. Smith did.",
    ]
    assert [r.sent_idx for r in got] == list(range(6))
    assert got[1].prev_sentence == got[0].text and got[0].next_sentence == got[1].text and got[0].prev_sentence == ""
    assert all(r.end_pos - r.start_pos == len(r.text) for r in got)


def test_gated_split_keeps_indexes(spark):
    papers = spark.createDataFrame([(1, "One here. Two first there. Three again.")], "doc_id bigint, full_text string")
    got = split_sentences(papers, keep="first", offsets=False).collect()
    assert [(r.sent_idx, r.prev_sentence, r.next_sentence) for r in got] == [(1, "One here.", "Three again.")]


MARKER_CASES = {
    "Smith et al. first reported it": [("first reported", False)],
    "proposed first reported": [("proposed", True), ("first reported", False)],
    "It was 首次提出 and First by x": [("首次提出", False), ("First", False)],
    "nothing here firsts": [],
    "since the first report of it": [("since the first report", False)],
}


def test_marker_hits_both_strategies(spark):
    table = rows(spark, *MARKER_CASES)
    for hit in (M.add_marker_hits(table), M.marker_hits_by_join(table, default_lexicon(spark))):
        got = {r.text: [(m.marker, m.is_bare_word) for m in r.markers] for r in hit.collect()}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in MARKER_CASES.items() if v}


def test_fast_path_equals_full_competition(spark):
    """The longest-phrase shortcut and the all-occurrences competition agree."""
    texts = list(MARKER_CASES) + [
        "for the first time seen first time work", "early studies first studies and since then", "最开始于首次报道里程碑式",
        "the earliest studies, original paper first paper back to the work",
    ]
    lexicon = M.Lexicon.default()
    assert lexicon.longest_wins()
    slow = M.Lexicon(lexicon.rows + (("first", "en", 0, False),))  # a rank that breaks the shortcut's premise
    assert not slow.longest_wins()
    full = M.with_once(rows(spark, *texts), "_low", M.ascii_lower(F.col("text")))
    full = M.with_once(full, "_occ", M._all_occurrences(lexicon)).withColumn("markers", M._finish_hits(F.col("text"), F.col("_occ")))
    assert by_doc(M.add_marker_hits(rows(spark, *texts)), "markers") == by_doc(full, "markers")


def test_hits_never_overlap_and_gate_is_exact(spark):
    texts = [a + " " + b for a in MARKER_CASES for b in MARKER_CASES]
    hit = M.add_marker_hits(rows(spark, *texts)).withColumn("gate", M.has_marker(F.col("text"))).collect()
    for r in hit:
        assert r.gate == bool(r.markers)
        assert all(r.text[m.start:m.end] == m.marker for m in r.markers)
        assert all(a.end <= b.start for a, b in zip(r.markers, r.markers[1:]))


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "lex.json").write_text(
        '{"english": ["first reported", "described", "first"], "chinese": ["首次"], "bare_words": ["described", "proposed"],'
        ' "self_citation_en": ["we"], "self_citation_cn": ["我们"]}', encoding="utf-8",
    )
    got = [tuple(r) for r in read_lexicon(spark, str(tmp_path / "lex.json")).orderBy("rank").collect()]
    assert got == [
        ("first reported", "en", 1, False), ("described", "en", 2, True), ("first", "en", 3, False),
        ("proposed", "en", 4, True), ("首次", "zh", 5, False),
    ]
    assert M.Lexicon.of(read_lexicon(spark, str(tmp_path / "lex.json"))).longest_wins()


YEAR_CASES = {
    "in the early 1980s and 2010": [("1980s", True), ("2010", False)],
    "在文【7,8】中": [("ref", False)],
    "3.1920": [], "978-2020-1234": [], "November 16, 2022": [], "2000 rpm": [], "n=2020": [], "20201234": [],
    "in 2010 A new": [("2010", False)],
}


def test_years(spark):
    got = by_doc(add_year_mentions(rows(spark, *YEAR_CASES)), "years")
    assert [[(y.year, y.is_decade) for y in ys] for ys in got] == list(YEAR_CASES.values())


AUTHOR_CASES = {
    "(Smith et al., 2020; Jones et al., 2019)": [("Smith", True, True, []), ("Jones", True, True, [])],
    "by Wang and co-workers": [("Wang", False, True, [])],
    "Cornet, 1989 described": [("Cornet", False, False, [])],
    "Bornmann and Marx first introduced it in 2014": [("Bornmann", False, False, [])],
    "丁传波等[3]": [("丁传波", False, True, [3])],
    "首次由丁传波等[3]": [("丁传波", False, True, [3])],
    "Smith 2010 found": [("Smith", False, False, [])],
    "It was first reported in 1999 [3].": [],
    "ISO et al. (2010)": [],
    "Saahj et al. (1999) first reported it [3-5].": [("Saahj", False, True, [3, 4, 5])],
}


@pytest.mark.parametrize("repeat", [1])
def test_authors(spark, repeat):
    got = by_doc(add_author_mentions(rows(spark, *AUTHOR_CASES)), "authors")
    assert [[(a.name, a.in_bracket, a.with_et_al, a.ref_numbers) for a in found] for found in got] == list(AUTHOR_CASES.values())


def test_default_lexicon_is_the_list_in_list_order():
    rows = default_phrases()
    english, chinese = [r for r in rows if r[1] == "en"], [r for r in rows if r[1] == "zh"]
    assert (len(english), len(chinese)) == (613, 125)
    assert [r[2] for r in rows] == list(range(1, 739))
    assert sum(r[3] for r in rows) == 16 and not any(r[3] for r in chinese)
    phrases = [r[0] for r in rows]
    assert {"first been reported", "earliest recorded data", "first total synthesis", "landmark science paper"} <= set(phrases)
    assert "original basis" not in phrases and "first" in phrases and phrases[-1] == "最先"
    assert phrases.index("reported") > phrases.index("first reported")


def test_has_first_been_reported_is_one_hit(spark):
    table = rows(spark, "It has first been reported.")
    assert [m.marker for m in M.add_marker_hits(table).first().markers] == ["first been reported"]


def test_both_strategies_agree_on_random_lexicons(spark):
    """One-character phrases, phrases that start with a sign, overlapping ranks."""
    import random

    pick = random.Random(11)
    parts = ["ab", "b", "-based", "c", "first", "首", "首次", "次发", "现", ".net", " ", "a-b", "，"]
    texts = ["".join(pick.choice(parts + [" ", " "]) for _ in range(pick.randrange(1, 12))) for _ in range(60)]
    for _ in range(3):
        chosen = pick.sample(["ab", "b", "-based", "c first", "first", "首", "首次", "次发现", "现", ".net", "a-b", "b c", "ab b"], 7)
        table = spark.createDataFrame(
            [(p, "zh" if "\u4e00" <= p[0] <= "\u9fff" else "en", i + 1, i % 3 == 0) for i, p in enumerate(chosen)], "phrase string, lang string, rank int, is_bare boolean"
        )
        sentences = rows(spark, *texts)
        want = {r.text: r.markers for r in M.add_marker_hits(sentences, M.Lexicon.of(table)).collect() if r.markers}
        got = {r.text: r.markers for r in M.marker_hits_by_join(sentences, table).collect() if r.markers}
        assert got == want


def test_a_large_lexicon_is_joined(spark, monkeypatch):
    from acclaim.plans.mining import mine

    text = "Smith et al. (2010) first reported it [1]. Nothing here.\nReferences\n[1] Smith A. Some title [J]. J, 2010, 1(2): 3-4."
    papers = spark.createDataFrame([(1, text)], "doc_id bigint, full_text string")
    small = mine(papers, default_lexicon(spark)).candidates().collect()
    monkeypatch.setattr(M, "MAX_INLINE_PHRASES", 10)
    assert M.Lexicon.of(default_lexicon(spark)) is None
    large = mine(papers, default_lexicon(spark)).candidates().collect()
    assert len(small) == 1 and [r.asDict() for r in small] == [r.asDict() for r in large]


def test_neighbours_with_gaps_and_repeats(spark):
    from acclaim.operators.sentences import with_neighbours

    turns = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (1, 2, "c"), (1, 3, "d"), (1, 9, None), (2, 5, "x"), (None, 1, "n")], "k bigint, turn bigint, text string")
    for stretch in (1, 2, 4096):
        got = [(r.k, r.turn, r.text, r.prev_sentence, r.next_sentence) for r in with_neighbours(turns, ["k"], "turn", stretch=stretch).collect()]
        assert sorted(got, key=str) == sorted([
            (1, 0, "a", "", "b"), (1, 2, "b", "a", "c"), (1, 2, "c", "b", "d"), (1, 3, "d", "c", ""), (1, 9, None, "d", ""), (2, 5, "x", "", ""), (None, 1, "n", "", ""),
        ], key=str)


def test_matches_are_cut_without_patterns(spark):
    """A pattern that cuts chunks is compiled again for every chunk; one character is not."""
    from acclaim.functions import spans

    row = spark.createDataFrame([("ab12cd3",)], "t string")
    found = row.select(spans.find_all(F.col("t"), r"([a-z])(\d)?", [("a", 1), ("d", 2)]).alias("h"))
    assert [tuple(h) for h in found.first().h] == [(0, 1, "a", "a", ""), (1, 3, "b1", "b", "1"), (4, 5, "c", "c", ""), (5, 7, "d3", "d", "3")]
    assert f"[{spans._GROUP}" not in found._jdf.queryExecution().toString()


def test_gates_keep_what_the_patterns_find(spark):
    rows = [
        (0, "(see Smith et al., 2020) and O'Neil, 1999 [2,4-6]."), (1, "文[,] without a digit"), (2, "文[3]中 B (1999)"),
        (3, "Lee [7] used it in the 1980s."), (4, "(1999) and (open, 2001 Smith"),
    ]
    base = spark.createDataFrame(rows, "i int, text string")
    got = {r.i: r for r in add_year_mentions(add_author_mentions(base)).collect()}
    assert [a.name for a in got[0].authors][0] == "Smith" and [y.year for y in got[0].years] == ["2020", "1999"]
    assert got[1].years == [] and [y.year for y in got[2].years] == ["ref", "1999"]
    assert [(a.name, a.ref_numbers) for a in got[3].authors] == [("Lee", [7])] and [y.year for y in got[3].years] == ["1980s"]
