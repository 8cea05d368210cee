"""Golden rows of the text and name functions."""

from pyspark.sql import functions as F

from acclaim.functions import citations as C
from acclaim.functions import names as N
from acclaim.functions import spans as S
from acclaim.functions import text as T


def test_line_break_hyphens(evaluate):
    assert evaluate(T.repair_line_break_hyphens, "chemi- cal", "water- in-salt", "water- repellent") == [
        "chemical", "water-in-salt", "water-repellent",
    ]


def test_ligatures_and_quotes(evaluate):
    assert evaluate(T.fold_ligatures, "ﬁrst", "oﬃce") == ["first", "office"]
    assert evaluate(T.balance_quotes, "Word” rest", "“ok”") == ["“Word” rest", "“ok”"]


def test_markers(evaluate):
    assert evaluate(T.canonical_marker, "first used", "first reported", "originally proposed", "initially described", "pioneered") == [
        "first", "first", "originally", "initially", "pioneered",
    ]
    assert evaluate(T.trim_marker_edges, "was first proposed by") == ["first proposed"]


def test_names(evaluate):
    assert evaluate(N.abbreviate, "Liumin Suo", "Oleg Borodin", "Suo, L.", "Suo L", "Teunis van Ree", "张三", "Smith, J.R.") == [
        "Suo L", "Borodin O", "Suo L", "Suo L", "van Ree T", "张三", "Smith JR",
    ]
    assert evaluate(N.surname, "Smith, John", "John Smith", "van der Berg, Jan") == ["Smith", "Smith", "van der Berg"]
    own = evaluate(N.self_names, "Xinhai Yuan", "YUAN Xinhai", "张三; Li Si")
    assert [set(x) for x in own] == [
        {"Xinhai Yuan", "Yuan"}, {"YUAN Xinhai", "Yuan", "YUAN"}, {"张三", "Li Si", "Si"},
    ]


def test_author_lines(evaluate):
    assert evaluate(N.authors_by_dot, "Ann Lee1,2 · Bob Ray3") == [["Ann Lee", "Bob Ray"]]
    assert evaluate(N.authors_by_comma, "Ann Lee1, Bob Ray, and Cy Dee... Eve Fox") == [["Ann Lee", "Bob Ray", "Cy Dee", "Eve Fox"]]
    assert evaluate(N.authors_by_superscript, "Kun Wang,1,17 Jun Wang,2,3,17 and Kun Wang,1") == [["Kun Wang", "Jun Wang"]]


def test_citation_numbers(evaluate):
    assert evaluate(C.citation_numbers, "[2,4-6]", "x [1] y [1，3]", "none", "[5-2]") == [[2, 4, 5, 6], [1, 3], [], []]


def test_title_similarity(evaluate):
    assert evaluate(lambda t: C.title_similarity(t, F.lit("a, b d")), "A b c", "") == [0.5, 0.0]


def test_json_object(evaluate):
    assert evaluate(
        T.first_json_object, 'x {"a":"}{","b":{"c":1}} {"z":2}', '```json\n{"a":1}\n```', '{"a": "q\\"}" } tail', '{"a": 1', "none",
    ) == ['{"a":"}{","b":{"c":1}}', '{"a":1}', '{"a": "q\\"}" }', '{"a": 1', "none"]


def test_headings(evaluate):
    assert evaluate(T.strip_heading_prefix, "3.1.1  Title  Body text", "3.1  Cells (ARLBs) Aqueous cells", "3.1 Foo bar") == [
        "Body text", "Aqueous cells", "3.1 Foo bar",
    ]
    assert evaluate(T.mark_section_headings, "end 3.1.1 Title", "end. 3.1 Title", "x 2.5 mm") == [
        "end. 3.1.1 Title", "end. 3.1 Title", "x 2.5 mm",
    ]


def test_noise_lines_and_body(evaluate):
    assert evaluate(T.drop_noise_lines, "a\n12\n· 34 ·\nVol. 35 No. 2 2019\nb", "12345\nx") == ["a\nb", "12345\nx"]
    assert evaluate(T.body_text, "abc.\nReferences\n[1] x", "abc\n# References:\n y", "no list") == ["abc.", "abc", "no list"]


def test_offsets_count_code_points(evaluate):
    hits = evaluate(lambda t: S.find_all(t, r"(\w)(\d)", [("a", 1), ("b", 2)]), "xx a1 😀c3")[0]
    assert [(h.start, h.end, h.match, h.a, h.b) for h in hits] == [(3, 5, "a1", "a", "1"), (7, 9, "c3", "c", "3")]


def test_brackets(evaluate):
    loose = evaluate(lambda t: S.bracket_pairs(t, False), "a (b (c) d）e) f")[0]
    typed = evaluate(lambda t: S.bracket_pairs(t, True), "a (b [c] d) (e] f)")[0]
    assert [(p.start, p.end) for p in loose] == [(5, 7), (2, 10)]
    assert [(p.start, p.end) for p in typed] == [(5, 7), (2, 10), (12, 17)]


def test_interval_union(evaluate):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(3, 5), (0, 3), (7, 9)]])
    assert [(s.start, s.end) for s in evaluate(lambda t: S.union_spans(spans), "x")[0]] == [(0, 5), (7, 9)]


def test_prefix_sums_cross_blocks(evaluate):
    got = evaluate(lambda t: S.running_starts(F.sequence(F.lit(1), F.lit(700))), "x")[0]
    assert got == [i * (i + 1) // 2 for i in range(700)]
