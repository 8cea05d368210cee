"""References on positioned pages, gazetteers of any size, global numbers under any ids."""

import random
import re

import pytest
from pyspark.sql import functions as F

from acclaim.operators import evidence, locate, places, register
from acclaim.sources.gazetteer import Gazetteer

LINES = "doc_id bigint, page_num int, x0 double, y0 double, x1 double, y1 double, text string"
REFS = "doc_id bigint, ref_index int, raw_text string, first_author string, year string"


def lines_of(spark, texts, doc_id=1):
    return spark.createDataFrame([(doc_id, page, 50.0, y, 300.0, y + 10.0, text) for page, y, text in texts], LINES)


def test_references_are_found_as_spans_and_boxes(spark):
    lines = lines_of(spark, [
        (0, 100.0, "Smith A. Full text here [J]. J, 1999."), (9, 60.0, "[3] Smith A. Full  TEXT"), (9, 72.0, "here [J]. J, 1999."),
        (9, 100.0, "4. Jones, B., other"), (9, 112.0, "words"), (9, 140.0, "Lee, C., unnumbered"), (9, 152.0, "work, 2005."), (9, 200.0, "far away"),
    ])
    refs = spark.createDataFrame([
        (1, 3, "Smith A. Full text here [J]. J, 1999.", "Smith A", "1999"), (1, 4, "Jones B. Lost entry [J]. K, 2001.", "Jones, B.", "2001"),
        (1, 5, "Nobody X. Not there", "Nobody, X.", "1990"), (1, 6, "Lost words", "Lee, C.", "2005"), (1, 7, None, None, None), (2, 1, "elsewhere", "A", "1"),
    ], REFS)
    tail = {r.ref_index: r for r in locate.locate_references(refs, lines, last_pages=5).collect()}
    assert {i: (r.page_num, r.method) for i, r in tail.items()} == {3: (9, "full_text"), 4: (9, "number"), 6: (9, "surname_year")}
    text = locate.page_index(lines).filter("page_num = 9").first().text
    assert text[tail[3].start:tail[3].end] == "smith a. full text here [j]. j, 1999."
    assert [(b.y0, b.y1) for b in tail[3].boxes] == [(60.0, 70.0), (72.0, 82.0)]
    everywhere = {r.ref_index: r.page_num for r in locate.locate_references(refs, lines).collect()}
    assert everywhere[3] == 0
    boxes = locate.reference_boxes(locate.locate_references(refs, lines, last_pages=5), lines)
    got = {i: sorted(r.y0 for r in boxes.collect() if r.ref_index == i) for i in (3, 4, 6)}
    # a number or a surname grows by three lines of at least twelve points
    assert got == {3: [60.0, 72.0], 4: [100.0, 112.0], 6: [140.0, 152.0]}


def test_a_hit_without_lines_in_its_column_keeps_its_own_box(spark):
    # the anchor is wider than the column it begins in
    rows = [(1, 0, 50.0, 60.0 + 12 * i, 250.0, 70.0 + 12 * i, f"left {i}") for i in range(6)]
    rows += [(1, 0, 320.0, 60.0 + 12 * i, 520.0, 70.0 + 12 * i, f"right {i}") for i in range(6)]
    lines = spark.createDataFrame([*rows, (1, 0, 50.0, 400.0, 560.0, 410.0, "[8] Doe D over both columns")], LINES)
    refs = spark.createDataFrame([(1, 8, "unlike", "Doe, D.", "1990")], REFS)
    found = locate.reference_boxes(locate.locate_references(refs, lines), lines).collect()
    assert [(r.x0, r.y0, r.x1) for r in found] == [(50.0, 400.0, 560.0)]


def test_boxes_locate_references_once(spark):
    lines = spark.createDataFrame([(1, 0, 50.0, 60.0, 250.0, 70.0, "[8] Doe D. A title of some length")], LINES)
    refs = spark.createDataFrame([(1, 8, "unlike", "Doe, D.", "1990")], REFS)
    boxes = locate.reference_boxes(locate.locate_references(refs, lines), lines)
    # the search over page texts is read from a written table, not repeated for every use of its hits
    assert "collect_list" not in boxes._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.ref_index, r.method, r.y0) for r in boxes.collect()] == [(8, "number", 60.0)]


def test_line_components_follow_each_other(spark):
    row = spark.createDataFrame([("2020 Vision, 2020, 7(7): 7-9.",)], "line string").select(
        evidence.line_components(F.col("line"), journal=F.lit("2020 Vision"), year=F.lit("2020"), volume=F.lit("7"), missing=F.lit("x"), none=F.lit(None).cast("string"), issue=F.lit("7"), pages=F.lit("7-9")).alias("c"),
        evidence.journal_emphasis(F.col("line"), F.lit(" 2020 ")).alias("j"), evidence.author_emphasis(F.col("line"), F.lit("Ann Nobody")).alias("a"),
    ).first()
    assert [(c.part, c.start, c.end) for c in row.c] == [("journal", 0, 11), ("year", 13, 17), ("volume", 19, 20), ("issue", 21, 22), ("pages", 25, 28)]
    assert [tuple(s) for s in row.j] == [(0, 4)] and row.a == []


def ladder(institution, rows):
    """The first keyword in priority order, by one regular expression after the other."""
    for _, country, keyword in sorted(rows):
        if re.search("[一-鿿]", keyword):
            hit = keyword.lower() in institution.lower()
        else:
            hit = re.search(rf"(?<!\w){re.escape(keyword)}(?!\w)", institution, re.I)
        if hit:
            return country
    return None


@pytest.mark.parametrize("n", [40, 100_000])
def test_a_gazetteer_of_any_size_equals_the_ladder(spark, n):
    pick = random.Random(4)
    syllables = ["ka", "ro", "mi", "ten", "sul", "van", "ost", "li"]
    word = lambda: "".join(pick.choice(syllables) for _ in range(pick.randrange(2, 6))).title()
    keywords = list(dict.fromkeys([" ".join(["University of"] * (pick.random() < 0.3) + [word() for _ in range(pick.randrange(1, 3))]) for _ in range(n)]))
    keywords += ["U.S.A.", "中国", "南京", "A股市", "(Kaka)", r"Ka\Ero", "São Tomé", "India"]
    rows = [(i, f"c{i % 97}", k) for i, k in enumerate(keywords)]
    table = spark.createDataFrame([(c, k, i) for i, c, k in rows], "country string, keyword string, priority int")
    asked = ["Dept, U.S.A., x", "在南京的大学，中国", "Univ, Indiana", "UNIV, INDIA", "a股市场", "Inst (Kaka)", r"x Ka\Ero y", "SÃO TOMÉ", "", None, "nothing at all"]
    asked += [f"Lab of {pick.choice(keywords).swapcase()}, {pick.choice(keywords)}" for _ in range(60)] + [f"x{pick.choice(keywords)}y" for _ in range(5)]
    got = places.with_known_country(spark.createDataFrame([(a,) for a in asked], "institution string"), "institution", table).collect()
    assert len(got) == len(asked)
    known = {r.institution: r.known_country for r in got}
    checked = [a for a in asked if a] if n < 1000 else [a for a in asked if a][:25]
    for a in checked:
        assert known[a] == ladder(a, rows), a
    assert known[""] is None and known[None] is None


def test_table_and_expression_agree_on_the_default_gazetteer(spark):
    from acclaim.operators.enrich import country_of, country_or_tail

    asked = ["Nanjing Tech, Nanjing", "Univ, Indianapolis, Indiana", "IIT, New Delhi, India", "Kyiv, Ukraine", "UCL, UK", "某某大学，南京", "Nowhere, Very Long Name Of A Place Without Any Country"]
    df = spark.createDataFrame([(a,) for a in asked], "institution string")
    joined = places.with_known_country(df, "institution", Gazetteer.default().table(spark))
    rows = joined.select(country_or_tail(F.col("known_country"), F.col("institution")).alias("a"), country_of(F.col("institution")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_global_numbers_under_an_outlying_id(spark):
    # small ranges would otherwise be merged
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ids = [*range(1, 400), (1 << 62) + 5, -(1 << 62), None]
    rows = [(d, c) for d in ids for c in range(3)] + [(7, c) for c in range(3, 2000)]
    random.Random(2).shuffle(rows)
    numbered = register.number_globally(spark.createDataFrame(rows, "doc_id bigint, cand_id int").repartition(5))
    got = sorted((r.no, r.doc_id, r.cand_id) for r in numbered.collect() if r.doc_id is not None)
    want = sorted((r for r in rows if r[0] is not None))
    assert [(d, c) for _, d, c in got] == want and [n for n, _, _ in got] == list(range(4, len(rows) + 1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = spark.read.parquet(numbered.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_range").count()
    assert sizes.agg(F.max("count")).first()[0] < len(rows) / 2
