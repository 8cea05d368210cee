"""Expensive patterns stand once in a plan: lambdas and nested columns would repeat them for every use."""

import re

from pyspark.sql import functions as F

from acclaim.functions.spans import find_all
from acclaim import schemas
from acclaim.operators import enrich, evidence, references, register
from acclaim.operators.enrich import country_of
from acclaim.operators.markers import Lexicon, add_marker_hits
from acclaim.operators.papers import english_metadata
from acclaim.sources.gazetteer import Gazetteer
from acclaim.sources.verdicts import parse_verdicts


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_entry_is_matched_once_for_its_numbers(spark):
    rows = [(1, "bracket", 1, 1, "[x] A B. T [J]. J, 1999, 12(3): 10-20."), (1, "dot", 2, 2, "A, B.: T. J 12, 10–20 (1999)")]
    entries = spark.createDataFrame(rows, "doc_id long, style string, position int, number int, raw string")
    parsed = references.parse_entries(entries.repartition(1))
    assert _optimized(parsed).count("[^.;]*?))?") == 1
    assert [(r["volume"], r["pages"], r["year"]) for r in parsed.orderBy("ref_index").collect()] == [("12", "10-20", "1999")] * 2


def test_walks_append_and_phrases_share_their_beginnings(spark):
    text = spark.range(1).select(F.lit("a1 b2").alias("t")).repartition(1)
    walked = text.select(find_all(F.col("t"), r"\w\d").alias("hits"))
    assert "concat(" not in _optimized(walked).lower()
    assert [h["start"] for h in walked.first()["hits"]] == [0, 3]
    small = Lexicon((("first used", "en", 1, False), ("first seen", "en", 2, False), ("found", "en", 3, True)))
    assert "(?:f(?:i(?:" in small.gate()
    hits = add_marker_hits(spark.createDataFrame([(1, 0, "First seen, found, first usedx")], "doc_id long, sent_idx int, text string"), small)
    assert [m["marker"] for m in hits.first()["markers"]] == ["First seen", "found"]


def test_a_response_is_read_once(spark):
    said = 'Well: {"results": [{"id": 1, "accept": false, "reason": "}{"}]} and {"more": 1}'
    rows = spark.createDataFrame([(1, 0, said), (2, 0, "{{"), (3, 0, None)], "doc_id long, batch_no int, response string").repartition(1)
    answers = parse_verdicts(rows)
    assert _optimized(answers).count("from_json(") == 1
    assert [(r["doc_id"], r["cand_id"], r["accept"], r["reason"]) for r in answers.collect()] == [(1, 1, False, "}{")]


def test_a_running_head_is_found_once_and_read_once(spark):
    texts = [
        (1, "On salt\n1 Some School, Lyon, France\n2 Other\nSmith et al., 2020, Cell Reports 7, 10-34\nHeliyon 9 (2019) e1"),
        (2, "On salt\nDepartment of X, Georgia Tech, Atlanta, USA\nHeliyon 𝒜\nHeliyon 9 (2019) e06955"), (3, "Nothing (1987)"), (4, None),
    ]
    rows = spark.createDataFrame([(i, t, t) for i, t in texts], "doc_id long, full_text string, first_page string").repartition(1)
    meta = english_metadata(rows)
    # the title of the journal stands once in each of the five layouts, which are searched once and read once
    assert _optimized(meta).count("[a-z]?[A-Z]") <= 10
    got = {r["doc_id"]: (r["journal_en"], r["year"], r["volume"], r["issue"], r["pages"], r["institution_en"], r["country"]) for r in meta.collect()}
    assert got == {
        1: ("Cell Reports", "2020", "7", None, "10-34", "Some School, Lyon, France", "法国"), 2: ("Heliyon", "2019", "9", None, "e06955", "Department of X, Georgia Tech, Atlanta, USA", "美国"),
        3: (None, "1987", None, None, None, None, None), 4: (None,) * 7,
    }


def test_countries_are_looked_for_by_halves(spark):
    default = Gazetteer.default()
    places = spark.createDataFrame([(f"Lab of {k}, Institute", c) for c, k in default.rows], "place string, country string").repartition(1)
    found = places.select("place", country_of(F.col("place"), last_part=False).alias("found"))
    want = {}
    for place, _ in {(f"Lab of {k}, Institute", c) for c, k in default.rows}:
        fits = lambda k: re.search(k if re.search("[一-鿿]", k) else rf"(?<!\w){re.escape(k)}(?!\w)", place, re.I)  # noqa: E731, B023
        want[place] = next(c for c, k in default.rows if fits(k))
    assert {r["place"]: r["found"] for r in found.collect()} == want


def test_a_name_of_the_register_is_abbreviated_once(spark):
    """Every control character goes, whether the record or its paper holds it, and names stand once in the plan."""
    schema = "doc_id long, no long, sentence string, marker string, authors array<string>, first_author string, other_authors string, title string, journal string, year string, volume string, issue string, pages string, institution string, country string, other_refs_info string"
    rows = [
        (1, 1, "a\tb\x07c\n", "first", ["Oleg Borodin", "Ann\x01 Lee"], "Oleg Borodin", None, "T", None, "1999", "1", "2", "3-4", None, "X", ""),
        (2, 2, "clean", "first", [], "Ann Lee", "Bob Ray", "T\x0b", "J", None, None, None, None, "I", None, ""),
        (3, 3, "clean", "first", None, None, "Bob Ray", "T", "J", None, None, None, None, "I", None, ""),
    ]
    papers = spark.createDataFrame([(1, "On\x02 salt")], "doc_id long, title_en string")
    for c, kind in (x.strip().split(" ") for x in schemas.PAPERS.split(", ")):
        if c not in papers.columns:
            papers = papers.withColumn(c, F.lit(None).cast(kind))
    out = register.register(spark.createDataFrame(rows, schema).repartition(1), papers, provider="P\x03")
    assert _optimized(out).count("CASE WHEN (trim(") <= 4
    got = [tuple(r) for r in out.orderBy("no").collect()]
    assert all(v is not None and not re.search(r"[\x00-\x09\x0b\x0c\x0e-\x1f]", str(v)) for r in got for v in r)
    by = [dict(zip(out.columns, r)) for r in got]
    assert [r["sentence"] for r in by] == ["abc\n", "clean", "clean"] and by[0]["reviewing_title"] == "On salt" and by[0]["provider"] == "P"
    assert [r["evaluated_first_author"] for r in by] == ["Borodin O", "Lee A", ""] and [r["evaluated_other_authors"] for r in by] == ["Lee A", "Ray B", "Ray B"]
    assert by[0]["evaluated_citation"] == "Borodin O, Lee A. T[J]. 1999, 1(2): 3-4." and by[1]["evaluated_citation"] == "Lee A. T[J]. J,."


def test_verification_reads_the_records_once(spark):
    papers = spark.createDataFrame([(1, "Aa b. Cc\nd."), (2, "other"), (4, None), (5, "x y"), (5, "z")], "doc_id long, full_text string")
    rows = [(1, 1, "Cc d."), (1, 2, "not there"), (1, 3, None), (1, None, "not there"), (2, 1, "other"), (2, 1, "gone"), (3, 1, "no paper"), (4, 1, "no text"), (5, 1, "x y"), (None, 1, "s")]
    records = spark.createDataFrame(rows, "doc_id long, cand_id int, sentence string").repartition(2)
    kept = evidence.verify_records(records, papers)
    assert kept.columns == records.columns and _optimized(kept).count("LogicalRDD") == 2
    want = {(1, 1, "Cc d."), (1, 3, None), (1, None, "not there"), (3, 1, "no paper"), (4, 1, "no text"), (None, 1, "s")}
    assert len(got := [tuple(r) for r in kept.collect()]) == len(want) and set(got) == want


def test_a_title_is_cut_into_words_once(spark):
    rows = [(1, 1, "Salt in water", "1999"), (1, 2, "Salt in water", "1999"), (2, 1, "Water, in salt!", "1999"), (2, 2, "Salt in water", None), (3, 1, None, "1999"), (3, 2, "..", "1999"), (None, 9, "Salt in water", "1999"), (4, 1, "Salt in water", "2000")]
    records = spark.createDataFrame(rows, "doc_id long, cand_id int, title string, year string").repartition(2)
    work = lambda doi, title, year: (doi, title, title, year, None, None, None, None, None)
    schema = "doi string, full_title string, title string, pub_year string, authors array<string>, author array<string>, issue string, volume string, pages string"
    works = spark.createDataFrame([work("10.1/b", "Salt in water", "1999"), work("10.1/a", "In Water Salt", "1999"), work("10.1/c", "Salt in cold water", "2001")], schema)
    found = enrich.match_by_title(records, works, ["doc_id", "cand_id"])
    assert "[^\\w\\s]" not in _optimized(found)
    got = sorted((str(r["doc_id"]), r["cand_id"], r["work"]["doi"], r["similarity"]) for r in found.collect())
    assert got == [("1", 1, "10.1/a", 1.0), ("1", 2, "10.1/a", 1.0), ("2", 1, "10.1/a", 1.0), ("2", 2, "10.1/a", 1.0), ("None", 9, "10.1/a", 1.0)]


def test_what_a_step_does_not_read_passes_as_one_column(spark):
    from acclaim.operators.sentences import sentence_arrays
    from acclaim.plans.mining import with_mentions

    papers = spark.createDataFrame([(1, "Before it came this one. Smith et al. (2010) first reported it. After it came that one.")], "doc_id long, full_text string")
    lexicon = Lexicon.default()
    found = with_mentions(sentence_arrays(papers.repartition(1), offsets=False, keep=lexicon.gate()), lexicon)
    carried = [line for line in _optimized(found).splitlines() if "Generate explode" in line and "_once" in line and "sentences" not in line]
    assert carried and not any("prev_sentence" in line for line in carried)
    row = found.first()
    assert (row.sent_idx, row.prev_sentence, row.next_sentence) == (1, "Before it came this one.", "After it came that one.")
    assert (row.markers[0].marker, row.authors[0].name, row.years[0].year, row.years[0].in_bracket) == ("first reported", "Smith", "2010", True)


def test_a_paper_is_ranked_and_gathered_by_one_shuffle(spark):
    from acclaim.testing import render

    plan = render.papers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_flat_brackets_are_paired_like_nested_ones(spark):
    from acclaim.functions.spans import bracket_pairs

    texts = ["a (b) [c]", "(a (b) c)", ") (a", "(a] [b)", "（a) (b）", "[a (b] c)", "((", "no", "(a [b] c) (d)", "【a】[【b】]", "()()"]

    def walked(text: str, typed: bool) -> list[tuple[int, int]]:
        stack, pairs = [], []
        for at, ch in enumerate(text):
            if ch in ("(（[【" if typed else "(（"):
                stack.append((ch, at))
            elif ch in (")）]】" if typed else ")）") and stack and (not typed or "(（[【".index(stack[-1][0]) == ")）]】".index(ch)):
                pairs.append((stack.pop()[1], at))
        return pairs

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for typed in (False, True):
        got = rows.select("t", bracket_pairs(F.col("t"), typed=typed).alias("p")).collect()
        assert {r.t: [tuple(s) for s in r.p] for r in got} == {t: walked(t, typed) for t in texts}


def test_papers_rank_items_without_a_day_like_reference_rows(spark, tmp_path):
    from acclaim.testing import render

    rows = [(1, None, 5, 7, 1, 3.0, "N"), (1, "1995-03-01", 6, 8, 2, 4.0, "R"), (1, "1995-02-01", 9, 9, 3, 5.0, "N"), (None, "1995-02-01", 9, 9, 1, 5.0, "N")]
    items = spark.createDataFrame(rows, "l_orderkey long, l_shipdate string, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_returnflag string")
    items.withColumn("l_shipdate", F.to_date("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    listed = render.reference_rows(spark, str(tmp_path)).filter("doc_id is not null").orderBy("ref_index").collect()
    text = render.papers(spark, str(tmp_path), style="bracket").first()["full_text"]
    assert [r.ref_index for r in listed] == [2, 3]
    assert [line.split("]")[0] for line in text.split("References\n")[1].splitlines()] == ["[2", "[3"]
