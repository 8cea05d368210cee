"""Table schemas, as DDL strings and parsed types.  Schemas are declared, never inferred."""

from __future__ import annotations

PAPER_TEXT = "doc_id bigint, full_text string"

REFERENCE = (
    "ref_index int, raw_text string, authors array<string>, first_author string, title string, journal string, "
    "year string, volume string, issue string, pages string, ref_type string, is_journal boolean, doi string"
)
REFERENCE_FIELDS = [column.strip().split(" ")[0] for column in REFERENCE.split(", ")]

SENTENCES = (
    "doc_id bigint, sent_idx int, text string, start_pos int, end_pos int, prev_sentence string, next_sentence string"
)
MARKER_HIT = "struct<marker:string,start:int,end:int,is_bare_word:boolean>"
AUTHOR_MENTION = (
    "struct<position:int,name:string,in_bracket:boolean,with_et_al:boolean,ref_numbers:array<int>,"
    "preceded_by_prep:boolean>"
)
YEAR_MENTION = "struct<position:int,year:string,in_bracket:boolean,is_decade:boolean,is_ref_number:boolean>"

LEXICON = "phrase string, lang string, rank int, is_bare boolean"

EVALUATED_FIELDS = [
    "authors", "first_author", "other_authors", "title", "journal", "year", "volume", "issue", "pages",
    "institution", "country",
]
EVALUATED = "struct<authors:array<string>," + ",".join(f"{f}:string" for f in EVALUATED_FIELDS[1:]) + ">"
JUDGE_RESPONSE = f"struct<results:array<struct<id:int,accept:boolean,reason:string,evaluated_paper:{EVALUATED}>>>"

WORKS = (
    "doi string, title array<string>, "
    "author array<struct<family:string,given:string,affiliation:array<struct<name:string>>>>, "
    "issue string, volume string, page string, pub_year string"
)
TEXT_LINES = (
    "doc_id bigint, page_num int, x0 double, y0 double, x1 double, y1 double, font_size double, text string"
)
PAPERS = (
    "doc_id bigint, title_cn string, title_en string, authors_cn array<string>, authors_en array<string>, "
    "first_author_cn string, first_author_en string, journal_cn string, journal_en string, year string, "
    "volume string, issue string, pages string, institution_cn string, institution_en string, country string, "
    "doi string"
)
AUDIT = "doc_id bigint, sent_idx int, stage string, rule_id int, reason string, snippet string"
