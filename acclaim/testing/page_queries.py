"""Queries over positioned pages and over what a form emphasises, with their SQL.

Bibliographies are laid out as line boxes from the structured references: sixteen pages a paper, two
columns, three lines an entry; the searched text of every fifth reference is the printed one, the others
give away a number, a surname, a part or a clause only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acclaim.operators import locate, register
from acclaim.testing import oracles, render
from acclaim.testing.queries import _final_records, _paper_meta, query

_PAGES = 16


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One printed reference per lineitem: its paper, page, number, place and words."""
    rows = render.reference_rows(spark, sf_dir)
    page = (F.col("doc_id") % _PAGES).cast("int")
    number = page * 100 + F.col("ref_index")
    spelled = render.letters(number, 4)
    return rows.select(
        F.floor(F.col("doc_id") / _PAGES).alias("doc_id"), page.alias("page_num"), number.cast("int").alias("ref_index"), "year", "volume",
        (F.col("ref_index") % 2).alias("side"), (60.0 + F.col("ref_index") * 60).alias("y"), (F.col("ref_index") % 5).alias("kind"),
        F.concat("surname", spelled).alias("surname"), F.concat(F.lit("Title "), "tag", spelled, F.lit(" of it")).alias("title"),
    )


def _printed(entries: DataFrame) -> DataFrame:
    number = F.when(F.col("kind") == 2, F.lit("")).otherwise(F.concat(F.lit("["), "ref_index", F.lit("] ")))
    texts = [
        F.concat(number, "surname", F.lit("  A, Coauth B.")), F.concat("title", F.lit(" [J].")),
        F.concat(F.lit("Journal "), "surname", F.lit(", "), "year", F.lit(", "), "volume", F.lit(": 1-9.")),
    ]
    lines = entries.select("doc_id", "page_num", "side", "y", F.posexplode(F.array(*texts)).alias("line", "text"))
    x0, y0 = F.when(F.col("side") == 0, 50.0).otherwise(320.0), F.col("y") + F.col("line") * 12
    return lines.select("doc_id", "page_num", x0.alias("x0"), y0.alias("y0"), (x0 + 200).alias("x1"), (y0 + 10).alias("y1"), "text")


def _searched(entries: DataFrame) -> DataFrame:
    whole = F.concat(
        F.lit("["), "ref_index", F.lit("] "), F.upper("surname"), F.lit(" A, Coauth B. "), "title", F.lit(" [J]. Journal "), "surname", F.lit(", "), "year", F.lit(", "), "volume", F.lit(": 1-9."),
    )
    raw = (
        F.when(F.col("kind") == 0, whole).when(F.col("kind").isin(1, 2), "Other wording altogether")
        .when(F.col("kind") == 3, F.concat(F.lit("Nobody. Nowhere to be found. "), "title", F.lit(" [J]. Else")))
        .otherwise(F.concat(F.lit("no such words; "), "title", F.lit(" [J]; and so on")))
    )
    author = F.when(F.col("kind").isin(1, 2), F.concat(F.lit("A. "), "surname"))
    return entries.select("doc_id", "ref_index", raw.alias("raw_text"), author.alias("first_author"), "year")


@query
def reference_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page, method, span and box of every reference in the last five pages of its paper."""
    entries = _entries(spark, sf_dir)
    found = locate.locate_references(_searched(entries), _printed(entries), last_pages=5, most_clauses=3)
    edge = lambda name, pick: pick(F.transform("boxes", lambda b: b[name])).alias(name)
    return found.select(
        "doc_id", "ref_index", "page_num", "method", "start", "end", F.size("boxes").alias("n_boxes"),
        edge("x0", F.array_min), edge("y0", F.array_min), edge("x1", F.array_max), edge("y1", F.array_max),
    )


@query
def reference_entry_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line boxes of whole references; hits that only begin one grow within their column."""
    entries = _entries(spark, sf_dir)
    lines = _printed(entries)
    return locate.reference_boxes(locate.locate_references(_searched(entries), lines), lines)


def _form_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    surname = F.regexp_extract("first_author", r"^\S+", 0)
    recs = _final_records(spark, sf_dir)
    sentence = F.concat(surname, F.lit(" was first in "), "year", F.lit(" to see first things"))
    return recs.withColumns({"sentence": sentence, "first_author": F.concat(F.lit("A. "), surname)})


@query
def form_emphasis_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.form_emphasis(_form_records(spark, sf_dir), _paper_meta(spark, sf_dir))


@query
def journal_line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.journal_line_parts(_paper_meta(spark, sf_dir))


_ENTRIES = f"""
entries AS (
  SELECT doc_id // 16 AS doc_id, CAST(doc_id % 16 AS INTEGER) AS page_num, CAST(doc_id % 16 * 100 + ref_index AS INTEGER) AS n, ref_index % 5 AS kind, ref_index % 2 AS side,
    60.0::DOUBLE + ref_index * 60 AS y, year, volume, surname || translate(lpad(CAST(doc_id % 16 * 100 + ref_index AS VARCHAR), 4, '0'), {oracles._DIGITS}) AS surname,
    'Title ' || tag || translate(lpad(CAST(doc_id % 16 * 100 + ref_index AS VARCHAR), 4, '0'), {oracles._DIGITS}) || ' of it' AS title
  FROM r),
printed AS (
  SELECT doc_id, page_num, n, kind, line, CASE WHEN side = 0 THEN 50.0 ELSE 320.0 END::DOUBLE AS x0, y + line * 12 AS y0,
    [CASE WHEN kind = 2 THEN '' ELSE '[' || n || '] ' END || surname || ' A, Coauth B.', title || ' [J].', 'Journal ' || surname || ', ' || year || ', ' || volume || ': 1-9.'][line + 1] AS text
  FROM entries, (VALUES (0), (1), (2)) l(line)),
cols AS (SELECT doc_id, page_num, count_if(x0 < 286) > 5 AND count_if(x0 > 286) > 5 AS two FROM printed GROUP BY 1, 2),
placed AS (
  SELECT *, CASE WHEN two AND x0 > 286 THEN 1 ELSE 0 END AS col,
    coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_num ORDER BY CASE WHEN two AND x0 > 286 THEN 1 ELSE 0 END, y0, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM printed JOIN cols USING (doc_id, page_num)),
hits AS (
  SELECT doc_id, n, page_num, line, kind, col, two, x0, y0, x0 + 200 AS x1, y0 + 10 AS y1, ['full_text', 'number', 'surname_year', 'part', 'clauses'][kind + 1] AS method,
    begins AS s, begins + length(text) - CASE kind WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS e
  FROM placed WHERE CASE kind WHEN 0 THEN TRUE WHEN 1 THEN line = 0 WHEN 2 THEN line = 0 ELSE line = 1 END)"""

PAGE_ORACLES = {
    "reference_locations": oracles._with(oracles._REF_SRC, _ENTRIES) + """
SELECT doc_id, n AS ref_index, page_num, method, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS end, CAST(count(*) AS INTEGER) AS n_boxes,
  min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
FROM hits JOIN (SELECT doc_id, max(page_num) AS last FROM printed GROUP BY 1) USING (doc_id) WHERE page_num > last - 5 GROUP BY 1, 2, 3, 4""",
    "reference_entry_boxes": oracles._with(oracles._REF_SRC, _ENTRIES) + """
SELECT doc_id, n AS ref_index, page_num, method, x0, y0, x1, y1 FROM hits WHERE kind IN (0, 4)
UNION ALL
SELECT h.doc_id, h.n, h.page_num, method, p.x0, p.y0, p.x0 + 200, p.y0 + 10
FROM hits h JOIN placed p USING (doc_id, page_num, col) WHERE h.kind IN (1, 2, 3) AND p.y0 >= h.y0 - 2 AND p.y0 + 10 <= h.y1 + 36 + 2""",
    "form_emphasis_spans": oracles._with(oracles._REF_SRC, oracles._META) + """
, f AS (
  SELECT doc_id, ref_index AS cand_id, c_name, journal, pyear, surname, year,
    surname || ' A, Coauth B. Title ' || tag || '[J].' || CASE WHEN is_journal THEN ' Journal J,' ELSE '' END || ' ' AS lead
  FROM r JOIN lined USING (doc_id)),
spans AS (
  SELECT doc_id, cand_id, 1 AS row_idx, 0 AS s, length(c_name) AS n FROM f
  UNION ALL SELECT doc_id, cand_id, 2, length(journal) + 2, 4 FROM f
  UNION ALL SELECT doc_id, cand_id, 9, 0, length(surname) FROM f
  UNION ALL SELECT doc_id, cand_id, 9, length(surname) + 5, 5 FROM f
  UNION ALL SELECT doc_id, cand_id, 9, length(surname) + 14, 4 FROM f
  UNION ALL SELECT doc_id, cand_id, 9, length(surname) + 26, 5 FROM f
  UNION ALL SELECT doc_id, cand_id, 10, 0, length(surname) FROM f
  UNION ALL SELECT doc_id, cand_id, 10, length(lead), 4 FROM f)
SELECT doc_id, cand_id, row_idx, CAST(s AS INTEGER) AS start, CAST(s + n AS INTEGER) AS end FROM spans""",
    "journal_line_parts": oracles._with(oracles._META.lstrip("\n")) + """
, spans AS (
  SELECT doc_id, 'journal' AS part, 0 AS s, length(journal) AS n FROM lined
  UNION ALL SELECT doc_id, 'year', length(journal) + 2, 4 FROM lined
  UNION ALL SELECT doc_id, 'volume', length(journal) + 8, length(pvol) FROM lined WHERE pvol IS NOT NULL
  UNION ALL SELECT doc_id, 'issue', length(journal) + 9 + length(pvol), 1 FROM lined WHERE pvol IS NOT NULL AND pissue IS NOT NULL
  UNION ALL SELECT doc_id, 'pages', length(journal) + 8 + length(vi) + CASE WHEN vi = '' THEN 0 ELSE 2 END, 4 FROM lined)
SELECT doc_id, part, CAST(s AS INTEGER) AS start, CAST(s + n AS INTEGER) AS end FROM spans""",
}
