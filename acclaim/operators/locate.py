"""Where references stand on positioned pages: spans in the page text, and the boxes they cover.

A page becomes one text in reading order together with the place of every line in that text, so a
span found in the text leads back to line boxes by an interval join.  Pages stay rows of their own; the
references of a paper come to each of its pages as one small array, so page texts are not copied per
reference.  Groups are pages, or the references of one paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acclaim.functions import names as N
from acclaim.functions import text as T
from acclaim.functions.once import let
from acclaim.functions.spans import SPAN, literal_spans, overlaps, running_starts, union_spans
from acclaim.operators.evidence import clauses, longest_first
from acclaim.operators.layout import assign_columns, grow_reference, lines_between, page_columns
from acclaim.session import write_stage

# fixed values: how far from a number or a surname the other part of a reference may be, in points
_ABOVE, _BELOW_NUMBER, _BELOW_NAME, _LEFT = 3.0, 20.0, 50.0, 10.0
_SHORTEST_PART = 10
#: methods whose hits already are the reference, and those whose hits only say where it begins
WHOLE, GROWN = ("full_text", "clauses"), ("number", "surname_year", "part")


def _low(text: Column) -> Column:
    """Lower case where it keeps every offset."""
    return let(F.lower(text), lambda low: F.when(F.length(low) == F.length(text), low).otherwise(text))


def page_index(lines: DataFrame) -> DataFrame:
    """(doc_id, page_num, text, lines): lower-case page text, and start, end, box and reference numbers of its lines."""
    placed = assign_columns(lines, page_columns(lines)).withColumn("_numbers", F.array_distinct(F.concat(
        F.regexp_extract_all("text", F.lit(r"\[(\d{1,9})\]"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?<![\d.])(\d{1,9})[.\t]"), F.lit(1)),
    )))
    line = F.struct("col", "y0", "x0", "y1", "x1", _low(T.squeeze(F.col("text"))).alias("low"), "_numbers")
    pages = placed.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(line)).alias("_l"))
    pages = pages.withColumn("_starts", running_starts(F.transform("_l", lambda l: F.length(l["low"]) + 1)))
    at = F.zip_with("_l", "_starts", lambda l, s: F.struct(
        s.alias("start"), (s + F.length(l["low"])).alias("end"), l["x0"].alias("x0"), l["y0"].alias("y0"), l["x1"].alias("x1"), l["y1"].alias("y1"),
        l["low"].alias("low"), l["_numbers"].alias("numbers"),
    ))
    return pages.select("doc_id", "page_num", F.array_join(F.transform("_l", lambda l: l["low"]), " ").alias("text"), at.alias("lines"))


def _wanted(refs: DataFrame, most_clauses: int | None) -> DataFrame:
    """The references of each paper, prepared once."""
    raw = _low(T.squeeze(F.coalesce("raw_text", F.lit(""))))
    prepared = refs.select("doc_id", "ref_index", raw.alias("raw"), _low(F.coalesce(N.short_surname(F.col("first_author")), F.lit(""))).alias("surname"), F.coalesce("year", F.lit("")).alias("year"))
    parts = F.filter(F.transform(F.split("raw", "[．.]"), lambda p: T.strip(p)), lambda p: F.length(p) >= _SHORTEST_PART)
    pieces = longest_first(clauses(F.col("raw"), _SHORTEST_PART), most_clauses)
    item = F.struct("ref_index", "raw", "surname", "year", parts.alias("parts"), pieces.alias("clauses"))
    return prepared.groupBy("doc_id").agg(F.collect_list(item).alias("refs"))


def _may_be_found(text: Column, r: Column) -> Column:
    """False only where no step of ``_found`` can succeed: all of them need one of these texts on the page."""
    held = lambda name: F.exists(r[name], lambda p: F.contains(text, p))
    return ((F.length(r["surname"]) > 0) & F.contains(text, r["surname"])) | held("parts") | held("clauses") | ((F.length(r["raw"]) > 0) & F.contains(text, r["raw"]))


def _found(text: Column, lines: Column, r: Column) -> Column:
    """(method, spans) of the first way in which a reference is found on a page, or null."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(method: str, spans: Column) -> Column:
        return let(spans, lambda s: F.when(F.size(s) > 0, F.struct(F.lit(method).alias("method"), s.alias("spans"))))

    def first_line(test) -> Column:
        hits = F.filter(lines, test)
        return let(F.try_element_at(hits, F.lit(1)), lambda l: F.when(l.isNotNull(), F.array(F.struct(l["start"].alias("start"), l["end"].alias("end")))).otherwise(none))

    def nearby(l: Column, word: Column, left: Column, below: float) -> Column:
        return F.exists(lines, lambda m: (m["y1"] >= l["y0"] - _ABOVE) & (m["y0"] <= l["y1"] + below) & (m["x1"] > left) & F.contains(m["low"], word))

    named = F.length(r["surname"]) > 0
    number = first_line(lambda l: F.array_contains(l["numbers"], r["ref_index"].cast("string")) & nearby(l, r["surname"], l["x0"], _BELOW_NUMBER))
    surname = first_line(lambda l: F.contains(l["low"], r["surname"]) & nearby(l, r["year"], l["x0"] - _LEFT, _BELOW_NAME))
    part = let(F.try_element_at(F.filter(r["parts"], lambda p: F.contains(text, p)), F.lit(1)), lambda p: F.when(p.isNotNull(), literal_spans(text, p)).otherwise(none))
    pieces = union_spans(F.flatten(F.transform(F.filter(r["clauses"], lambda c: F.contains(text, c)), lambda c: literal_spans(text, c))))
    return F.coalesce(
        of("full_text", literal_spans(text, r["raw"])),
        F.when(named & (r["ref_index"] > 0), of("number", number)),
        # the year is only looked for beside a numbered reference's surname
        F.when(named & (r["ref_index"] > 0) & (F.length(r["year"]) > 0), of("surname_year", surname)),
        of("part", part),
        of("clauses", pieces),
    )


def locate_references(refs: DataFrame, lines: DataFrame, last_pages: int | None = None, most_clauses: int | None = None) -> DataFrame:
    """(doc_id, ref_index, page_num, method, start, end, boxes) on the first page on which a reference is found.

    Ladder: the whole text; the number with the surname beside or below it; the surname with the year
    near it; the first long part; the clauses, longest first.  Case does not matter.  ``start`` and ``end``
    are places in the page text of ``page_index``; ``boxes`` are the lines that the spans touch.
    ``last_pages`` and ``most_clauses`` limit the search; by default all pages and clauses count.
    """
    pages = page_index(lines)
    if last_pages is not None:
        last = lines.groupBy("doc_id").agg(F.max("page_num").alias("_last"))
        pages = pages.join(last, "doc_id").filter(F.col("page_num") > F.col("_last") - last_pages).drop("_last")
    met = pages.join(_wanted(refs, most_clauses), "doc_id")
    likely = F.filter("refs", lambda r: _may_be_found(F.col("text"), r))
    hit = F.transform(likely, lambda r: let(_found(F.col("text"), F.col("lines"), r), lambda f: F.struct(
        r["ref_index"].alias("ref_index"), f["method"].alias("method"), F.array_min(f["spans"])["start"].alias("start"), F.array_max(F.transform(f["spans"], lambda s: s["end"])).alias("end"),
        F.transform(
            F.filter("lines", lambda l: F.exists(f["spans"], lambda s: overlaps(l, s))),
            lambda l: F.struct(l["x0"].alias("x0"), l["y0"].alias("y0"), l["x1"].alias("x1"), l["y1"].alias("y1")),
        ).alias("boxes"),
    )))
    hits = met.select("doc_id", "page_num", F.inline(F.filter(hit, lambda h: h["method"].isNotNull())))
    best = hits.groupBy("doc_id", "ref_index").agg(F.min_by(F.struct("page_num", "method", "start", "end", "boxes"), "page_num").alias("h"))
    return best.select("doc_id", "ref_index", "h.*")


def reference_boxes(located: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, ref_index, page_num, method, x0, y0, x1, y1): the line boxes of whole references.

    A hit that only says where a reference begins grows by three line heights within its column.
    Hits and grown boxes are written once, because each is read several times.
    """
    located = write_stage(located, "located")
    kept = ["doc_id", "ref_index", "page_num", "method"]
    box = ["x0", "y0", "x1", "y1"]
    whole = located.filter(F.col("method").isin(*WHOLE)).select(*kept, F.inline("boxes"))
    edge = lambda name, pick: pick(F.transform("boxes", lambda b: b[name])).alias(name)
    begun = located.filter(F.col("method").isin(*GROWN))
    anchors = begun.select(
        *kept, F.col("ref_index").alias("anchor_id"), F.col("boxes")[0]["x0"].alias("x0"), edge("y0", F.array_min), edge("x1", F.array_max), edge("y1", F.array_max)
    )
    # only the pages that hold an anchor have their lines joined
    near = write_stage(lines.join(anchors.select("doc_id", "page_num").distinct(), ["doc_id", "page_num"], "left_semi"), "near")
    grown = lines_between(grow_reference(anchors), near, page_columns(near))
    grown = write_stage(grown.join(anchors.select(*kept, "anchor_id"), ["doc_id", "page_num", "anchor_id"]).select(*kept, *box), "grown")
    # an anchor that no line of its column holds stays as it is
    alone = begun.join(grown.select("doc_id", "ref_index").distinct(), ["doc_id", "ref_index"], "left_anti").select(*kept, F.inline("boxes"))
    return whole.unionByName(grown).unionByName(alone)
