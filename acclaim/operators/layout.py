"""Positioned text lines: columns, reading order, line islands, ranges, title blocks.

Groups are pages or the first pages of a paper, so no group grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acclaim import fixed
from acclaim.functions import names as N
from acclaim.functions import text as T

# fixed values: page geometry in points
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
_NARROWEST, _WIDEST_SHARE = 50.0, 0.8
_MIDDLE_SLACK, _MIN_STARTS, _MIN_GAP = 20.0, 5, 10.0
_COLUMN_SLACK, _COLUMN_FIT, _Y_SLACK = 10.0, 15.0, 2.0
_LINE_GRID, _ISLAND_GAP = 3.0, 50.0
_TITLE_BOTTOM, _BLOCK_BOTTOM, _AUTHOR_BOTTOM = 400.0, 300.0, 350.0


def page_columns(lines: DataFrame, page_width: float = PAGE_WIDTH) -> DataFrame:
    """(doc_id, page_num, n_columns, columns): x-ranges of one or two text columns."""
    width = F.col("x1") - F.col("x0")
    usable = (width >= _NARROWEST) & (width <= page_width * _WIDEST_SHARE)
    middle = page_width / 2 - _MIDDLE_SLACK
    left, right = usable & (F.col("x0") < middle), usable & (F.col("x0") > middle)
    stats = lines.groupBy("doc_id", "page_num").agg(
        F.count_if(left).alias("nl"), F.count_if(right).alias("nr"),
        F.min(F.when(left, F.col("x0"))).alias("l0"), F.max(F.when(left, F.col("x1"))).alias("l1"),
        F.min(F.when(right, F.col("x0"))).alias("r0"), F.max(F.when(right, F.col("x1"))).alias("r1"),
    )
    two = (F.col("nl") > _MIN_STARTS) & (F.col("nr") > _MIN_STARTS) & (F.col("r0") - F.col("l1") > _MIN_GAP)

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.alias("x0"), b.alias("x1"))

    return stats.select(
        "doc_id", "page_num", F.when(two, 2).otherwise(1).alias("n_columns"),
        F.when(two, F.array(span(F.col("l0"), F.col("l1")), span(F.col("r0"), F.col("r1"))))
        .otherwise(F.array(span(F.lit(0.0), F.lit(page_width)))).alias("columns"),
    )


def column_of(columns: Column, x: Column) -> Column:
    """0-based column of an x position: the first that holds it, else the nearest middle."""
    ranked = F.transform(
        columns,
        lambda c, i: F.struct(
            F.when((c["x0"] - _COLUMN_SLACK <= x) & (x <= c["x1"] + _COLUMN_SLACK), F.lit(0)).otherwise(1).alias("out"),
            F.when((c["x0"] - _COLUMN_SLACK <= x) & (x <= c["x1"] + _COLUMN_SLACK), F.lit(0.0))
            .otherwise(F.abs(x - (c["x0"] + c["x1"]) / 2)).alias("gap"),
            i.alias("i"),
        ),
    )
    return F.array_min(ranked)["i"]


def assign_columns(lines: DataFrame, columns: DataFrame) -> DataFrame:
    return lines.join(columns.select("doc_id", "page_num", "columns"), ["doc_id", "page_num"]).withColumn(
        "col", column_of(F.col("columns"), F.col("x0"))
    )


def reading_order(lines: DataFrame, page_width: float = PAGE_WIDTH) -> DataFrame:
    """(doc_id, page_num, text): lines by column, top to bottom."""
    right = ((F.col("x0") + F.col("x1")) / 2 >= page_width / 2).cast("int")
    pages = lines.filter(F.trim("text") != "").groupBy("doc_id", "page_num").agg(
        F.array_sort(F.collect_list(F.struct(right.alias("c"), F.col("y0").alias("y"), "text"))).alias("l")
    )
    return pages.select("doc_id", "page_num", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def paper_texts(pages: DataFrame) -> DataFrame:
    """Pages joined to one text per paper, with the page count."""
    return pages.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda p: p["text"]), "\n"
        ).alias("full_text"),
        (F.max("page_num") + 1).alias("page_count"),
    )


def line_islands(lines: DataFrame) -> DataFrame:
    """Boxes of one text line merged while the horizontal gap stays at or below 50 points.

    The comparison uses the running right edge, so a wide box keeps its island open.
    """
    line = F.round(F.col("y0") / _LINE_GRID).cast("bigint")
    w = Window.partitionBy("doc_id", "page_num", "line").orderBy("x0", "x1", "y0", "y1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = lines.withColumn("line", line).withColumn(
        "starts", F.when(before.isNull() | (F.col("x0") > before + _ISLAND_GAP), 1).otherwise(0)
    )
    islands = flagged.withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "page_num", "line", "island").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count("*").alias("n_boxes"),
    )


def lines_between(anchors: DataFrame, lines: DataFrame, columns: DataFrame) -> DataFrame:
    """Lines between a start and an end anchor of a page, across columns.

    ``anchors``: doc_id, page_num, anchor_id, start_x, start_y, end_x, end_y.  The start
    column counts from start_y down, the end column down to end_y, columns between whole.
    """
    placed = anchors.join(columns.select("doc_id", "page_num", "columns"), ["doc_id", "page_num"])
    bounded = placed.withColumn("c0", column_of(F.col("columns"), F.col("start_x"))).withColumn(
        "c1", column_of(F.col("columns"), F.col("end_x"))
    )
    joined = bounded.join(lines, ["doc_id", "page_num"])
    single = F.size("columns") <= 1

    def hit(c: Column, i: Column) -> Column:
        fits = single | ((F.col("x0") >= c["x0"] - _COLUMN_FIT) & (F.col("x1") <= c["x1"] + _COLUMN_FIT))
        below = (i > F.col("c0")) | (F.col("y0") >= F.col("start_y") - _Y_SLACK)
        above = (i < F.col("c1")) | (F.col("y1") <= F.col("end_y") + _Y_SLACK)
        return (i >= F.col("c0")) & (i <= F.col("c1")) & fits & below & above

    inside = F.exists(F.transform("columns", hit), lambda b: b)
    return joined.filter(inside).select("doc_id", "page_num", "anchor_id", "x0", "y0", "x1", "y1", "text")


def grow_reference(anchors: DataFrame) -> DataFrame:
    """Anchor boxes (x0, y0, x1, y1) grown by three line heights, as input of ``lines_between``."""
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(12.0))
    return anchors.select(
        "doc_id", "page_num", "anchor_id", F.col("x0").alias("start_x"), F.col("y0").alias("start_y"),
        F.col("x0").alias("end_x"), (F.col("y1") + height * 3).alias("end_y"),
    )


def _title_line(line: Column) -> Column:
    return (
        (F.length(line) >= 10)
        & ~line.rlike(r"^[\d\s.]+$")
        & ~line.rlike(r"(?i)doi\.org") & ~line.rlike("DOI")
        & ~F.trim(line).isin(*fixed.ARTICLE_LABELS)
    )


def clean_title(title: Column) -> Column:
    """Article-type label, special spaces and hyphens removed."""
    label = r"(?i)^(?:Article|Review(?:\s+Article)?|Research\s+Article|Original\s+Article|Letter|Communication|Short\s+Communication)\s+"
    return T.strip(F.translate(F.regexp_replace(title, label, ""), " ‑‐", " --"))


def title_by_font(lines: DataFrame) -> DataFrame:
    """(doc_id, title): largest font on the first page's upper part, topmost on ties."""
    shown = T.squeeze(F.col("text"))
    first_page = lines.filter((F.col("page_num") == 0) & (F.col("y0") <= _TITLE_BOTTOM)).withColumn("text", shown)
    return (
        first_page.filter(_title_line(F.col("text")))
        .groupBy("doc_id")
        .agg(F.max_by("text", F.struct("font_size", -F.col("y0"), -F.col("x0"), "text")).alias("title"))
        .select("doc_id", clean_title(F.col("title")).alias("title"))
    )


def title_segments(title: Column) -> Column:
    """Up to three runs of whole words of at least 15 characters, hyphens cut."""
    words = F.split(title, r"[-\x{2011}\s]+")

    def step(acc: Column, word: Column) -> Column:
        grown = F.trim(F.concat_ws(" ", F.nullif(acc["run"], F.lit("")), word))
        full = F.length(grown) >= 15
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(grown))).otherwise(acc["out"]).alias("out"),
            F.when(full, F.lit("")).otherwise(grown).alias("run"),
        )

    init = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("run"))
    cut = F.aggregate(
        words, init, step,
        lambda acc: F.when(F.length(acc["run"]) >= 5, F.concat(acc["out"], F.array(acc["run"]))).otherwise(acc["out"]),
    )
    return F.slice(cut, 1, 3)


def title_author_block(papers: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of the title and first-author area on the first of pages 0-2 where either occurs.

    ``papers``: doc_id, title, first_author.
    """
    upper = lines.filter((F.col("page_num") <= 2) & (F.col("y0") < _BLOCK_BOTTOM))
    probe = papers.select("doc_id", title_segments(F.col("title")).alias("_seg"), F.col("first_author").alias("_fa"))
    hits = upper.join(probe, "doc_id").select(
        "doc_id", "page_num", "y0", "y1",
        F.exists("_seg", lambda s: F.contains(F.col("text"), s)).alias("is_title"),
        ((F.length("_fa") >= 4) & F.contains("text", "_fa")).alias("is_author"),
    ).filter(F.col("is_title") | F.col("is_author"))
    ranges = hits.groupBy("doc_id", "page_num").agg(
        F.min(F.when(F.col("is_title"), F.col("y0"))).alias("t0"), F.max(F.when(F.col("is_title"), F.col("y1"))).alias("t1"),
        F.min(F.when(F.col("is_author"), F.col("y0"))).alias("a0"), F.max(F.when(F.col("is_author"), F.col("y1"))).alias("a1"),
    )
    first = ranges.groupBy("doc_id").agg(F.min_by(F.struct("page_num", "t0", "t1", "a0", "a1"), "page_num").alias("r")).select(
        "doc_id", "r.*"
    )
    reach = F.col("a1") + F.greatest(F.col("a1") - F.col("a0"), F.lit(12.0))
    in_title = (F.col("y0") >= F.col("t0") - _Y_SLACK) & (F.col("y1") <= F.col("t1") + _Y_SLACK)
    in_author = (F.col("y0") >= F.col("a0") - _Y_SLACK) & (F.col("y1") <= reach + _Y_SLACK)
    block = lines.filter(F.col("page_num") <= 2).join(first, ["doc_id", "page_num"])
    return block.filter(F.coalesce(in_title, F.lit(False)) | F.coalesce(in_author, F.lit(False))).select(
        "doc_id", "page_num", "x0", "y0", "x1", "y1", "text"
    )


# fixed values: what ends an author block, and labels that are not one
_INSTITUTION_START = r"^\s*(?:Department|Institute|University|School|Center|College|Lab|Faculty|Correspondence)"
_NO_AUTHOR_BLOCKS = ["Authors", "Graphical abstract", "Highlights", "In Brief", "Correspondence", "Summary"]


def author_block(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, authors): author list from the first two pages.

    Ladder: the block under an "Authors" label (from page two when it is cut by an ellipsis),
    then the first dotted, comma-separated or single-name block below the title.
    ``titles``: doc_id, title_bottom (y of the title's lower edge, 0 when unknown).
    """
    early = lines.filter(F.col("page_num") <= 1).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_num", "y0", "x0", "y1", T.squeeze(F.col("text")).alias("text")))).alias("l")
    ).join(titles, "doc_id", "left")
    l = F.col("l")
    label = F.try_element_at(F.filter(l, lambda b: (b["page_num"] == 0) & (b["text"] == "Authors")), F.lit(1))
    under = F.try_element_at(
        F.filter(
            l,
            lambda b: (b["page_num"] == 0) & (F.abs(b["x0"] - F.col("label.x0")) < 50)
            & (b["y0"] - F.col("label.y1") > 0) & (b["y0"] - F.col("label.y1") < 30),
        ),
        F.lit(1),
    )
    cut = F.col("under.text").rlike(r"\.\.\.|…")
    second = F.try_element_at(
        F.filter(
            F.transform(F.filter(l, lambda b: b["page_num"] == 1), lambda b: N.authors_by_superscript(b["text"])),
            lambda a: F.size(a) >= 3,
        ),
        F.lit(1),
    )
    candidates = F.filter(
        l,
        lambda b: (b["page_num"] == 0) & (b["y0"] >= F.coalesce("title_bottom", F.lit(0.0))) & (b["y0"] <= _AUTHOR_BOTTOM)
        & ~b["text"].isin(*_NO_AUTHOR_BLOCKS) & ~b["text"].startswith("d ") & ~b["text"].rlike(_INSTITUTION_START),
    )

    def read(b: Column) -> Column:
        text = b["text"]
        single = F.regexp_replace(text, r"[\s*]+$", "")
        commas = N.authors_by_comma(text)
        return (
            F.when(F.contains(text, F.lit("·")), N.authors_by_dot(text))
            .when(F.contains(text, F.lit(",")) & text.rlike(r"[A-Z][a-z]+\s+[A-Z]") & (F.size(commas) >= 2), commas)
            .when(single.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$") & (F.length(single) < 60), F.array(single))
        )

    below = F.try_element_at(
        F.filter(F.transform(candidates, read), lambda a: F.coalesce(F.size(a) > 0, F.lit(False))), F.lit(1)
    )
    labelled = early.withColumn("label", label).withColumn("under", under)
    under_names = N.authors_by_comma(F.col("under.text"))
    return labelled.select(
        "doc_id",
        F.coalesce(
            F.when(~cut & (F.size(under_names) > 0), under_names), F.when(cut, second), below
        ).alias("authors"),
    )
