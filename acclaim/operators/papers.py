"""Metadata of the paper itself, read from its text.

Every reader looks for the same few things: an identifier, a line that says where the paper
appeared, a block of title and author lines, an affiliation.  What differs between languages and
layouts is where these stand; the small readers below are shared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acclaim import fixed, schemas
from acclaim.functions import citations as C
from acclaim.functions import names as N
from acclaim.functions import text as T
from acclaim.functions.once import let, with_each_once, with_once
from acclaim.operators.enrich import country_of
from acclaim.sources.gazetteer import Gazetteer

CHINESE_SHARE, CHINESE_SHARE_MARKDOWN = 0.2, 0.1
_FIELDS = [c.strip().split(" ")[0] for c in schemas.PAPERS.split(", ")]


def is_chinese(first_page: Column, share: float = CHINESE_SHARE) -> Column:
    return T.han_share(first_page) > share


def _emit(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """PAPERS columns; what a reader does not find is null."""
    kinds = dict(c.strip().split(" ") for c in schemas.PAPERS.split(", "))
    return df.select(
        *[F.col("doc_id") if f == "doc_id" else values.get(f, F.lit(None)).cast(kinds[f]).alias(f) for f in _FIELDS]
    )


# --- shared readers ---------------------------------------------------------------


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The stripped group of the first match, null without one."""
    return F.nullif(T.strip(F.regexp_extract(text, pattern, group)), F.lit(""))


def _lines(text: Column) -> Column:
    """The lines with something on them, stripped."""
    return F.filter(F.transform(F.split(text, "\n"), lambda line: T.strip(line)), lambda line: line != "")


def _from(lines: Column, first: Column) -> Column:
    """Lines from the 0-based place ``first`` on."""
    return F.slice(lines, first + 1, F.greatest(F.size(lines) - first, F.lit(0)))


def _place(lines: Column, pattern: str) -> Column:
    """0-based place of the first line that matches; the number of lines if none does."""
    places = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(pattern), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(places, F.lit(0)), F.size(lines))


def _digit_marks_off(text: Column) -> Column:
    """Author line without footnote digits (plain, wide, superscript, subscript), asterisks and quotes."""
    return F.regexp_replace(text, r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}-\x{209f}*\"“”]", "")


def _names(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda n: T.strip(n)), lambda n: n != "")


def doi_in(text: Column) -> Column:
    """The first identifier after a label or in a link, also when it is wrapped over two lines or spaced out."""
    rejoined = F.regexp_replace(text, r"(10\.\s?\d{4,}/\S*)\n(?=\S{3,40}\.)(\S+)", "$1$2")
    found = _found(rejoined, r"(?i)(?:doi\.org/|d[o0]i\s*[：:]?\s*)(10\.\s*\d{4,}/[^\s]+)")
    return F.nullif(F.regexp_replace(F.regexp_replace(found, r"\s+", ""), r"[.,;)\\]+$", ""), F.lit(""))


def _numbered_in_chinese(text: Column, unit: str) -> Column:
    return _found(text, rf"第\s*(\d+)\s*{unit}")


def _chinese_periodical(text: Column) -> Column:
    """The longest run of Han characters that ends like a periodical's name."""
    runs = F.regexp_extract_all(text, F.lit(rf"[{T.HAN}]{{2,}}?(?:学报|杂志)"), F.lit(0))
    return F.get(F.array_sort(runs, lambda a, b: F.length(b) - F.length(a)), F.lit(0))


# --- where a paper appeared, from its running heads ---------------------------------

# fixed values: layouts of running heads, in the order they are tried
RUNNING_HEADS = (
    "{journal} ({year}) {volume}({issue})?:{range}",
    "{lead}, {year}, {journal} {volume}, {range}",
    "{journal} {volume}, {range} ... {year}",
    "{lead}, {journal} {volume}, {article} ... {year}",
    "{journal} {volume} ({year}) {article}",
)
_PARTS = {
    "journal": r"(?<journal>[a-z]?[A-Z][\p{L}.&: -]*?)", "lead": r"[^\n]+?", "year": r"(?<year>\d{4})", "volume": r"(?<volume>\d+)",
    "issue": r"(?<issue>\d+)", "range": r"(?<pages>[A-Z]?\d+[–-][A-Z]?\d+)", "article": r"(?<pages>[A-Za-z]?\d+)(?!\d|[–-])",
}

_HEAD_FIELDS = ("journal", "year", "volume", "issue", "pages")
_FIELD_END = "\x1f"


def _head_pattern(layout: str) -> tuple[str, list[str]]:
    """A layout as a line pattern, with the order of its fields."""
    pattern, fields = r"(?m)^", []
    for piece in re.split(r"(\{\w+\}|\(\{issue\}\)\?| \.\.\. | )", layout):
        if piece == "({issue})?":
            pattern += rf"(?:\({_PARTS['issue']}\))?"
            fields.append("issue")
        elif piece.startswith("{"):
            pattern += _PARTS[piece[1:-1]]
            fields += re.findall(r"\?<(\w+)>", _PARTS[piece[1:-1]])
        elif piece == " ... ":
            pattern += r"\b[\s\S]{0,60}?\b"
        elif piece == " ":
            pattern += r"\s*"
        else:
            pattern += re.escape(piece).replace(":", r"\s*:?\s*")
    return re.sub(r"\?<\w+>", "", pattern), fields


def _running_head(heads: Column) -> Column:
    """Journal, year, volume, issue, pages (an array, empty where not given) of the first known layout that fits; null if none does.

    A layout is looked for once, and its fields are read in one go from the text that begins where it fits.
    """

    def read(layout: str) -> Column:
        pattern, fields = _head_pattern(layout)
        whole = pattern + "(?s:.*)"
        # no field can hold the separator
        row = _FIELD_END.join(f"${fields.index(f) + 1}" if f in fields else "" for f in _HEAD_FIELDS)
        return let(F.regexp_extract(heads, whole, 0), lambda text: F.when(text != "", F.split(F.regexp_replace(text, whole, row), _FIELD_END)))

    return F.coalesce(*[read(layout) for layout in RUNNING_HEADS])


def english_journal_line(heads: Column, head: Column | None = None) -> dict[str, Column]:
    """Journal, year, volume, issue, pages from the first running head of a known layout; else a year in parentheses.

    ``head``: the running head of ``heads``, where it has been read before.
    """
    head = _running_head(heads) if head is None else head
    out = {f: F.nullif(T.strip(head[i]), F.lit("")) for i, f in enumerate(_HEAD_FIELDS)}
    out["journal"], out["pages"] = T.squeeze(out["journal"]), C.plain_dashes(out["pages"])
    out["year"] = F.coalesce(out["year"], _found(heads, r"\((\d{4})\)"))
    return out


def page_heads(pages: DataFrame, lines: int = 2) -> DataFrame:
    """(doc_id, heads): the last lines of page 0, then the first lines of pages 1 to 3, one below the other.

    ``pages``: doc_id, page_num, text.  Running heads and feet stand there.
    """
    first = lambda shown: F.when(F.col("page_num") == 0, F.greatest(F.size(shown) - lines, F.lit(0)) + 1).otherwise(1)
    part = let(_lines(F.col("text")), lambda shown: F.array_join(F.slice(shown, first(shown), F.lit(lines)), "\n"))
    # four short texts a paper
    few = pages.filter(F.col("page_num").between(0, 3)).select("doc_id", "page_num", part.alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("page_num", "part")))
    return few.groupBy("doc_id").agg(ordered.alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("heads"))


# --- readers ------------------------------------------------------------------------


def chinese_metadata(texts: DataFrame) -> DataFrame:
    """``texts``: doc_id, full_text, first_page, last_page.

    Title and authors are the lines between the article number and the affiliation in parentheses;
    the last of them names the authors.  The article number itself gives start page and page count.
    """
    full, first, last = F.col("full_text"), F.col("first_page"), F.col("last_page")
    lines = _lines(first)
    number_at = _place(lines, "文章编号")
    below = _from(lines, number_at + 1)
    block = F.slice(below, 1, _place(below, "^[（(]"))
    has_authors = F.element_at(block, -1).rlike(rf"^[{T.HAN}·\p{{Nd}}\x{{b2}}\x{{b3}}\x{{b9}}*\s]{{2,12}}(?:[，,]|$)") & (F.size(block) > 1)
    authors = F.when(has_authors, _names(_digit_marks_off(F.element_at(block, -1)), "[，,]"))
    title_lines = F.when(has_authors, F.slice(block, 1, F.size(block) - 1)).otherwise(block)
    title = F.regexp_replace(F.array_join(title_lines, ""), r"\*+$", "")
    code = r"文章编号[：:]?\s*\d{4}-\d{3}[\dXx]\(\d{4}\)\d+-(\d+)-(\d+)"
    affiliation = F.get(_from(below, _place(below, "^[（(]")), F.lit(0))
    institution = _found(affiliation, rf"^[（(]\s*\d*[.．]?\s*(.+?)[，,]\s*[{T.HAN}]+\s*\d{{6}}")
    periodical = _chinese_periodical(first)
    abstract_title = F.get(F.filter(_lines(last), lambda x: x.rlike(r"^[A-Z][A-Za-z][^\[\]]{20,130}$") & ~x.rlike(r"[.:;]$")), F.lit(0))
    return _emit(texts, {
        "title_cn": F.nullif(title, F.lit("")), "title_en": abstract_title,
        "authors_cn": authors, "first_author_cn": F.try_element_at(authors, F.lit(1)),
        "journal_cn": periodical,
        "journal_en": F.when(periodical.isNull(), T.squeeze(_found(first, r"(?i)(Journal\s+of\s+[\p{L}\s]+?)(?=\s*(?:\d{4}|\n|$))"))),
        "year": _found(full, r"(\d{4})\s*年\s*\d{1,2}\s*月"),
        "volume": F.coalesce(_numbered_in_chinese(first, "卷"), _found(first, r"Vol\.\s*(\d+)")),
        "issue": F.coalesce(_numbered_in_chinese(first, "期"), _found(first, r"No\.\s*(\d+)")),
        "pages": C.page_range(_found(first, code, 1), _found(first, code, 2)),
        "institution_cn": institution, "country": F.when(institution.isNotNull(), "中国"), "doi": doi_in(full),
    })


def clean_institution(text: Column) -> Column:
    """One line without an e-mail at its end; section headings are rejected."""
    heading = lambda line: F.lower(F.regexp_extract(line, r"^(\S+)", 1)).isin(*fixed.SECTION_WORDS)
    return let(T.squeeze(F.regexp_replace(text, r"[\w.-]+@[\w.-]+\s*$", "")), lambda line: F.when(~heading(line) & (line != ""), line))


_BLOCK_END = r"^(?:\d+\s*[A-Z]|Received|\*|https?://)"


def _closed_block(opened: Column) -> Column:
    """The first of these lines and those below it up to the end of its block; null without an end."""
    rest = _from(opened, F.lit(1))
    block = lambda end: F.array_join(F.concat(F.slice(opened, 1, 1), F.slice(opened, 2, end)), " ")
    return let(_place(rest, _BLOCK_END), lambda end: F.when(end < F.size(opened) - 1, block(end)))


def institution_ladder(text: Column) -> Column:
    """Affiliation 1: a line that starts with its number, lines up to affiliation 2, or the first line that names an institution."""

    def ladder(lines: Column) -> Column:
        numbered = F.get(F.filter(lines, lambda x: x.rlike(r"^1[\t ]+\S")), F.lit(0))
        opened = let(_place(lines, r"^1\s*[A-Z][A-Za-z]"), lambda first: _from(lines, first))
        block = let(opened, _closed_block)
        named = F.get(F.filter(lines, lambda x: x.rlike(rf"(?i){'|'.join(fixed.INSTITUTION_WORDS)}")), F.lit(0))
        return F.coalesce(
            clean_institution(F.regexp_replace(numbered, r"^1[\t ]+", "")), clean_institution(F.regexp_replace(block, r"^1\s*", "")),
            let(named, lambda line: F.when(F.length(line) > 10, clean_institution(line))),
        )

    return let(_lines(text), ladder)


def english_metadata(texts: DataFrame, gazetteer: Gazetteer | None = None) -> DataFrame:
    """``texts``: doc_id, full_text, first_page; optional title and authors from the layout, heads from ``page_heads``."""
    first = F.col("first_page")
    heads = F.concat_ws("\n", first, F.col("heads")) if "heads" in texts.columns else first
    texts = with_each_once(texts, _heads=heads, _head=_running_head(heads))
    line = english_journal_line(F.col("_heads"), F.col("_head"))
    title = F.col("title") if "title" in texts.columns else F.lit(None).cast("string")
    authors = F.col("authors") if "authors" in texts.columns else F.lit(None).cast("array<string>")
    # the country is looked for many times in it, so it is evaluated before
    texts = with_once(texts, "_institution", institution_ladder(first))
    institution = F.col("_institution")
    return _emit(texts, {
        "title_en": title, "authors_en": authors, "first_author_en": F.try_element_at(authors, F.lit(1)),
        "journal_en": line["journal"], "year": line["year"], "volume": line["volume"], "issue": line["issue"],
        "pages": line["pages"], "institution_en": institution,
        "country": country_of(institution, gazetteer, last_part=False), "doi": doi_in(F.col("full_text")),
    })


def markdown_metadata(texts: DataFrame) -> DataFrame:
    """Metadata from markdown (``doc_id, full_text``): the first ``# `` heading, and the lines below it."""
    full = F.col("full_text")
    chinese = is_chinese(full, CHINESE_SHARE_MARKDOWN)
    lines = _lines(full)
    below = _from(lines, _place(lines, r"^#\s+\S") + 1)
    title = _found(F.get(lines, _place(lines, r"^#\s+\S")), r"^#\s+(.+)$")
    line = english_journal_line(full)
    chinese_line = F.get(F.filter(lines, lambda x: x.rlike(rf"^[{T.HAN}]{{2,4}}(?:[，,][{T.HAN}]{{2,4}})+$")), F.lit(0))
    chinese_names = _names(chinese_line, "[，,]")
    dotted = N.authors_by_dot(F.get(F.filter(below, lambda x: x.rlike(r"^[A-Z][^·•]+[·•]\s*[A-Z]")), F.lit(0)))
    listed = F.transform(
        _names(F.regexp_replace(_digit_marks_off(F.get(below, F.lit(0))), r"\\", ""), r",\s*"), lambda n: F.regexp_replace(n, r"^and\s+", "")
    )
    listed = F.filter(listed, lambda n: n.rlike(r"^[A-Z][\p{L}.-]+(?:\s+[\p{L}.-]+)+$"))
    english_names = F.coalesce(dotted, F.when(F.size(listed) >= 2, listed))
    institution = _found(full, "[（(]([^（()）]*(?:大学|研究院)[^（()）]*)[）)]")

    def by_language(in_chinese: Column, in_english: Column) -> Column:
        return F.when(chinese, in_chinese).otherwise(in_english)

    return _emit(texts, {
        "title_cn": F.when(chinese, title), "title_en": F.when(~chinese, title),
        "authors_cn": F.when(chinese, chinese_names), "authors_en": F.when(~chinese, english_names),
        "first_author_cn": F.when(chinese, F.try_element_at(chinese_names, F.lit(1))),
        "first_author_en": F.when(~chinese, F.try_element_at(english_names, F.lit(1))),
        "journal_cn": F.when(chinese, _chinese_periodical(full)), "journal_en": F.when(~chinese, line["journal"]),
        "year": by_language(F.coalesce(_found(full, r"(\d{4})\s*年"), line["year"]), line["year"]),
        "volume": by_language(_numbered_in_chinese(full, "卷"), line["volume"]),
        "issue": by_language(_numbered_in_chinese(full, "期"), line["issue"]),
        "pages": F.when(~chinese, line["pages"]),
        "institution_cn": F.when(chinese, institution), "country": F.when(chinese & institution.isNotNull(), "中国"),
        "doi": doi_in(full),
    })


def html_as_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages as text: the first ``<h1>`` becomes the ``# `` heading, tags go, entities are read."""
    heading = F.regexp_extract(F.col(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    no_code = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>|<head\b.*?</head>|<h1[^>]*>.*?</h1>", " ")
    blocks = F.regexp_replace(no_code, r"(?i)</(?:p|div|li|h\d|article|section|tr)>|<br\s*/?>", "\n")

    def plain(value: Column) -> Column:
        out = F.regexp_replace(value, r"(?s)<[^>]*>", "")
        for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            out = F.replace(out, F.lit(safe), F.lit(raw))
        return out

    title = T.squeeze(plain(heading))
    return pages.withColumn(
        "full_text", F.concat(F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(""), T.strip(plain(blocks)))
    )


def paper_authors(papers: DataFrame) -> DataFrame:
    """(doc_id, authors_str): Chinese names win."""
    names = F.when(F.size(F.coalesce("authors_cn", F.array().cast("array<string>"))) > 0, F.col("authors_cn")).otherwise(
        F.col("authors_en")
    )
    return papers.select("doc_id", F.array_join(names, ", ").alias("authors_str"))
