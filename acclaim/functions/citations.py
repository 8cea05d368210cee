"""Citation numbers, identifiers and citation strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acclaim.functions.once import let
from acclaim.functions.names import abbreviate, abbreviate_list

_MARK = r"\[(\d+(?:\s*[,，\-–~～]\s*\d+)*)\]"
# Numbers of more digits are no places in a reference list, and a range between them is just its ends.
_DIGITS = 6


def _expand(part: Column) -> Column:
    ends = F.transform(F.split(part, r"\s*[\-–~～]\s*"), lambda e: e.try_cast("int"))
    return let(ends, _between)


def _between(ends: Column) -> Column:
    low, high = ends[0], F.element_at(ends, -1)
    return (
        F.when(F.size(ends) == 1, F.array(low))
        .when(high >= 10**_DIGITS, F.array(low, high))
        .when(low <= high, F.sequence(low, F.greatest(low, F.least(high, F.lit(10**_DIGITS)))))
        .otherwise(F.array().cast("array<int>"))
    )


def numbers_in_marks(text: Column) -> Column:
    """All numbers in ``[2,4-6]`` marks, ranges expanded, in text order with repeats."""
    marks = F.regexp_extract_all(text, F.lit(_MARK), F.lit(1))

    def of_mark(mark: Column) -> Column:
        parts = F.split(F.trim(mark), r"\s*[,，]\s*")
        # one number alone, as most marks have it, is not cut up
        return F.when(mark.rlike(r"^\d+\z"), F.array(mark.try_cast("int"))).otherwise(F.flatten(F.transform(parts, _expand)))

    numbers = F.flatten(F.transform(marks, of_mark))
    return F.filter(numbers, lambda n: n.isNotNull())


def citation_numbers(text: Column) -> Column:
    """Distinct citation numbers, ascending."""
    return F.array_sort(F.array_distinct(numbers_in_marks(text)))


def numbers_after(text: Column, position: Column, window: int) -> Column:
    """Numbers of the marks that lie within ``window`` characters after a position."""
    return let(
        F.substring(text, position + 1, F.lit(window)),
        lambda near: F.when(F.contains(near, F.lit("[")), numbers_in_marks(near)).otherwise(F.array().cast("array<int>")),
    )


def remove_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\d+(?:[,，\-–~～]\d+)*\]", "")


def doi(text: Column) -> Column:
    """Labelled DOI, else a bare one; trailing dots removed; null when absent."""
    labelled = F.regexp_extract(text, r"(?:DOI|doi)[：:\s]*\s*(10\.\d{4,}/\S+)", 1)
    bare = F.regexp_extract(text, r"(10\.\d{4,}/\S+)", 1)
    found = F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(bare, F.lit("")))
    return F.when(F.contains(text, F.lit("10.")), F.regexp_replace(found, r"\.+$", ""))


def plain_dashes(pages: Column) -> Column:
    return F.translate(pages, "–", "-")


def page_range(start: Column, count: Column) -> Column:
    """First page and page count -> "first-last"."""
    first = start.try_cast("int")
    return F.concat(first.cast("string"), F.lit("-"), (first + count.try_cast("int") - 1).cast("string"))


def _some(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _part(value: Column, before: str = "", after: str = "") -> Column:
    """The value with decoration, or nothing when it is missing."""
    return F.when(_some(value) != "", F.concat(F.lit(before), value, F.lit(after))).otherwise(F.lit(""))


def volume_issue(volume: Column, issue: Column) -> Column:
    return F.when(_some(volume) != "", F.concat(volume, _part(issue, "(", ")"))).otherwise(F.lit(""))


def paper_citation(authors: Column, title: Column, journal: Column, year: Column, volume: Column, issue: Column,
                   pages: Column) -> Column:
    """Full citation of the reviewing paper."""
    return F.concat(
        _some(authors), F.lit(". "), _some(title), F.lit("[J]. "), _some(journal), F.lit(", "), _some(year),
        _part(volume_issue(volume, issue), ", "), _part(pages, ": "), F.lit("."),
    )


def journal_year_volume(journal: Column, year: Column, volume: Column, issue: Column, pages: Column) -> Column:
    return F.concat(
        _some(journal), _part(year, ", "), _part(volume_issue(volume, issue), ", "), _part(pages, ": "), F.lit(".")
    )


def volume_issue_pages(volume: Column, issue: Column, pages: Column, full_stop: bool = False) -> Column:
    text = F.concat(volume_issue(volume, issue), _part(pages, ": "))
    return F.when(text != "", F.concat(text, F.lit("."))).otherwise(text) if full_stop else text


def _author_text(authors: Column, first_author: Column) -> Column:
    return F.when(F.size(F.coalesce(authors, F.array().cast("array<string>"))) > 0, abbreviate_list(authors)).otherwise(
        _some(abbreviate(first_author))
    )


def evaluated_citation(authors: Column, first_author: Column, title: Column, journal: Column, year: Column,
                       volume: Column, issue: Column, pages: Column, named: Column | None = None) -> Column:
    """Full citation of the evaluated paper, register form.  ``named``: the authors as they are cited, where that is known."""
    return F.concat(
        _author_text(authors, first_author) if named is None else named, _part(title, ". ", "[J]."), _part(journal, " ", ","), _part(year, " ", ","),
        _part(volume_issue(volume, issue), " "), _part(pages, ": "), F.lit("."),
    )


def evaluated_citation_form(authors: Column, first_author: Column, title: Column, journal: Column, year: Column,
                            volume: Column, issue: Column, pages: Column) -> Column:
    """Same for the registration form: the colon belongs to the volume."""
    return F.concat(
        _author_text(authors, first_author), _part(title, ". ", "[J]."), _part(journal, " ", ","), _part(year, " ", ","),
        _part(volume_issue(volume, issue), " ", ":"), _some(pages), F.lit("."),
    )


def form_journal_line(journal: Column, year: Column, volume: Column, issue: Column, pages: Column) -> Column:
    """Form line ``J, Y, V(I): P.``; empty without a journal."""
    return F.when(
        _some(journal) != "",
        F.concat(journal, F.lit(", "), _some(year), F.lit(", "), volume_issue(volume, issue), F.lit(": "), _some(pages),
                 F.lit(".")),
    ).otherwise(F.lit(""))


def title_tokens(title: Column) -> Column:
    """Distinct lower-case words of a title, punctuation treated as space."""
    return F.array_distinct(
        F.filter(F.split(F.regexp_replace(F.lower(title), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda t: t != "")
    )


def token_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 when either is empty or missing."""
    union = F.size(F.array_union(left, right))
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / union
    ).otherwise(F.lit(0.0))


def title_similarity(left: Column, right: Column) -> Column:
    return token_similarity(title_tokens(left), title_tokens(right))
