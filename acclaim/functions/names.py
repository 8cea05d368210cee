"""Person names: surnames, abbreviations, author lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acclaim import fixed
from acclaim.functions.once import let
from acclaim.functions.text import has_han, strip


def _words(name: Column) -> Column:
    return F.split(F.trim(name), r"\s+")


def _surname_index(words: Column) -> Column:
    """0-based start of the surname: the first particle between first and last word, else the last word."""
    particles = F.array(*[F.lit(p) for p in fixed.NAME_PARTICLES])
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    flags = F.transform(inner, lambda w: F.array_contains(particles, F.lower(w)))
    at = F.array_position(flags, F.lit(True)).cast("int")
    return F.when(at > 0, at).otherwise(F.size(words) - 1)


def surname(name: Column) -> Column:
    """Han names whole; "Last, First" -> Last; else the last word with its particles."""
    return let(name, _surname)


def _surname(name: Column) -> Column:
    words = _words(name)
    index = _surname_index(words)
    return (
        F.when(has_han(name), F.trim(name))
        .when(F.contains(name, F.lit(",")), F.trim(F.substring_index(name, ",", 1)))
        .when(F.size(words) <= 1, F.trim(name))
        .otherwise(F.array_join(F.slice(words, index + 1, F.size(words)), " "))
    )


def short_surname(name: Column) -> Column:
    """Text before the comma, else the last word (no particles)."""
    return F.when(F.contains(name, F.lit(",")), F.trim(F.substring_index(name, ",", 1))).otherwise(
        F.element_at(_words(name), -1)
    )


def _initials(given: Column) -> Column:
    parts = F.filter(F.split(F.trim(given), r"\s+"), lambda p: F.length(p) > 0)
    return F.array_join(F.transform(parts, lambda p: F.upper(F.substring(p, 1, 1))), "")


def abbreviate(name: Column) -> Column:
    """GB/T 7714 form: "Oleg Borodin" and "Borodin, Oleg" -> "Borodin O"."""
    return let(name, _abbreviate)


def _abbreviate(name: Column) -> Column:
    bare = F.trim(name)
    words = _words(name)
    index = _surname_index(words)
    comma_initials = _initials(F.replace(F.regexp_replace(bare, r"^[^,]*,", ""), F.lit("."), F.lit(" ")))
    plain_initials = _initials(F.array_join(F.slice(words, 1, index), " "))
    return (
        F.when(bare == "", name)
        .when(has_han(bare), bare)
        .when(
            F.contains(bare, F.lit(",")),
            F.trim(F.concat(F.trim(F.substring_index(bare, ",", 1)), F.lit(" "), comma_initials)),
        )
        .when(F.size(words) == 1, bare)
        .when(bare.rlike(r"^\S+(?:\s+\p{Lu})+$"), bare)
        .otherwise(
            F.trim(F.concat(F.array_join(F.slice(words, index + 1, F.size(words)), " "), F.lit(" "), plain_initials))
        )
    )


def abbreviate_list(names: Column) -> Column:
    return F.array_join(F.transform(names, abbreviate), ", ")


def self_names(authors: Column) -> Column:
    """Names of a paper's own authors, as full names plus surnames, from one delimited string."""
    names = F.filter(F.transform(F.split(authors, "[,;]"), lambda n: strip(n)), lambda n: n != "")

    def forms(name: Column) -> Column:
        words = _words(name)
        first, last = words[0], F.element_at(words, -1)
        shouted = (F.upper(first) == first) & (F.lower(first) != first) & (F.length(first) > 1)
        extra = F.when(shouted, F.array(F.initcap(first), first)).otherwise(F.array(last, F.initcap(last)))
        return F.when(F.size(words) >= 2, F.concat(F.array(name), extra)).otherwise(F.array(name))

    empty = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.flatten(F.transform(names, forms))), empty)


def drop_placeholders(names: Column) -> Column:
    """Remove "et al." entries from an author list."""
    return F.filter(names, lambda a: ~F.lower(F.trim(a)).isin(*fixed.PLACEHOLDER_AUTHORS))


def split_author_list(text: Column, separator: str = r",\s+(?=[A-Z][a-z])") -> Column:
    """Split "Surname, I., Surname2, I." on commas before a new surname; "et al." and 等 go."""
    bare = F.regexp_replace(text, r"(?i)，等$|[,，]?\s*et\s*al\.?$", "")
    return F.filter(
        F.transform(F.split(bare, separator), lambda a: F.regexp_replace(F.trim(a), ",+$", "")), lambda a: a != ""
    )


# fixed values: words that stand where an author list is looked for
_NON_NAMES = ["authors", "correspondence", "highlights", "graphical abstract", "in brief"]


def _unmarked(line: Column) -> Column:
    """An author line without footnote marks: raised or lowered digits, and plain digits behind a letter."""
    bare = F.regexp_replace(line, r"[\x{b2}\x{b3}\x{b9}\x{2070}-\x{209f}]|(?<=\p{L})\d{1,2}(?:,\d{1,2})*(?!\d)", "")
    return F.translate(bare, "\u00a0", " ")


def authors_by_dot(line: Column) -> Column:
    """Names between middle dots."""
    parts = F.transform(F.split(_unmarked(line), "[·•]"), lambda n: strip(n))
    return F.filter(parts, lambda n: n.rlike(r"^.*\D.*$") & (F.length(n) > 1))


def authors_by_comma(line: Column) -> Column:
    """Names between commas, "and" and ellipses."""
    parts = F.split(_unmarked(line), r",|…|\.{3}|(?<=\s)and(?=\s)")
    names = F.transform(parts, lambda n: F.regexp_replace(strip(n), r"^\.+|\.+$", ""))
    return F.filter(names, lambda n: (F.length(n) > 2) & n.rlike(r"^\p{Lu}") & ~F.lower(n).isin(*_NON_NAMES))


def authors_by_superscript(line: Column) -> Column:
    """"Kun Wang,1,17 Jun Wang,2,3" -> distinct names in order; only names with numbers behind them count."""
    parts = F.split(F.regexp_replace(line, r"\*|\band\s", ""), r"(?:\s*,\s*\d+)+[\s,]*")
    numbered = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: strip(n))
    return F.array_distinct(F.filter(numbered, lambda n: n.rlike(r"^\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)+$")))
