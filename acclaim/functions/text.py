"""Text normalisation as Column -> Column functions.  Nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acclaim import fixed
from acclaim.functions.once import let

HAN = r"\x{4e00}-\x{9fff}"
_PARAGRAPH = "\u001f"
_SPACE = " \t\n\r\u000b\u000c\u00a0\u2002\u2003\u3000"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(_SPACE))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(_SPACE))


def fold_ligatures(text: Column) -> Column:
    """Replace the seven presentation-form ligatures by their letters."""
    def replaced(pairs: list[tuple[str, str]]) -> Column:
        plain = text
        for ligature, letters in pairs:
            plain = F.replace(plain, F.lit(ligature), F.lit(letters))
        return plain

    every = list(zip("\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06", "ff fi fl ffi ffl st st".split()))
    # most texts with a ligature have fi and fl only: a replacement reads the whole text
    return F.when(
        text.rlike("[\ufb00-\ufb06]"), F.when(text.rlike("[\ufb00\ufb03-\ufb06]"), replaced(every)).otherwise(replaced(every[1:3]))
    ).otherwise(text)


def strip_controls(text: Column, drop_tab: bool = False, drop_replacement: bool = True) -> Column:
    """Remove control characters; newline and carriage return always stay."""
    kill = r"\x00-\x08\x0b\x0c\x0e-\x1f"
    if drop_tab:
        kill += r"\x09"
    if drop_replacement:
        kill += r"\x{fffd}"
    return F.regexp_replace(text, f"[{kill}]", "")


def canonical_punctuation(text: Column, dashes: bool = True) -> Column:
    """Smart quotes and special hyphens to ASCII; soft hyphens vanish."""
    source, target = "\u201c\u201d\u2018\u2019\u2011", "\"\"''-"
    if dashes:
        source, target = source + "\u2013\u2014", target + "--"
    return F.translate(text, source + "\u00ad", target)


def repair_line_break_hyphens(text: Column) -> Column:
    """``chemi- cal`` -> ``chemical``; ``water- repellent`` -> ``water-repellent``."""
    stop = "|".join(fixed.STANDALONE_SHORT_WORDS)
    suffix = rf"(?=\p{{Ll}}\w{{0,3}}(?!\w))(?!(?i:{stop})(?!\w))"
    # the second group holds the hyphen only when it is kept
    return F.regexp_replace(text, rf"(?U)(\w+)(?:- {suffix}|(-) )(\w+)", "$1$2$3")


def balance_quotes(text: Column) -> Column:
    """A closing smart quote without any opening one gets an opening one in front."""
    return F.when(
        F.contains(text, F.lit("\u201d")) & ~F.contains(text, F.lit("\u201c")), F.concat(F.lit("\u201c"), text)
    ).otherwise(text)


def clean_artifacts(text: Column) -> Column:
    """Everything the extraction of a PDF leaves behind in a sentence or a title."""
    plain = F.translate(strip_controls(text, drop_replacement=False), "\u2011\u00ad", "-")
    return balance_quotes(repair_line_break_hyphens(plain))


# Page numbers, decorated page numbers, and volume/issue lines of fewer than 60 characters.
_NOISE_LINE = (
    r"(?md)^(?:[·\-—\s&&[^\n]]*\d{1,4}[·\-—\s&&[^\n]]*"
    r"|[ \t]*(?=[^\n]*(?:Vol\.|卷|No\.|期)[^\n]*\d{4})\S[^\n]{0,58}[ \t]*)(?:\n|\z)"
)


def drop_noise_lines(text: Column) -> Column:
    """Drop page numbers, decorated page numbers and short volume/issue lines."""
    return F.regexp_replace(text, _NOISE_LINE, "")


# One locator for the cut and for the parser: the last heading on a line of its own,
# a leading markdown "#" allowed.
_HEADING = r"(?:References?|参\s*考\s*文\s*献\s*(?:\(References\))?)\s*[：:]?\s*\n"
_HEADING_LINE = rf"(?:^|\n)[#\s]*{_HEADING}"
_NUMBERED_LIST = r"(?s)^(?:.*?\n)?(1\.\s+[A-Z][a-z]+,.*\n2\.\s+[A-Z][a-z]+,.*)$"


def body_text(text: Column) -> Column:
    """The text before the reference section."""
    return F.when(
        text.rlike(rf"(?i){_HEADING_LINE}"), F.regexp_extract(text, rf"(?is)^(.*){_HEADING_LINE}", 1)
    ).otherwise(text)


def references_section(text: Column) -> Column:
    """The text from the last reference heading on, or from an unheaded numbered list; null when absent."""
    headed = F.regexp_extract(text, rf"(?is)^.*(?:^|\n)[#\s]*({_HEADING}.*)$", 1)
    listed = F.regexp_extract(text, _NUMBERED_LIST, 1)
    return F.when(text.rlike(rf"(?i){_HEADING_LINE}"), headed).otherwise(F.nullif(listed, F.lit("")))


def merge_wrapped_lines(text: Column) -> Column:
    """Blank lines become one newline, single newlines a space, runs of spaces one space."""
    unix = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    marked = F.regexp_replace(unix, r"\n\s*\n", _PARAGRAPH)
    spaced = F.regexp_replace(marked, r"\n[ \n]*| [ \n]+", " ")
    return strip(F.replace(spaced, F.lit(_PARAGRAPH), F.lit("\n")))


def mark_section_headings(text: Column) -> Column:
    """Put a full stop before a numbered heading (two levels or more) unless one is there."""
    blank = r"[\s\x{2002}\x{2003}]"
    # the cheap look-ahead comes first: it fails at once on ordinary characters
    return F.regexp_replace(
        text,
        rf"(?={blank}+\d+(?:\.\d+)+\.?{blank}+[\x00-\x1f]*[A-Z{HAN}\"“”])"
        rf"(?<!{blank})(?<![.。!?！？][ \t\x{{2002}}\x{{2003}}]{{0,8}})",
        ".",
    )


def strip_heading_prefix(text: Column) -> Column:
    """Remove a numbered heading left at the start of a sentence."""
    number = r"\d+(?:\.\d+)+\.?"
    first_gap = F.regexp_extract(text, rf"^({number}\s{{2,}}.+?\s{{2,}})", 1)
    cut_spaced = F.when(F.length(first_gap) > 0, F.substring(text, F.length(first_gap) + 1, F.length(text)))
    bracketed = rf"^({number}\s+(.+?\))\s+)(?=[A-Z\"“])"
    prefix = F.regexp_extract(text, bracketed, 1)
    title = F.regexp_extract(text, bracketed, 2)
    cut_bracketed = F.when(
        (F.length(prefix) > 0) & (F.length(title) < 120), F.substring(text, F.length(prefix) + 1, F.length(text))
    )
    usable = cut_spaced.rlike(r"^[\p{Lu}\"“”]")
    return F.when(text.rlike(rf"^{number}\s"), F.coalesce(F.when(usable, cut_spaced), cut_bracketed, text)).otherwise(
        text
    )


def clean_sentence(text: Column) -> Column:
    return strip_heading_prefix(clean_artifacts(text))


def canonical_marker(marker: Column) -> Column:
    """``first reported`` -> ``first``; single words are kept."""
    verbs = "|".join(fixed.STRIPPABLE_VERBS)
    return F.regexp_replace(F.trim(marker), rf"(?is)^(.+?)\s+(?:{verbs})$", "$1")


def trim_marker_edges(marker: Column) -> Column:
    """``was first proposed by`` -> ``first proposed``."""
    left = "|".join(fixed.MARKER_EDGE_PREFIXES)
    right = "|".join(fixed.MARKER_EDGE_SUFFIXES)
    return F.trim(
        F.regexp_replace(
            F.regexp_replace(F.trim(marker), rf"(?i)^(?:(?:{left})\s+)+", ""), rf"(?i)(?:\s+(?:{right}))+$", ""
        )
    )


def squeeze(text: Column) -> Column:
    # a single blank is left alone: most texts then need no rewriting
    return F.trim(F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def has_han(text: Column) -> Column:
    return text.rlike(f"[{HAN}]")


def han_share(text: Column) -> Column:
    """Share of Han characters, 0 for an empty text."""
    return F.coalesce(
        F.length(F.regexp_replace(text, f"[^{HAN}]", "")) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)
    )


def blank_to_null(value: Column) -> Column:
    """Empty or blank strings are missing values inside the library."""
    return F.when(F.trim(value) != "", value)


def prefix(text: Column, n: int, ellipsis: str = "") -> Column:
    """First n characters, with an optional mark when something was cut."""
    cut = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(cut, F.lit(ellipsis))).otherwise(cut) if ellipsis else cut


def first_json_object(text: Column) -> Column:
    """First balanced JSON object in free text, braces inside strings ignored.

    Falls back to "first { to last }" when the braces never balance.
    """
    bare = F.regexp_replace(F.trim(text), r"^```[^\n]*\n|```$", "")

    def step(acc: Column, ch: Column) -> Column:
        escaped = acc["esc"]
        in_str = acc["in_str"]
        depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)

        def state(depth: Column, in_str: Column, esc: Column, done: Column) -> Column:
            return F.struct(
                depth.alias("depth"), in_str.alias("in_str"), esc.alias("esc"), (acc["n"] + 1).alias("n"), done.alias("done")
            )

        no, yes = F.lit(False), F.lit(True)
        # most pieces lie in a string or are plain text: they come before the braces
        return (
            F.when(acc["done"], acc)
            .when(ch == '"', state(acc["depth"], F.when(escaped, in_str).otherwise(~in_str), no, no))
            .when(in_str, state(acc["depth"], yes, (ch == "\\") & ~escaped, no))
            .when(ch.isin("{", "}"), state(depth, no, no, (depth == 0) & (ch == "}")))
            .otherwise(state(acc["depth"], no, no, no))
        )

    init = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("in_str"), F.lit(False).alias("esc"), F.lit(0).alias("n"),
        F.lit(False).alias("done"),
    )

    def cut(pieces: Column) -> Column:
        # only structural characters matter: walk quotes, backslashes and braces with the text between them
        return let(
            F.aggregate(pieces, init, step),
            lambda walk: F.when(walk["done"], F.array_join(F.slice(pieces, 1, walk["n"]), "")),
        )

    def from_brace(tail: Column) -> Column:
        pieces = F.regexp_extract_all(tail, F.lit(r"[{}\"\\]|[^{}\"\\]+"), F.lit(0))
        to_last = F.nullif(F.regexp_extract(tail, r"(?s)^(\{.*\})", 1), F.lit(""))
        return F.when(F.length(tail) > 0, F.coalesce(let(pieces, cut), to_last, tail))

    return F.coalesce(let(F.regexp_extract(bare, r"(?s)(\{.*)$", 1), from_brace), bare)


def quoted_part(text: Column, length: int | None) -> Column:
    """The first ``length`` characters, or the whole text where no length is given."""
    return text if length is None else F.substring(text, 1, length)
