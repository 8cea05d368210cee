"""Offset-aware matching and interval helpers, as Column expressions.

Offsets are 0-based, end-exclusive code-point positions inside the given text.
``regexp_extract_all`` returns no offsets, so matches are fenced with control
characters, the text is split on the fences and lengths are summed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from acclaim.functions.once import let

_OPEN, _GROUP = "\u0001", "\u0002"
_FENCES = _OPEN + _GROUP + "\u0003"

SPAN = "struct<start:int,end:int>"


def fence_safe(text: Column) -> Column:
    """Blank out the three fence characters one for one, so offsets do not move."""
    return F.when(_has_any(text, _FENCES), F.translate(text, _FENCES, "   ")).otherwise(text)


def _has_any(text: Column, characters: str) -> Column:
    """Does the text hold one of the characters?  Told from its bytes, without a pattern."""
    return reduce(or_, [F.contains(text, F.lit(c)) for c in characters])


def find_all(text: Column, pattern: str, groups: Sequence[tuple[str, int]] = ()) -> Column:
    """All non-overlapping matches as ``array<struct<start,end,match,<groups...>>>``.

    ``groups`` names the capture groups to return; an unmatched group is "".  The text
    must be ``fence_safe``.  The text is rewritten and cut once, and the walk evaluates
    each chunk once: lambdas have no common-subexpression elimination.
    """
    body = _OPEN + "$0" + "".join(f"{_GROUP}${number}" for _, number in groups) + _GROUP
    # the first chunk is plain text; every later one is: match G g1 G g2 ... G rest.  Cutting at one
    # character needs no pattern, which would be compiled again for every chunk
    cut = F.transform(F.split(F.regexp_replace(text, pattern, body), _OPEN), lambda c: F.split(c, _GROUP))
    names = [name for name, _ in groups]
    out_type = "array<struct<start:int,end:int,match:string" + "".join(f",{n}:string" for n in names) + ">>"

    def step(acc: Column, parts: Column) -> Column:
        width = F.length(parts[0])
        hit = F.struct(
            acc["pos"].alias("start"),
            (acc["pos"] + width).alias("end"),
            parts[0].alias("match"),
            *[parts[i + 1].alias(n) for i, n in enumerate(names)],
        )
        later = F.struct(
            (acc["pos"] + width + F.length(F.element_at(parts, -1))).alias("pos"),
            F.array_append(acc["hits"], hit).alias("hits"),
        )
        return F.when(F.size(parts) == 1, F.struct(width.alias("pos"), acc["hits"].alias("hits"))).otherwise(later)

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(out_type).alias("hits"))
    return F.aggregate(cut, start, step, lambda acc: acc["hits"])


def overlaps(a: Column, b: Column) -> Column:
    """Half-open interval overlap of two structs with ``start`` and ``end``."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def keep_non_overlapping(ordered: Column, item_type: str) -> Column:
    """Greedy interval selection: walk the array in order, keep what overlaps nothing kept so far."""
    return F.aggregate(
        ordered,
        F.array().cast(f"array<{item_type}>"),
        lambda kept, item: F.when(F.exists(kept, lambda k: overlaps(k, item)), kept).otherwise(
            F.array_append(kept, item)
        ),
    )


def union_spans(spans: Column) -> Column:
    """Merge overlapping or touching ``struct<start,end>`` spans, sorted by start."""

    def step(acc: Column, span: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(
            (F.size(acc) > 0) & (span["start"] <= F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown)),
        ).otherwise(F.concat(acc, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{SPAN}>"), step)


def spans_between(pieces: Column, width: Column) -> Column:
    """Spans of equal width that separate the pieces of a split text."""

    def step(acc: Column, piece: Column) -> Column:
        begin = acc["pos"] + F.length(piece)
        span = F.struct(begin.alias("start"), (begin + width).alias("end"))
        return F.struct((begin + width).alias("pos"), F.array_append(acc["spans"], span).alias("spans"))

    init = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    return let(
        pieces, lambda p: F.aggregate(F.slice(p, 1, F.size(p) - 1), init, step, lambda acc: acc["spans"])
    )


def literal_spans(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal (column) needle; empty for a null or empty needle."""

    def find(n: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), F.replace(n, F.lit("\\E"), F.lit("")), F.lit("\\E"))
        return F.when((F.length(n) > 0) & F.contains(text, n), spans_between(F.split(text, quoted), F.length(n))).otherwise(
            F.array().cast(f"array<{SPAN}>")
        )

    return let(needle, find)


def bracket_pairs(text: Column, typed: bool) -> Column:
    """Matched bracket pairs as spans of (opener, closer) offsets.

    ``typed=False``: round brackets, ASCII and full-width pair with each other.
    ``typed=True``: round, square and lenticular brackets pair only with their own
    kind, and an unmatched opener blocks the ones below it.
    """
    pattern = r"[()（）\[\]【】]" if typed else "[()（）]"
    openers = "(（[【" if typed else "(（"
    events = find_all(text, pattern)
    state = "array<struct<ch:string,at:int>>"

    def step(acc: Column, event: Column) -> Column:
        ch = event["match"]
        is_open = F.lit(openers).contains(ch)
        top = F.try_element_at(acc["stack"], F.lit(-1))
        closes = F.size(acc["stack"]) > 0
        if typed:
            closes = closes & F.coalesce(F.translate(top["ch"], "(（[【", ")）]】") == ch, F.lit(False))
        pushed = F.array_append(acc["stack"], F.struct(ch.alias("ch"), event["start"].alias("at")))
        popped = F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))
        pair = F.struct(top["at"].alias("start"), event["start"].alias("end"))
        return F.struct(
            F.when(is_open, pushed).when(closes, popped).otherwise(acc["stack"]).alias("stack"),
            F.when(~is_open & closes, F.array_append(acc["pairs"], pair)).otherwise(acc["pairs"]).alias("pairs"),
        )

    init = F.struct(F.array().cast(state).alias("stack"), F.array().cast(f"array<{SPAN}>").alias("pairs"))
    walked = F.aggregate(events, init, step, lambda acc: acc["pairs"])
    # where pairs without a bracket inside account for all brackets, they are the answer and nothing is stacked
    shut = ["()", "（）", "[]", "【】"] if typed else ["()（）"]
    inner = pattern[1:-1]
    flat = "|".join(rf"[\{kind[::2]}][^{inner}]*+[\{kind[1::2]}]" for kind in shut)

    def flat_or_walked(hits: Column) -> Column:
        spans = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["end"] - 1).alias("end")))
        return F.when(F.regexp_count(text, F.lit(pattern)) == 2 * F.size(hits), spans).otherwise(walked)

    return F.when(
        _has_any(text, openers), let(find_all(text, flat), flat_or_walked)
    ).otherwise(F.array().cast(f"array<{SPAN}>"))


def inside(pairs: Column, position: Column, inclusive: bool = False) -> Column:
    """Is the position inside any bracket pair?"""
    if inclusive:
        return F.exists(pairs, lambda p: (p["start"] <= position) & (position <= p["end"]))
    return F.exists(pairs, lambda p: (p["start"] < position) & (position < p["end"]))


def running_starts(lengths: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an int array, in blocks so that long arrays stay near-linear."""
    return let(lengths, lambda v: _blocked_starts(v, block))


def _blocked_starts(lengths: Column, block: int) -> Column:
    n_blocks = F.ceil(F.size(lengths) / F.lit(block)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))),
        lambda b: F.slice(lengths, (b * block + 1).cast("int"), F.lit(block)),
    )

    def inner(acc: Column, n: Column) -> Column:
        return F.struct((acc["pos"] + n).alias("pos"), F.array_append(acc["out"], acc["pos"]).alias("out"))

    def outer(acc: Column, chunk: Column) -> Column:
        # acc holds one struct per block; the last one knows where the next block starts
        begin = F.coalesce(F.try_element_at(acc, F.lit(-1))["pos"], F.lit(0))
        zero = F.struct(begin.alias("pos"), F.array().cast("array<int>").alias("out"))
        return F.concat(acc, F.array(F.aggregate(chunk, zero, inner)))

    init = F.array().cast("array<struct<pos:int,out:array<int>>>")
    return F.flatten(F.transform(F.aggregate(blocks, init, outer), lambda b: b["out"]))
