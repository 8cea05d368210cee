"""Marker phrases in sentences.

Two physical strategies with the same answer:

* ``add_marker_hits`` keeps the lexicon in the plan as one constant array and works
  inside the row (no shuffle).  The lexicon size is checked first.
* ``marker_hits_by_join`` explodes word positions and equi-joins on the first word
  (or first two characters), for lexicons beyond that size.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acclaim import schemas
from acclaim.functions.once import built_once, let, with_once
from acclaim.functions.spans import fence_safe, find_all, keep_non_overlapping, running_starts, spans_between
from acclaim.functions.text import HAN
from acclaim.sources.lexicon import default_phrases

# Largest lexicon that is kept as a constant inside the plan.
MAX_INLINE_PHRASES = 20_000

_NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
_NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OCCURRENCE = "struct<rank:int,start:int,end:int,is_bare_word:boolean>"


def ascii_lower(text: Column) -> Column:
    """Lower-case that never changes the length of the text."""
    # as many bytes as characters: ASCII, whose lower case has a fast way
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


@dataclass(frozen=True)
class Lexicon:
    """A lexicon of checked size, ready to be put into expressions."""

    rows: tuple[tuple[str, str, int, bool], ...]

    @staticmethod
    @cache
    def default() -> Lexicon:
        return Lexicon(tuple(default_phrases()))

    @staticmethod
    def of(table: DataFrame) -> Lexicon | None:
        """Read a phrase table; None if it is too large for the in-row strategy and must be joined."""
        rows = table.select("phrase", "lang", "rank", "is_bare").limit(MAX_INLINE_PHRASES + 1).collect()
        return Lexicon(tuple(tuple(r) for r in rows)) if len(rows) <= MAX_INLINE_PHRASES else None

    @cache
    def gate(self) -> str:
        """Regex that matches exactly the texts with at least one hit."""
        english = {p.lower() for p, lang, *_ in self.rows if lang == "en"}
        chinese = {p for p, lang, *_ in self.rows if lang == "zh"}
        parts = []
        if english:
            parts.append(f"{_NOT_AFTER_WORD}(?i:{_alternation(_shortest_english(english))}){_NOT_BEFORE_WORD}")
        if chinese:
            parts.append(_alternation([p for p in chinese if not any(q != p and q in p for q in chinese)]))
        return "|".join(parts)

    @cache
    def longest_wins(self) -> bool:
        """Is every phrase ranked before all phrases contained in it?"""
        rank: dict[tuple[str, str], int] = {}
        for p, lang, r, _ in self.rows:
            key = (lang, p.lower() if lang == "en" else p)
            rank[key] = min(r, rank.get(key, r))
        for (lang, phrase), r in rank.items():
            units, glue = (phrase.split(" "), " ") if lang == "en" else (list(phrase), "")
            parts = (glue.join(units[i:j]) for i in range(len(units)) for j in range(i + 1, len(units) + 1))
            if any(rank.get((lang, part), r) < r for part in parts):
                return False
        return True

    @cache
    def longest_pattern(self) -> str:
        """Zero-width matches at phrase starts; group 1 or 2 is the longest phrase there."""
        heads: dict[str, list[str]] = defaultdict(list)
        chinese = []
        for phrase, lang, *_ in self.rows:
            if lang == "en":
                head, _, tail = phrase.lower().partition(" ")
                heads[head].append(tail)
            else:
                chinese.append(phrase)
        options: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for head, tails in sorted(heads.items()):
            longer = sorted({re.escape(t) for t in tails if t}, key=lambda t: (-len(t), t))
            rest = f"(?: (?:{'|'.join(longer)}){_NOT_BEFORE_WORD})" if longer else ""
            options[head[:1]][head[1:2]].append(re.escape(head[2:]) + (rest + ("?" if "" in tails else "") if rest else ""))
        parts = []
        if options:
            initials = "".join(sorted({re.escape(o[0]) for o in heads}))
            parts.append(f"(?=[{initials}]){_NOT_AFTER_WORD}(?=({_by_characters(options)}{_NOT_BEFORE_WORD}))")
        else:
            parts.append("(?!)()")
        if chinese:
            longest = sorted(set(chinese), key=lambda p: (-len(p), p))
            parts.append(f"(?=[{''.join(sorted({p[0] for p in chinese}))}])(?=({'|'.join(map(re.escape, longest))}))")
        else:
            parts.append("(?!)()")
        return "|".join(parts)

    @cache
    def bare_phrases(self) -> str:
        return "\n" + "\n".join(sorted(p.lower() for p, _, _, is_bare in self.rows if is_bare)) + "\n"

    def column(self) -> Column:
        """Constant array of struct(head, phrases), phrases = struct(phrase, pattern, width, rank, is_bare).

        Grouping by head (first word, first two Han characters) skips whole groups at once.
        """
        groups: dict[str, list[dict]] = defaultdict(list)
        for phrase, lang, rank, is_bare in self.rows:
            low = phrase.lower() if lang == "en" else phrase
            literal = re.escape(low)
            groups[low.split(" ")[0] if lang == "en" else low[:2]].append(
                {
                    "phrase": low,
                    "pattern": f"{_NOT_AFTER_WORD}{literal}{_NOT_BEFORE_WORD}" if lang == "en" else literal,
                    "width": len(phrase),
                    "rank": rank,
                    "is_bare": is_bare,
                }
            )
        entries = [{"head": head, "phrases": phrases} for head, phrases in groups.items()]
        ddl = (
            "array<struct<head:string,phrases:array<struct<"
            "phrase:string,pattern:string,width:int,rank:int,is_bare:boolean>>>>"
        )
        return F.from_json(F.lit(json.dumps(entries, ensure_ascii=False)), ddl)


def _shortest_english(phrases: set[str]) -> list[str]:
    """Drop phrases that contain another phrase as whole words: the shorter one decides existence."""
    def covered(phrase: str) -> bool:
        words = phrase.split(" ")
        return any(
            " ".join(words[i:j]) in phrases
            for i in range(len(words)) for j in range(i + 1, len(words) + 1) if j - i < len(words)
        )

    return [p for p in phrases if not covered(p)]


def _alternation(phrases: Iterable[str]) -> str:
    groups: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for phrase in sorted(phrases, key=lambda p: (-len(p), p)):
        groups[phrase[:1]][phrase[1:2]].append(re.escape(phrase[2:]))
    return _by_characters(groups)


def _by_characters(groups: dict[str, dict[str, list[str]]]) -> str:
    """Alternation by first, then second character, so that a position fails after a few steps whatever the lexicon."""
    def either(options: dict[str, str]) -> str:
        return "(?:" + "|".join(re.escape(k) + v for k, v in sorted(options.items())) + ")"

    return either({a: either({b: f"(?:{'|'.join(rest)})" for b, rest in seconds.items()}) for a, seconds in groups.items()})


def _finish_hits(text: Column, occurrences: Column) -> Column:
    """Greedy selection by (rank, start), then text order.

    Sorted by start, any overlap shows between neighbours; without one there is nothing to select.
    """
    placed = F.array_sort(
        F.transform(occurrences, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end")))
    )
    clash = let(placed, _clash)
    kept = F.when(clash, keep_non_overlapping(F.array_sort(occurrences), _OCCURRENCE)).otherwise(occurrences)
    return let(_in_text_order(kept), lambda hits: _with_text(text, hits))


def _in_text_order(kept: Column) -> Column:
    return F.array_sort(
        F.transform(
            kept,
            lambda o: F.struct(
                o["start"].alias("start"), o["end"].alias("end"), o["is_bare_word"].alias("is_bare_word")
            ),
        )
    )


def _with_text(text: Column, hits: Column) -> Column:
    return F.transform(
        hits,
        lambda o: F.struct(
            F.substring(text, o["start"] + 1, o["end"] - o["start"]).alias("marker"),
            o["start"].alias("start"), o["end"].alias("end"), o["is_bare_word"].alias("is_bare_word"),
        ),
    )


@built_once
def _longest_hits(lexicon: Lexicon) -> Column:
    """Longest phrase at every phrase start of ``_low`` that lies in no other one, in text order."""
    found = find_all(F.col("_low"), lexicon.longest_pattern(), [("en", 1), ("zh", 2)])
    spans = F.transform(
        found,
        lambda f: let(
            F.concat(f["en"], f["zh"]),
            lambda phrase: F.struct(
                f["start"].alias("start"), (f["start"] + F.length(phrase)).alias("end"),
                F.contains(F.lit(lexicon.bare_phrases()), F.concat(F.lit("\n"), phrase, F.lit("\n"))).alias("is_bare_word"),
            ),
        ),
    )
    # starts ascend, so a span is contained in an earlier one when its end does not advance
    return F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int,is_bare_word:boolean>>"),
        lambda acc, s: F.when(
            s["end"] > F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)), F.array_append(acc, s)
        ).otherwise(acc),
    )


@built_once
def _all_occurrences(lexicon: Lexicon) -> Column:
    """Every occurrence of every phrase in ``_low``."""
    low = F.col("_low")
    heads = F.filter(lexicon.column(), lambda g: F.contains(low, g["head"]))
    present = F.filter(F.flatten(F.transform(heads, lambda g: g["phrases"])), lambda p: F.contains(low, p["phrase"]))
    return F.flatten(
        F.transform(
            present,
            lambda p: F.transform(
                spans_between(F.split(low, p["pattern"]), p["width"]),
                lambda s: F.struct(
                    p["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"),
                    p["is_bare"].alias("is_bare_word"),
                ),
            ),
        )
    )


def _clash(placed: Column) -> Column:
    """Does any span overlap its right neighbour?  Spans are sorted by start."""
    return F.exists(
        F.arrays_zip(placed.alias("a"), F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(0))).alias("b")),
        lambda z: F.coalesce(z["b"]["start"] < z["a"]["end"], F.lit(False)),
    )


def has_marker(text: Column, lexicon: Lexicon | None = None) -> Column:
    return text.rlike((lexicon or Lexicon.default()).gate())


def add_marker_hits(sentences: DataFrame, lexicon: Lexicon | None = None, text: str = "text") -> DataFrame:
    """Append ``markers``, the non-overlapping hits of each sentence sorted by start."""
    lexicon = lexicon or Lexicon.default()
    low = with_once(sentences, "_low", ascii_lower(fence_safe(F.col(text))))
    col = F.col(text)
    selected = _finish_hits(col, F.col("_occ"))
    if not lexicon.longest_wins():
        every = with_once(low, "_occ", _all_occurrences(lexicon))
        return with_once(every, "markers", selected).drop("_low", "_occ")
    # The longest phrases are the answer when they keep clear of each other: whatever they
    # contain ranks behind them.  Only where they overlap must every occurrence compete.
    quick = with_once(low, "_hits", _longest_hits(lexicon))
    competing = F.when(let(F.col("_hits"), _clash), _all_occurrences(lexicon))
    every = with_once(quick, "_occ", competing)
    hits = F.when(F.col("_occ").isNull(), _with_text(col, F.col("_hits"))).otherwise(selected)
    return with_once(every, "markers", hits).drop("_low", "_hits", "_occ")


def marker_hits_by_join(
    sentences: DataFrame, lexicon: DataFrame, key: Sequence[str] = ("doc_id", "sent_idx"), text: str = "text"
) -> DataFrame:
    """Hit rows for a lexicon of any size: positions join phrases on their first word or bigram.

    Spark broadcasts the phrase table when its measured size allows and shuffles otherwise.
    """
    # Every word carries the few words a phrase can need.  They come from the neighbouring pieces of
    # the split text: a substring of the sentence would be counted from its start for every word.
    word = r"[\p{L}\p{N}_]+"
    by_sign = _by_sign(F.col("lang"), F.col("phrase"))
    sizes = lexicon.agg(
        F.max(F.regexp_count("phrase", F.lit(word))), F.max(F.length("phrase")),
        F.array_sort(F.collect_set(F.when(by_sign, F.substring("phrase", 1, 1)))),  # at most the characters there are
    ).first()
    most_words, longest, signs = sizes[0] or 1, sizes[1] or 1, sizes[2]
    safe = with_once(sentences.select(*key, F.col(text)), "_safe", fence_safe(F.col(text))).select(*key, "_safe")
    pieces = with_once(safe, "_p", F.split(F.regexp_replace("_safe", word, "\u0001$0"), "\u0001"))
    placed = F.arrays_zip(F.col("_p").alias("p"), running_starts(F.transform("_p", lambda p: F.length(p))).alias("s"))
    word_spots = F.filter(
        F.transform(
            placed,
            lambda z, i: F.struct(
                F.lit("en").alias("lang"), ascii_lower(F.regexp_extract(z["p"], f"^{word}", 0)).alias("head"),
                z["s"].alias("start"), F.array_join(F.slice("_p", i + 1, F.lit(most_words + 1)), "").alias("w"),
            ),
        ),
        lambda spot: spot["head"] != "",
    )
    han_spots = F.transform(
        F.sequence(F.lit(0), F.greatest(F.length("_safe") - 2, F.lit(0))),
        lambda i: F.struct(
            F.lit("zh").alias("lang"), F.substring("_safe", i + 1, F.lit(2)).alias("head"), i.alias("start"),
            F.substring("_safe", i + 1, F.lit(longest)).alias("w"),
        ),
    )
    phrases = lexicon.filter(~by_sign).select(
        "lang", "rank", "is_bare",
        F.when(F.col("lang") == "en", ascii_lower(F.col("phrase"))).otherwise(F.col("phrase")).alias("phrase"),
    ).withColumn(
        "head",
        F.when(F.col("lang") == "en", F.regexp_extract("phrase", r"^[\p{L}\p{N}_]+", 0)).otherwise(
            F.substring("phrase", 1, 2)
        ),
    )
    spots = pieces.select(*key, F.inline(word_spots)).unionByName(
        safe.filter(F.col("_safe").rlike(f"[{HAN}]")).select(*key, F.inline(han_spots)).filter(F.col("head").rlike(f"^[{HAN}]"))
    )
    width = F.length("phrase")
    found = F.substring("w", F.lit(1), width)
    hits = (
        spots.join(phrases, ["lang", "head"])
        .filter(F.when(F.col("lang") == "en", ascii_lower(found)).otherwise(found) == F.col("phrase"))
        .filter((F.col("lang") == "zh") | ~F.substring("w", width + 1, F.lit(1)).rlike(r"^[\p{L}\p{N}_]"))
    )
    hits = hits.select(*key, "rank", "start", "is_bare", width.alias("width"), found.alias("found"))
    if signs:
        hits = hits.unionByName(_hits_by_sign(safe, lexicon.filter(by_sign), key, signs, longest))
    width, found = F.col("width"), F.col("found")
    occurrence = F.struct(
        "rank", "start", (F.col("start") + width).cast("int").alias("end"), F.col("is_bare").alias("is_bare_word"),
        found.alias("marker"),
    )
    grouped = hits.groupBy(*key).agg(F.collect_list(occurrence).alias("_occ"))
    kind = "struct<rank:int,start:int,end:int,is_bare_word:boolean,marker:string>"

    def by_start(occurrences: Column) -> Column:
        return F.array_sort(
            F.transform(
                occurrences,
                lambda o: F.struct(
                    o["start"].alias("start"), o["end"].alias("end"), o["is_bare_word"].alias("is_bare_word"),
                    o["marker"].alias("marker"),
                ),
            )
        )

    def select(ordered: Column) -> Column:
        competing = by_start(keep_non_overlapping(F.array_sort("_occ"), kind))
        return F.transform(
            F.when(_clash(ordered), competing).otherwise(ordered),
            lambda o: F.struct(
                o["marker"].alias("marker"), o["start"].alias("start"), o["end"].alias("end"),
                o["is_bare_word"].alias("is_bare_word"),
            ),
        )

    return with_once(sentences.join(grouped, list(key)), "markers", let(by_start(F.col("_occ")), select)).drop("_occ")


def _by_sign(lang: Column, phrase: Column) -> Column:
    """Phrases without a first word or a first pair of characters to be joined by."""
    return F.when(lang == "en", phrase.rlike(r"^[^\p{L}\p{N}_]")).otherwise(F.length(phrase) < 2)


def _hits_by_sign(safe: DataFrame, phrases: DataFrame, key: Sequence[str], signs: list[str], longest: int) -> DataFrame:
    """Occurrences of the phrases that are looked up by their first character alone."""
    places = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length("_safe"), F.lit(1))), lambda i: F.substring("_safe", i, F.lit(1)).isin(signs)
    )
    spots = safe.select(*key, "_safe", F.explode(places).alias("_i")).select(
        *key, F.substring("_safe", F.col("_i"), F.lit(1)).alias("head"), (F.col("_i") - 1).cast("int").alias("start"),
        F.when(F.col("_i") > 1, F.substring("_safe", F.col("_i") - 1, F.lit(1))).otherwise("").alias("before"),
        F.substring("_safe", F.col("_i"), F.lit(longest + 1)).alias("w"),
    )
    listed = phrases.select("lang", "rank", "is_bare", "phrase", F.substring("phrase", 1, 1).alias("head"))
    width = F.length("phrase")
    found = F.substring("w", F.lit(1), width)
    in_word = r"^[\p{L}\p{N}_]"
    english = (F.lower(found) == F.lower("phrase")) & ~F.col("before").rlike(in_word) & ~F.substring("w", width + 1, F.lit(1)).rlike(in_word)
    return spots.join(listed, "head").filter(F.when(F.col("lang") == "en", english).otherwise(found == F.col("phrase"))).select(
        *key, "rank", "start", "is_bare", width.alias("width"), found.alias("found")
    )


def best_marker(markers: Column) -> Column:
    """Non-bare first, then longest, then earliest."""
    best = F.array_max(
        F.transform(
            markers,
            lambda m: F.struct(
                (~m["is_bare_word"]).alias("full"), F.length(m["marker"]).alias("n"), (-m["start"]).alias("at"),
                m["marker"].alias("marker"),
            ),
        )
    )
    return best["marker"]


def all_bare(markers: Column) -> Column:
    return F.forall(markers, lambda m: m["is_bare_word"])


def explode_hits(sentences: DataFrame, key: Sequence[str] = ("doc_id", "sent_idx")) -> DataFrame:
    return sentences.select(*key, F.inline("markers"))


MARKERS_TYPE = f"array<{schemas.MARKER_HIT}>"
