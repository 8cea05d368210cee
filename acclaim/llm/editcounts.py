"""Token counts that follow edits.

A document is cut into segments of whole pre-tokens; the segments are the leaves of a tree whose
nodes hold the characters and tokens below them.  An edit finds its segments by descending the
tree, re-encodes only those (and a neighbour where the cut between them no longer separates
pre-tokens), and corrects the sums on the way up.

Segments begin at a single space between two non-space characters, which no pre-token crosses, so
the counts of segments add up to the count of the text.

Defined results: a null text counts as empty; null edits are none; offsets count code points and
are cut to the text; edits apply one after the other; a null insertion is empty; repeated rows are
counted one by one; extra columns may be kept; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acclaim.llm.common import prepare
from acclaim.llm.tokens import encoder

#: characters after which a segment ends at the next possible cut
SEGMENT = 256

_CUT = re.compile(r"(?<=\S) (?=\S)")


def segments_of(text: str, size: int = SEGMENT) -> list[str]:
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at:cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class CountTree:
    """Sums of characters and tokens over the segments of one text."""

    def __init__(self, segments: list[str], tokens: list[int], count):
        self.count = count
        self.segments = segments
        self.size = 1
        while self.size < len(segments):
            self.size *= 2
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        self.encoded_chars = 0
        for i, (segment, n) in enumerate(zip(segments, tokens)):
            self.chars[self.size + i], self.tokens[self.size + i] = len(segment), n
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """(segment, offset in it) of a character; the end of the text belongs to the last segment."""
        if at >= self.chars[1]:
            return len(self.segments) - 1, len(self.segments[-1])
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.chars[node]:
                at -= self.chars[node]
                node += 1
        return node - self.size, at

    def _put(self, i: int, segment: str) -> None:
        self.segments[i] = segment
        n = self.count(segment) if segment else 0
        self.encoded_chars += len(segment)
        node = self.size + i
        more_chars, more_tokens = len(segment) - self.chars[node], n - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def _separate(self, left: str, right: str) -> bool:
        return bool(left) and not left[-1].isspace() and right[:1] == " " and not right[1:2].isspace() and len(right) > 1

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replace ``remove`` characters at ``at`` by ``insert``."""
        at = min(max(at, 0), self.chars[1])
        remove = min(max(remove, 0), self.chars[1] - at)
        first, offset = self.find(at)
        last, past = self.find(at + remove)
        text = self.segments[first][:offset] + insert + self.segments[last][past:]
        while not text and last + 1 < len(self.segments):
            last += 1
            text = self.segments[last]
        # the cut before the region, then the cut after it, must still separate pre-tokens
        before = first - 1
        while text and before >= 0 and not self._separate(self.segments[before], text):
            text, first, before = self.segments[before] + text, before, before - 1
        after = last + 1
        while after < len(self.segments) and not self._separate(text, self.segments[after]):
            text, last, after = text + self.segments[after], after, after + 1
        for i in range(first + 1, last + 1):
            self._put(i, "")
        self._put(first, text)

    def leaves(self) -> tuple[list[str], list[int]]:
        kept = [(s, self.tokens[self.size + i]) for i, s in enumerate(self.segments) if s]
        return [s for s, _ in kept], [n for _, n in kept]


def count_trees(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), size: int = SEGMENT) -> DataFrame:
    """The kept columns, segments (the text in order), segment_tokens, n_tokens."""
    prepare(docs.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["segments array<string>, segment_tokens array<int>, n_tokens long"])

    def build(batches):
        import pyarrow as pa

        encode = encoder(vocabulary).encode
        for batch in batches:
            segments = [segments_of(t or "", size) for t in batch.column(batch.num_columns - 1).to_pylist()]
            tokens = [[len(encode(s)) // 4 if s else 0 for s in ss] for ss in segments]
            own = [pa.array(segments, pa.list_(pa.string())), pa.array(tokens, pa.list_(pa.int32())), pa.array([sum(t) for t in tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*keep, "segments", "segment_tokens", "n_tokens"])

    return docs.select(*keep, "text").mapInArrow(build, schema)


def apply_edits(trees: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Apply ``edits`` (array of at, remove, insert) to the rows of ``count_trees``.

    Gives the kept columns, the new segments, segment_tokens and n_tokens, and encoded_chars: the
    characters that had to be encoded again.
    """
    prepare(trees.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in trees.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["segments array<string>, segment_tokens array<int>, n_tokens long, encoded_chars long"])

    def change(batches):
        import pyarrow as pa

        encode = encoder(vocabulary).encode
        for batch in batches:
            rows = []
            for segments, tokens, edits in zip(*(c.to_pylist() for c in batch.columns[-3:])):
                tree = CountTree(segments, tokens, lambda s: len(encode(s)) // 4)
                for edit in edits or []:
                    tree.edit(edit["at"], edit["remove"], edit["insert"] or "")
                rows.append((*tree.leaves(), tree.tokens[1], tree.encoded_chars))
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.int64())
            own = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *own], names=[*keep, "segments", "segment_tokens", "n_tokens", "encoded_chars"])

    edits = F.transform("edits", lambda e: F.struct(e["at"].cast("long").alias("at"), e["remove"].cast("long").alias("remove"), e["insert"].alias("insert")))
    return trees.select(*keep, F.col("segments").alias("_s"), F.col("segment_tokens").alias("_t"), edits.alias("_e")).mapInArrow(change, schema)
