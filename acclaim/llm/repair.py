"""Conversation structure repair by a run-length dynamic programme.

Every row of a conversation is a symbol: must go (blank or duplicate), or role and whether it is
truncated.  The states are what has been put out so far: nothing, a system turn, a user turn, an
assistant turn.  A symbol is a min-plus matrix over the states.  Equal neighbouring symbols are one
run, and a run of n moves costs through cached binary powers of its matrix.  The cheapest edits, the
ASCII-least among equals, are then unrolled from the costs that remain behind each half of a run.

A conversation may be any share of the table.  Rows are sorted in ranges of (conversation, turn), so a
long conversation lies in several tasks; each hands over its runs and one matrix, the matrices give
the costs behind each part, the parts are unrolled for every state they may be entered in, and the
states then choose.  Texts move once, when repaired turns are put out in order.

Defined results: rows are ordered by turn, nulls first, then role, then digest of the text; null roles and
texts are one space; a null conv_id is a conversation; repeated rows are duplicates; a role that
starts with none of s, u, a (also the empty one) cannot be kept as it is; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acclaim.llm.common import prepare, stage

_SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: the state behind a turn with this initial, by the state before it
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: the turn that may be put in or taken for another one is the same in every state
_FREE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
_FAR = 1 << 60
MUST_GO = 0
#: costs from each state to a whole conversation when no row is left
AT_END = (0, 2 * INSERT, INSERT, 0)
OK, BLANK, DUPLICATE, CUT = range(4)
_LEGAL = {"su", "ua", "au"}


def symbol(initial: str, cut: bool) -> int:
    return 1 + 2 * ("sua".find(initial) if initial and initial in "sua" else 3) + cut


def _edges(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up one row, letters in ASCII order."""
    out = [("D", DELETE, state)]
    if sym != MUST_GO:
        role, cut = divmod(sym - 1, 2)
        kept = _NEXT.get("sua"[role:role + 1], {}).get(state)
        if kept is not None:
            out.append(("K", TRUNCATED * cut, kept))
        out.append(("R", REROLE + TRUNCATED * cut, _FREE[state]))
    return out


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs when turns may be put in before the next row."""
    for _ in STATES:
        costs = [min(costs[s], INSERT + costs[_FREE[s]]) for s in STATES]
    return costs


def times(left: tuple, right: tuple) -> tuple:
    """Min-plus product of two matrices (rows: state before, columns: state behind)."""
    return tuple(tuple(min(left[i][k] + right[k][j] for k in STATES) for j in STATES) for i in STATES)


def before(matrix: tuple, behind: tuple) -> tuple:
    """Costs before a stretch from those behind it."""
    return tuple(min(matrix[i][k] + behind[k] for k in STATES) for i in STATES)


IDENTITY = tuple(tuple(0 if i == j else _FAR for j in STATES) for i in STATES)


@lru_cache(maxsize=1024)
def power(sym: int, p: int) -> tuple:
    """The matrix of 2**p equal symbols."""
    if p:
        half = power(sym, p - 1)
        return times(half, half)
    columns = []
    for target in STATES:
        reach = [min((cost for _, cost, to in _edges(sym, s) if to == target), default=_FAR) for s in STATES]
        columns.append(_with_inserts(reach))
    return tuple(tuple(min(columns[j][i], _FAR) for j in STATES) for i in STATES)


def _powers(n: int) -> list[int]:
    return [p for p in range(n.bit_length()) if n >> p & 1]


def before_run(sym: int, n: int, behind: tuple) -> tuple:
    for p in _powers(n):
        behind = before(power(sym, p), behind)
    return behind


def run_matrix(sym: int, n: int) -> tuple:
    out = IDENTITY
    for p in _powers(n):
        out = times(out, power(sym, p))
    return out


def _one_row(sym: int, state: int, behind: tuple) -> tuple[str, int]:
    edges = {s: _edges(sym, s) for s in STATES}
    left = _with_inserts([min(cost + behind[to] for _, cost, to in edges[s]) for s in STATES])
    letters = ""
    while True:
        fitting = {letter: to for letter, cost, to in edges[state] if cost + behind[to] == left[state]}
        if "D" not in fitting and INSERT + left[_FREE[state]] == left[state]:
            letters += "I"
            state = _FREE[state]
            continue
        letter = min(fitting)
        return letters + letter, fitting[letter]


def _halves(sym: int, p: int, state: int, behind: tuple) -> tuple[str, int]:
    if not p:
        return _one_row(sym, state, behind)
    first, middle = _unrolled(sym, p - 1, state, _levelled(before(power(sym, p - 1), behind)))
    second, last = _unrolled(sym, p - 1, middle, behind)
    return first + second, last


_remembered = lru_cache(maxsize=4096)(_halves)


def _levelled(behind: tuple) -> tuple:
    """Choices depend on differences of costs only."""
    least = min(behind)
    return tuple(c - least for c in behind)


def _unrolled(sym: int, p: int, state: int, behind: tuple) -> tuple[str, int]:
    """The letters of 2**p equal symbols and the state behind them; short ones are remembered."""
    return (_remembered if p <= 10 else _halves)(sym, p, state, behind)


def unroll(runs: list[tuple[int, int]], state: int, behind: tuple) -> tuple[str, int]:
    """The least of the cheapest audits of ``runs`` from ``state``, given the costs behind them."""
    blocks = [(sym, p) for sym, n in runs for p in _powers(n)]
    costs = [behind]
    for sym, p in reversed(blocks):
        costs.append(before(power(sym, p), costs[-1]))
    letters = []
    for (sym, p), rest in zip(blocks, reversed(costs[:-1])):
        part, state = _unrolled(sym, p, state, _levelled(rest))
        letters.append(part)
    return "".join(letters), state


def closing(state: int) -> str:
    """What is put in when no row is left."""
    return "I" * (AT_END[state] // INSERT)


class Part:
    """What a stretch of one conversation's rows, in order, hands over."""

    def __init__(self):
        self.runs: list[list[int]] = []
        self.first = self.last = None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first_turn = self.last_turn = None

    def run(self, sym: int, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == sym:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([sym, n])

    def add(self, turn: int | None, initial: str, fault: int, n: int) -> None:
        """``n`` equal rows; only the first of them can be free of faults."""
        if self.last is not None:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first, self.first_turn = initial, turn
        self.illegal += n - 1
        if turn is not None and (self.last is None or turn != self.last_turn):
            self.turns += 1
        self.last, self.last_turn = initial, turn
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
        if fault in (BLANK, DUPLICATE):
            self.run(MUST_GO, n)
            self.blank += n * (fault == BLANK)
            self.duplicate += n * (fault == DUPLICATE)
        else:
            self.truncated += fault == CUT
            self.duplicate += n - 1
            self.run(symbol(initial, fault == CUT), 1)
            self.run(MUST_GO, n - 1)

    def join(self, other: dict) -> None:
        """Take the figures of the part behind this one; runs are not needed any more."""
        if self.last is not None:
            self.illegal += self.last + other["first"] not in _LEGAL
            self.turns -= self.last_turn is not None and self.last_turn == other["first_turn"]
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + other[name])
        self.last, self.last_turn = other["last"], other["last_turn"]
        self.low = other["low"] if self.low is None else self.low
        self.high = self.high if other["high"] is None else other["high"]

    def figures(self) -> dict:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


_FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PART = (
    "edge boolean, part int, first string, last string, first_turn long, last_turn long, low long, high long, turns long,"
    " symbols array<int>, lengths array<long>, matrix array<long>"
)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32 of ``conv_id:turn`` deals out; nulls are one space."""
    conv_id, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    blank = F.lit(" ")
    key = F.concat(F.coalesce(conv_id.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    damaged = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.select(
        conv_id.alias("conv_id"), turn.alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"), damaged.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _clean(rows: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
    )


def faulty_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, fault): equal rows of a turn as one, with their first fault."""
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACE))
    last = F.right(trimmed, F.lit(1))
    alone = F.when(trimmed == "", BLANK).when(last.isin(".", "!", "?"), OK).otherwise(CUT)
    slim = _clean(rows).select("conv_id", "turn", "role", _digest().alias("digest"), alone.alias("alone"))
    slim = stage(slim.groupBy("conv_id", "turn", "role", "digest", "alone").agg(F.count("*").alias("n")), "repair-rows")
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    seen = slim.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("earliest"), F.count("*").alias("times"))
    seen = seen.filter("times > 1").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "earliest")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    again = F.col("earliest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    fault = F.when((F.col("alone") != BLANK) & again, DUPLICATE).otherwise(F.col("alone"))
    return slim.join(seen, same, "left").select("conv_id", "turn", "role", "digest", "n", fault.alias("fault"))


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _parts(batches):
    """Whole conversations with their repair, and the parts at the ends of a range, which may go on elsewhere."""
    import pyarrow as pa
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    schema = _arrow_schema()
    nothing = object()
    at, part, count, done = nothing, Part(), 0, []

    def closed(edge: bool) -> dict:
        row = {"conv_id": at, "edge": edge, "part": number, **part.figures()}
        if edge:
            whole = IDENTITY
            for sym, n in part.runs:
                whole = times(whole, run_matrix(sym, n))
            own = {name: getattr(part, name) for name in ("first", "last", "first_turn", "last_turn", "low", "high", "turns")}
            return row | own | {"symbols": [s for s, _ in part.runs], "lengths": [n for _, n in part.runs], "matrix": [c for line in whole for c in line]}
        letters, state = unroll(part.runs, START, AT_END)
        return row | {"audit": letters + closing(state), "cost": _cost(part.runs)}

    for batch in batches:
        for conv_id, turn, initial, fault, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if at is nothing or conv_id != at:
                if at is not nothing:
                    done.append(closed(count == 0))
                    count += 1
                at, part = conv_id, Part()
            part.add(turn, initial, fault, n)
        if len(done) > 1000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done.clear()
    if at is not nothing:
        done.append(closed(True))
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def _cost(runs: list) -> int:
    behind = AT_END
    for sym, n in reversed(runs):
        behind = before_run(sym, n, behind)
    return behind[START]


def _arrow_schema():
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in f"conv_id long, {_FIGURES}, {_PART}".split(", ")])


def _behind(table):
    """Costs behind each part of one conversation, from the matrices of the parts that follow."""
    import pyarrow as pa

    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    behind, out = AT_END, []
    for row in reversed(rows):
        out.append({"conv_id": row["conv_id"], "part": row["part"], "behind": list(behind)})
        flat = row["matrix"]
        behind = before(tuple(tuple(flat[4 * i:4 * i + 4]) for i in STATES), behind)
    for row in out:
        row["cost"] = behind[START]
    return pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("behind", pa.list_(pa.int64())), ("cost", pa.int64())]))


def _every_state(batches):
    import pyarrow as pa

    for batch in batches:
        audits, ends = [], []
        for row in batch.select(["symbols", "lengths", "behind"]).to_pylist():
            found = [unroll(list(zip(row["symbols"], row["lengths"])), s, tuple(row["behind"])) for s in STATES]
            audits.append([letters for letters, _ in found])
            ends.append([state for _, state in found])
        kept = [n for n in batch.schema.names if n not in ("symbols", "lengths", "behind")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in kept] + [pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], [*kept, "audits", "ends"]
        )


def _chosen(table):
    """One conversation from its parts: each part is entered in the state in which the one before it ended."""
    import pyarrow as pa

    whole, state, letters, cost = Part(), START, [], 0
    for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
        whole.join(row)
        letters.append(row["audits"][state])
        state, cost = row["ends"][state], row["cost"]
    row = {"conv_id": row["conv_id"], **whole.figures(), "cost": cost, "audit": "".join(letters) + closing(state)}
    return pa.Table.from_pylist([row], pa.schema([f for f in _arrow_schema()][:8]))


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit per conversation of (conv_id, turn, role, text)."""
    prepare(rows.sparkSession, 4096)
    ordered = faulty_rows(rows).repartitionByRange(*_order()).sortWithinPartitions(*_order())
    fed = ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "n")
    parts = stage(fed.mapInArrow(_parts, f"conv_id long, {_FIGURES}, {_PART}"), "repair-parts")
    # at most two per range
    edges = parts.filter("edge").drop("cost", "audit", "gaps")
    behind = edges.select("conv_id", "part", "matrix").groupBy("conv_id").applyInArrow(_behind, "conv_id long, part int, behind array<long>, cost long")
    behind = behind.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "behind", "cost")
    met = edges.drop("matrix", "edge").join(behind, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).drop("_conv", "_part")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema if f.name not in ("symbols", "lengths", "behind"))
    entered = met.mapInArrow(_every_state, f"{fields}, audits array<string>, ends array<int>")
    spread = entered.groupBy("conv_id").applyInArrow(_chosen, f"conv_id long, {_FIGURES}")
    names = ["conv_id", *(f.split()[0] for f in _FIGURES.split(", "))]
    return stage(parts.filter("NOT edge").select(names).unionByName(spread), "repairs")


def _applied(batches):
    """Repaired turns: a conversation's audit, then its rows in order, pass by once."""
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    audit, used, state, position, conv_id = "", 0, START, 0, None
    out: list[tuple] = []
    size = 0

    def put(role: str, text: str) -> None:
        nonlocal position, size
        out.append((conv_id, position, role, text))
        position += 1
        size += len(text) + 16

    def inserted() -> None:
        nonlocal used, state
        while used < len(audit) and audit[used] == "I":
            state = _FREE[state]
            put(_ROLE[state], "")
            used += 1

    for batch in batches:
        for conv_id_, header, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if header is not None:
                inserted()
                audit, used, state, position, conv_id = header, 0, START, 0, conv_id_
                continue
            inserted()
            letter = audit[used]
            used += 1
            if letter == "K":
                state = _NEXT[role[0]][state]
                put(role, text)
            elif letter == "R":
                state = _FREE[state]
                put(_ROLE[state], text)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
                size = 0
    inserted()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def repaired_turns(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv_id, position, role, text) of the repaired conversations, each whole and in order within one task.

    Nothing is gathered: a task reads its conversations row by row, however long they are.
    """
    prepare(rows.sparkSession)
    turns = _clean(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", "turn", _digest().alias("digest"))
    audits = repaired.select("conv_id", "audit").withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "turn": F.lit(None).cast("long"), "digest": F.lit(None).cast("binary")})
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_last("audit"), F.asc_nulls_first("turn"), "role", "digest"]
    ordered = turns.unionByName(audits).repartition("conv_id").sortWithinPartitions(*order)
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(_applied, "conv_id long, position long, role string, text string")


def _hashed(batches):
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])
    at, digest = None, None
    for batch in batches:
        done = []
        for conv_id, position, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if position == 0:
                if digest:
                    done.append((at, digest.hexdigest()))
                at, digest = conv_id, hashlib.sha256()
            digest.update(f"{'' if position == 0 else chr(10)}{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], schema=schema)


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` lines, read in the order in which ``repaired_turns`` hands them over."""
    return turns.mapInArrow(_hashed, "conv_id long, sha256 string")
