"""Conversation prefix tries by van Emde Boas recursion.

A trie of height 2H is cut at depth H: a sequence that reaches the cut has its first H turns named,
the upper trie keeps all first halves, and below every name hangs a lower trie of the second halves.
Both have height H and are cut again, all of one height at once.  Cuts lie at multiples of powers of
two, so the name of a cut prefix is made from names of aligned blocks, each from its two halves.

Totals come back the same way.  At height 2H every node already holds the total of its own trie of
height H; the roots of lower tries are summed by the node they hang from, and that sum is grafted onto
this node and the nodes above it in the upper trie.  After log2(depth) rounds every node holds the
total of its whole subtree.

A node is known by (its smallest conversation, depth); names only serve to find equal prefixes.
Turns are digests and word counts from the start, so texts never move.  Conversations of any share
of the table are sorted by ranges of (conversation, turn) and cut into blocks; popular prefixes are
combined before they are shuffled.

Defined results: turns are ordered by turn, nulls first, then role, then digest of the text; null role or
text is empty; rows without a conv_id take no part; repeated rows are turns of their own; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acclaim.llm.common import prepare, stage

#: turns of one conversation that are cut within a row; longer ones are cut over rows first
BLOCK_BITS = 6
SHARED = 20


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, turn_digest binary, n_words) of all turns in order."""
    prepare(conversations.sparkSession, 8192)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the length of the role keeps (role, text) pairs apart
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("text_digest"), digest.alias("turn_digest"),
        F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long").alias("n_words"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text_digest"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = stage(ordered.select("conv_id", "turn_digest", "n_words").mapInArrow(_local_positions, "conv_id long, part int, pos long, turn_digest binary, n_words long"), "trie-turns")
    # a conversation that began in an earlier range goes on in this one: at most one per range
    sizes = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    going_on = sizes.withColumn("before", F.sum("n").over(earlier)).filter("before IS NOT NULL").select("conv_id", "part", "before")
    placed = local.join(F.broadcast(going_on), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "turn_digest", "n_words")


def _local_positions(batches):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    at, reached = None, 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not ids.size:
            continue
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        pos = np.arange(ids.size) - np.repeat(starts, np.diff(np.append(starts, ids.size)))
        if at == ids[0]:
            pos[: starts[1] if starts.size > 1 else ids.size] += reached
        at, reached = ids[-1], int(pos[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(ids.size, number, np.int32)), pa.array(pos), batch.column(1), batch.column(2)],
            ["conv_id", "part", "pos", "turn_digest", "n_words"],
        )


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with the opening of the first one of its twenty; conversations left without turns have one row of nulls."""
    opening = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    base = (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base")
    ids = turns.filter("pos = 0").select("conv_id", opening.alias("h"), base)
    # at most three turns of one conversation in twenty
    heads = turns.filter((F.col("conv_id") % SHARED == 0) & (F.col("pos") < 3)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.count("*").alias("n_base"))
    plan = ids.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    opened = plan.join(heads, "base").filter(F.col("pos") < F.col("h")).select("conv_id", "pos", "turn_digest", "n_words")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").filter(F.col("pos") >= F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_digest", "n_words")
    nothing = ids.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(None).cast("long").alias("n_words"))
    return opened.unionByName(own).unionByName(nothing)


def _joined_name(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _named(left: bytes, right: bytes) -> bytes:
    return hashlib.md5(left + right).digest()


def block_name(symbols: list[bytes], low: int, height: int) -> bytes:
    """The name of ``height`` turns, a power of two of them, from the names of their halves."""
    if height == 1:
        return symbols[low]
    return _named(block_name(symbols, low, height // 2), block_name(symbols, low + height // 2, height // 2))


def cut(symbols: list[bytes], low: int, height: int, tree: bytes, out: list[bytes]) -> None:
    """Append the node names of ``symbols[low:low + height]``, a path down the trie named ``tree``."""
    if height == 1:
        out.append(_named(tree, symbols[low]))
        return
    half = height // 2
    cut(symbols, low, half, tree, out)
    if low + half < len(symbols):
        cut(symbols, low + half, half, _named(tree, block_name(symbols, low, half)), out)


def _whole_blocks(batches):
    import pyarrow as pa

    size = 1 << BLOCK_BITS
    for batch in batches:
        names = [block_name([s["turn_digest"] for s in items], 0, size) if len(items) == size else None for items in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], [*batch.schema.names, "name"])


def _paths(batches):
    import pyarrow as pa

    size = 1 << BLOCK_BITS
    for batch in batches:
        conv, pos, name, words = [], [], [], []
        for conv_id, block, items, tree in zip(*(batch.column(i).to_pylist() for i in range(4))):
            cut([s["turn_digest"] for s in items], 0, size, tree, name)
            conv += [conv_id] * len(items)
            pos += range(block * size, block * size + len(items))
            words += [s["n_words"] for s in items]
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(pos, pa.int64()), pa.array(name, pa.binary()), pa.array(words, pa.int64())], ["conv_id", "pos", "name", "n_words"]
        )


def prefix_names(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, name, n_words): equal prefixes of ``pos + 1`` turns have equal names."""
    block = F.shiftright("pos", BLOCK_BITS)
    items = F.sort_array(F.collect_list(F.struct("pos", "turn_digest", "n_words"))).alias("items")
    # at most 2**BLOCK_BITS turns in a group
    blocks = turns.groupBy("conv_id", block.alias("block")).agg(items)
    blocks = stage(blocks.mapInArrow(_whole_blocks, "conv_id long, block long, items array<struct<pos:long,turn_digest:binary,n_words:long>>, name binary"), "trie-blocks")
    root = F.lit(b"root")
    highest = blocks.agg(F.max("block")).first()[0] or 0
    trees = blocks.filter("block > 0").select("conv_id", "block", root.alias("tree"))
    # names of runs of 1, 2, 4, ... whole blocks; only conversations that go on behind them need any
    levels = [blocks.filter("name IS NOT NULL").select("conv_id", "block", "name")] if highest else []
    while highest >> len(levels):
        pair = levels[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(
            F.count("*").alias("n"), F.min_by("name", "block").alias("first"), F.max_by("name", "block").alias("second")
        )
        pair = pair.filter("n = 2").select("conv_id", "block", _joined_name(F.col("first"), F.col("second")).alias("name"))
        levels.append(stage(pair, "trie-runs"))
    for j in reversed(range(len(levels))):
        above = F.when(F.shiftright("block", j).bitwiseAND(1) == 1, F.shiftright("block", j) - 1)
        names = levels[j].select("conv_id", F.col("block").alias("above"), "name")
        trees = trees.withColumn("above", above).join(names, ["conv_id", "above"], "left")
        trees = trees.select("conv_id", "block", F.when(F.col("name").isNotNull(), _joined_name(F.col("tree"), F.col("name"))).otherwise(F.col("tree")).alias("tree"))
    named = blocks.drop("name")
    named = named.join(trees, ["conv_id", "block"], "left") if highest else named.withColumn("tree", F.lit(None).cast("binary"))
    return named.select("conv_id", "block", "items", F.coalesce("tree", root).alias("tree")).mapInArrow(_paths, "conv_id long, pos long, name binary, n_words long")


def _ends_hashed(batches):
    import pyarrow as pa

    schema = pa.schema([("rep", pa.int64()), ("pos", pa.int64()), ("sha256", pa.string())])
    at, digest = None, None
    for batch in batches:
        done = []
        for rep, pos, conv_id in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (rep, pos) != at:
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (rep, pos), hashlib.sha256(str(conv_id).encode())
            else:
                digest.update(f",{conv_id}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*at, digest.hexdigest()), schema)], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(rep, pos, sha256) of the conversations (rep, pos, conv_id) that end at a node; ids pass by in order, none are gathered."""
    ordered = ends.repartition("rep", "pos").sortWithinPartitions("rep", "pos", "conv_id")
    return ordered.select("rep", "pos", "conv_id").mapInArrow(_ends_hashed, "rep long, pos long, sha256 string")


def subtree_totals(nodes: DataFrame, path: DataFrame, deepest: int) -> DataFrame:
    """(rep, pos, n_leaves, saved_tokens) of whole subtrees from the nodes' own (leaf, saved).

    ``nodes`` (rep, pos, parent, leaf, saved) and ``path`` (conv_id, pos, rep) are stored tables.
    """
    own = nodes.select("rep", "pos", "parent", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    grafts: list[DataFrame] = []
    for j in range(deepest.bit_length()):
        half = 1 << j
        top = own.filter(F.pmod("pos", F.lit(2 * half)) == half)
        for graft in grafts:
            # totals that earlier rounds brought to these roots
            top = top.unionByName(graft.filter(F.pmod("pos", F.lit(2 * half)) == half))
        # a graft knows its node, not the node above it: sum by node first, then by the node above
        roots = top.groupBy("rep", "pos").agg(F.max("parent").alias("parent"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        hung = roots.groupBy(F.col("parent").alias("conv_id"), F.shiftright("pos", j).alias("block")).agg(
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
        )
        above = path.withColumn("block", F.shiftright("pos", j) + 1)
        graft = above.join(hung, ["conv_id", "block"]).groupBy("rep", "pos").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        grafts.append(stage(graft.withColumn("parent", F.lit(None).cast("long")), "trie-graft"))
    whole = own
    for graft in grafts:
        whole = whole.unionByName(graft)
    return whole.groupBy("rep", "pos").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie over (conv_id, pos, turn_digest, n_words); a null pos is a conversation's mark.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns = stage(turns, "trie-rebuilt")
    named = stage(prefix_names(turns.filter("pos IS NOT NULL")), "trie-names")
    found = stage(named.groupBy("pos", "name").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words")), "trie-found")
    path = stage(named.select("conv_id", "pos", "name").join(found.select("pos", "name", "rep"), ["pos", "name"]).select("conv_id", "pos", "rep"), "trie-path")
    above = path.select(F.col("conv_id").alias("rep"), (F.col("pos") + 1).alias("pos"), F.col("rep").alias("parent"))
    linked = found.drop("name").join(above, ["rep", "pos"], "left")
    children = linked.filter("pos > 0").groupBy(F.col("parent").alias("rep"), (F.col("pos") - 1).alias("pos")).agg(F.count("*").alias("n_children"))
    own = linked.join(children, ["rep", "pos"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stage(own.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_words")}), "trie-nodes")
    deepest = nodes.agg(F.max("pos")).first()[0] or 0
    totals = subtree_totals(nodes, path, deepest)

    last = turns.groupBy("conv_id").agg(F.max("pos").alias("pos"))
    ends = last.filter("pos IS NOT NULL").join(path, ["conv_id", "pos"]).select("rep", "pos", "conv_id")
    members = turns.agg(F.min("conv_id").alias("smallest"), F.count_if(F.col("pos").isNull()).alias("n")).first()
    # the root is known by the smallest of all conversations, as every node is by its smallest member
    smallest = F.lit(members.smallest).cast("long")
    turnless = last.filter("pos IS NULL").select(smallest.alias("rep"), F.lit(-1).cast("long").alias("pos"), "conv_id")
    ended = stage(end_digests(ends.unionByName(turnless)), "trie-ends")
    below = nodes.join(totals, ["rep", "pos"]).select("rep", "pos", F.coalesce("parent", smallest).alias("parent"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    below = stage(below, "trie-below")
    root = below.filter("pos = 0").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = root.filter(smallest.isNotNull()).select(
        smallest.alias("rep"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("parent"), F.lit(members.n).cast("long").alias("n_convs"),
        "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    return root.unionByName(below).join(ended, ["rep", "pos"], "left").select(
        F.col("rep").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
