"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acclaim.llm import chat, decontamination, editcounts, langid, licenses, lzprint, mixing, packing, planes, prefixtrie, repair, simhash, topk
from acclaim.llm.common import remainder, table

BYTE_BPE = "byte_bpe_50k.json"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(BYTE_BPE))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def op4_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits in every document: an insertion at a third, a replacement at the half, a deletion near the end."""
    vocabulary = vocabulary_path(BYTE_BPE)
    trees = editcounts.count_trees(table(spark, sf_dir, "documents"), vocabulary, keep=("doc_id",))
    n = F.length(F.array_join("segments", "")).cast("long")
    edit = lambda at, remove, insert: F.struct(at.cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))
    edits = F.array(edit(F.floor(n / 3), 0, " an inserted passage,"), edit(F.floor(n / 2), 20, "\n\nReplaced "), edit(n - 30, 12, ""))
    trees = trees.withColumn("edits", edits).withColumn("n_chars", n).withColumnRenamed("n_tokens", "n_tokens_before")
    edited = editcounts.apply_edits(trees, vocabulary, keep=("doc_id", "n_chars", "n_tokens_before"))
    text = F.array_join("segments", "")
    return edited.select(
        "doc_id", "n_chars", F.col("n_tokens_before").alias("n_tokens"), F.length(text).cast("long").alias("edited_chars"),
        F.sha2(text, 256).alias("edited_sha256"), F.col("n_tokens").alias("edited_tokens"), "encoded_chars",
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    out = chat.format_conversations(rows).withColumn("formatted", chat.training_text(F.col("segments")))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = planes.new_path(spark)
    planes.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary_path(BYTE_BPE))
    return planes.read_token_sums(spark, path)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


def op11_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0, 10)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = repair.damage(conversations)
    found = repair.repairs(rows)
    digests = repair.turn_digests(repair.repaired_turns(rows, found)).withColumnRenamed("conv_id", "_turns_of")
    found = found.withColumnRenamed("conv_id", "_found_of")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    all_of = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_found_of")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_turns_of")), "left")
    counted = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_of.select(
        "conv_id", *counted, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtrie.turn_digests(table(spark, sf_dir, "conversations"))
    return prefixtrie.trie(prefixtrie.rebuilt(turns))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_best_fit_packing, op2_phrase_fingerprints, op3_decontamination, op4_edit_counts, op5_simhash_near_dedup,
        op6_context_mixing, op7_license_scan, op8_chat_formatting, op9_token_files, op10_language_id,
        op11_top_k_search, op12_structure_repair, op13_prefix_trie,
    )}


# Words hit by benchmark windows, by joining every window of every text.
OP3_SQL = r"""
WITH low AS (
  SELECT 'd' AS kind, row_number() OVER () AS row_no, CAST(doc_id AS VARCHAR) AS id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS words
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM (SELECT item_id, w, least(13, len(w)) AS size FROM items WHERE len(w) > 0))),
doc_windows AS (
  SELECT row_no, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS words
  FROM (SELECT row_no, w, size, unnest(range(1, len(w) - size + 2)) AS p
        FROM low, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)),
met AS (SELECT row_no, item_id, p, d.size FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.words = i.words),
hit AS (SELECT row_no, count(DISTINCT word_no) AS n_hit FROM (SELECT row_no, unnest(range(p, p + size)) AS word_no FROM met) GROUP BY row_no),
found AS (SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT row_no, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN hit USING (row_no) LEFT JOIN found USING (row_no)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op7_sql() -> str:
    """Statements cut before terms, lines that state a copyright filtered, the rest folded; looked up for whole texts and for lines."""
    opening = "permission is hereby granted|permission to use|redistribution and use|everyone is permitted|licensed under|released under|distributed under|this work is|this software is provided|this program|this library"
    sign = r"copyright[ \t]*(?:\(c\)|©|&copy;|:|<|\[|\{|[0-9]{4})"
    start = rf"(?:\b{sign}|©|\(c\)[ \t]*[0-9]{{4}}|\ball rights reserved)"
    blank = r"[ \t\r\n\x0B\f#*/;-]"
    cut = rf"(?i){start}[^\n]{{0,200}}?(?:\n[^\n]{{1,200}}?){{0,2}}?[ \t\r\n\x0B\f#*/;.-]*\b({opening.replace(' ', blank + '+')})"
    lead = r"^[ \t\r\f#*/;-]*"
    stated = rf"(?i){lead}(?:(?:portions[ \t]+)?{sign}|©|\(c\)[ \t]*[0-9]{{4}}|all rights reserved[^a-z0-9]*$)"
    holder = rf"{lead}(?i:portions[ \t]+)?Copyright[ \t]+(?:by[ \t]+)?[A-Z\x{{C0}}-\x{{10FFFF}}]"
    term = rf"{lead}(?i:portions[ \t]+)?Copyright[ \t]+(?:by[ \t]+)?(?:Holder|Notice|Owner|License|Licence|Law|Act|And|Or|Statement)s?\b"
    same = [
        ("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), (r"sub-[ \t\r\n\x0B\f#*/;]*license", "sublicense"),
        (r"non-[ \t\r\n\x0B\f#*/;]*infringement", "noninfringement"), (r"per[ \t\r\n\x0B\f#*/;]+cent", "percent"), ("https?://", ""), ("&", " and "), (r"\(c\)|©", " copyright "),
    ]

    def lines_of(text: str) -> str:
        lines = f"string_split(regexp_replace(regexp_replace({text}, '^\\x{{FEFF}}', ''), {_quoted(cut)}, chr(10) || '\\1', 'g'), chr(10))"
        kept = f"list_filter({lines}, lambda l: NOT (regexp_matches(l, {_quoted(stated)}) OR (regexp_matches(l, {_quoted(holder)}) AND NOT regexp_matches(l, {_quoted(term)}))))"
        out = f"replace(lower(array_to_string({kept}, chr(10))), chr(65279), '')"
        for pattern, replacement in same:
            out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(replacement)}, 'g')"
        folded = f"string_split(regexp_replace({out}, '[^a-z0-9\\n\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), chr(10))"
        return f"list_filter(list_transform({folded}, lambda l: trim(l)), lambda l: l <> '')"

    texts = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.KNOWN_TEXTS)
    return f"""
WITH known AS (SELECT form, min(license) AS license
               FROM (SELECT license, array_to_string({lines_of('text')}, ' ') AS form FROM (VALUES {texts}) t(license, text)) WHERE form <> '' GROUP BY form),
docs AS (SELECT *, nullif(array_to_string(parts, ' '), '') AS form FROM (SELECT row_number() OVER () AS row_no, doc_id, {lines_of('text')} AS parts FROM documents)),
lines AS (SELECT row_no, unnest(parts) AS form FROM docs),
found AS (SELECT row_no, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n FROM lines JOIN known USING (form) GROUP BY row_no)
SELECT doc_id, sha256(docs.form) AS digest, license, coalesce(line_licenses, '') AS line_licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines
FROM docs LEFT JOIN known USING (form) LEFT JOIN found USING (row_no)"""


def op8_sql(template: chat.Template = chat.TEMPLATE) -> str:
    """Digests straight from the rows; lengths from the escaping rule."""
    escaped = "replace(text, '\\', '\\\\')"
    for mark in template.controls:
        escaped = f"replace({escaped}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    around = " ".join(f"WHEN role = '{name}' THEN {len(t.open) + len(t.close)}" for name, t in template.turns.items())
    moves = ", ".join(f"'{state}>{role}'" for state, role in template.moves)
    loss = ", ".join(f"'{name}'" for name, t in template.turns.items() if t.loss)
    final = ", ".join(f"'{role}'" for role in template.final)
    said = "'</s>[INST] ok [/INST]'"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', {said}), (-7, 1, 'assistant', {said}))),
turns AS (
  SELECT *, (coalesce(lag(role) OVER (PARTITION BY conv_id {order}), '') || '>' || role) IN ({moves}) AS allowed,
         length({escaped}) + CASE {around} ELSE length(role) + {sum(map(len, template.other))} END AS size
  FROM rows_)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {order}) FILTER (role IN ({loss})), '')) AS loss_sha256,
       CAST(sum(size) + {len(template.begin)} AS BIGINT) AS formatted_chars,
       bool_and(allowed) AND last(role {order}) IN ({final}) AS valid
FROM turns GROUP BY conv_id"""


# Every query row against every other row; products below 2**53 are exact as doubles.
OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row_no <> c.row_no AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY row_no ORDER BY score DESC, vec_id NULLS LAST)
QUALIFY row_number() OVER best <= 10
"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)), "
        "lambda a, b: list_reduce([xor(a, b), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT], "
        "lambda c, z: xor(c >> 1, (c & 1::UBIGINT) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
    )


# The plain programme, row by row: per state the least (cost, audit), with at most two turns put in before a row.
OP12_SQL = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM base)),
numbered AS (
  SELECT *, left(role, 1) AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS r_before
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
-- states: 0 nothing, 1 system, 2 user, 3 assistant
inserts(state, put, added, cost, reached) AS (VALUES
  (0, '', []::VARCHAR[], 0, 0), (0, 'I', ['user:'], 2, 2), (0, 'II', ['user:', 'assistant:'], 4, 3),
  (1, '', [], 0, 1), (1, 'I', ['user:'], 2, 2), (1, 'II', ['user:', 'assistant:'], 4, 3),
  (2, '', [], 0, 2), (2, 'I', ['assistant:'], 2, 3), (2, 'II', ['assistant:', 'user:'], 4, 2),
  (3, '', [], 0, 3), (3, 'I', ['user:'], 2, 2), (3, 'II', ['user:', 'assistant:'], 4, 3)),
moves(state, r, reached, role) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
edits AS (
  SELECT conv_id, i, s.state, 'D' AS letter, 3 AS cost, s.state AS reached, []::VARCHAR[] AS line FROM faults, (VALUES (0), (1), (2), (3)) s(state)
  UNION ALL SELECT conv_id, i, state, 'K', (fault = 'truncated')::INT, reached, [f.role || ':' || text] FROM faults f JOIN moves USING (r) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, state, 'R', 2 + (fault = 'truncated')::INT, reached, [moves.role || ':' || text] FROM faults f, moves WHERE fault IN ('', 'truncated') AND moves.role <> ''),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM faults
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, e.reached, min({{'cost': best.cost + n.cost + e.cost, 'audit': best.audit || n.put || e.letter, 'lines': best.lines || n.added || e.line}})
  FROM dp JOIN inserts n ON dp.state = n.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i + 1 AND e.state = n.reached
  GROUP BY dp.conv_id, dp.i + 1, e.reached),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
         count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(r_before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
ended AS (
  SELECT dp.conv_id, min({{'cost': best.cost + n.cost, 'audit': best.audit || n.put, 'lines': best.lines || n.added}}) AS best
  FROM dp JOIN inserts n ON dp.state = n.state JOIN counted c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.i
  WHERE n.reached IN (0, 3) GROUP BY dp.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


# Prefixes as joined digests of their turns; subtree sums over every node's whole path.
OP13_SQL = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS pos,
         md5(length(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^ 	-
]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM turns),
rebuilt AS (
  SELECT ids.conv_id, 0 AS kind, pos, digest, words FROM ids JOIN turns ON turns.conv_id = base AND pos < h
  UNION ALL SELECT ids.conv_id, 1, pos, digest, words FROM ids JOIN turns ON turns.conv_id = ids.conv_id AND pos >= h),
prefixes AS (
  SELECT conv_id, row_number() OVER seq AS depth, words, string_agg(digest, '') OVER seq AS name FROM rebuilt
  WINDOW seq AS (PARTITION BY conv_id ORDER BY kind, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
path AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, name) AS rep FROM prefixes),
nodes AS (SELECT rep, depth, count(*) AS n_convs, any_value(words) AS words FROM path GROUP BY rep, depth),
linked AS (SELECT n.*, p.rep AS parent FROM nodes n LEFT JOIN path p ON p.conv_id = n.rep AND p.depth = n.depth - 1),
children AS (SELECT parent AS rep, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY ALL),
own AS (SELECT linked.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM linked LEFT JOIN children USING (rep, depth)),
totals AS (
  SELECT p.rep, p.depth, count_if(n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM own JOIN path p ON p.conv_id = own.rep AND p.depth <= own.depth GROUP BY ALL),
ends AS (
  SELECT rep, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT * FROM path QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY ALL)
SELECT rep AS conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM own JOIN totals USING (rep, depth) LEFT JOIN ends USING (rep, depth)
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op3_decontamination": OP3_SQL, "op7_license_scan": op7_sql(), "op8_chat_formatting": op8_sql(), "op11_top_k_search": OP11_SQL,
        "op12_structure_repair": OP12_SQL, "op13_prefix_trie": OP13_SQL,
    }
