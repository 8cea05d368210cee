"""Independent SQL for the registered queries.

Answers are computed from the structured columns the text was rendered from; no pattern of
the library is reused.
"""

from __future__ import annotations

from acclaim.sources.lexicon import default_phrases

_DIGITS = "'0123456789','abcdefghij'"

_REF_SRC = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS rk
  FROM lineitem
),
r AS (
  SELECT l_orderkey AS doc_id, CAST(rk AS INTEGER) AS ref_index,
         'S' || translate(lpad(CAST(l_suppkey AS VARCHAR), 4, '0'), {_DIGITS}) AS surname,
         CAST(year(l_shipdate) AS VARCHAR) AS year,
         l_returnflag <> 'R' AS is_journal,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS volume,
         'x' || translate(lpad(CAST(l_partkey AS VARCHAR), 6, '0'), {_DIGITS}) AS tag,
         CAST(l_linenumber AS VARCHAR) AS issue, l_linenumber AS line_no, l_partkey, l_suppkey
  FROM ranked
)"""

_SENT = """
s AS (
  SELECT *, CAST(ref_index - 1 AS INTEGER) AS sent_idx, ref_index % 9 AS t,
    CASE ref_index % 9
      WHEN 0 THEN surname || ' et al. (' || year || ') first reported compound ' || tag || ' [' || ref_index || '].'
      WHEN 1 THEN 'In ' || year || ', ' || surname || ' originally proposed scheme ' || tag || ' [' || ref_index || '].'
      WHEN 2 THEN surname || ' et al. (' || year || ') reported item ' || tag || ' [' || ref_index || '].'
      WHEN 3 THEN 'We first reported what ' || surname || ' et al. (' || year || ') called ' || tag || ' [' || ref_index || '].'
      WHEN 4 THEN 'Method ' || tag || ' was first used (' || surname || ' et al., ' || year || ').'
      WHEN 5 THEN surname || ' et al. [' || ref_index || '] first reported it.'
      WHEN 6 THEN 'It was first reported in ' || year || ' [' || ref_index || '].'
      WHEN 7 THEN surname || ' et al. (' || (CAST(year AS INTEGER) + 1) || ') first reported compound ' || tag || ' [' || ref_index || '].'
      ELSE surname || ' et al. (' || year || ') measured sample ' || tag || ' [' || ref_index || '].'
    END AS text
  FROM r
)"""

_OUTCOME = """
own AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN surname ELSE 'Quist' END AS own_name FROM r WHERE ref_index = 1),
o AS (
  SELECT s.*, own_name, lag(text, 1, '') OVER w AS prev_sentence, lead(text, 1, '') OVER w AS next_sentence,
    CASE WHEN t = 6 THEN 'no_author' WHEN t = 5 THEN 'no_year'
         WHEN t = 8 THEN 'none'
         WHEN t = 3 OR own_name = surname OR t IN (4, 2) OR NOT is_journal OR t = 7 THEN 'vetoed' ELSE 'passed' END AS stage,
    CAST(CASE WHEN t IN (5, 6, 8) THEN 0 WHEN t = 3 OR own_name = surname THEN 2 WHEN t = 4 THEN 1 WHEN t = 2 THEN 9
         WHEN NOT is_journal THEN 3 WHEN t = 7 THEN 7 ELSE 0 END AS INTEGER) AS rule_id
  FROM s JOIN own USING (doc_id)
  WINDOW w AS (PARTITION BY doc_id ORDER BY ref_index)
)"""

_LINES = f"""
spots AS (SELECT *, l_orderkey + l_partkey * 7 AS spot FROM lineitem),
boxes AS (
  SELECT l_suppkey % 10 AS doc_id, CAST(spot // 100 AS INTEGER) AS page_num,
    (CASE WHEN l_linenumber % 2 = 0 THEN 320.0 ELSE 50.0 END)::DOUBLE + fmod(l_quantity, 5) AS x0,
    CAST(60 + (l_orderkey * 13 + l_partkey) % 600 AS DOUBLE) AS y0,
    round(l_discount * 1000) AS extra, 8 + fmod(l_quantity, 7) AS font_size,
    'x' || translate(lpad(CAST(l_partkey AS VARCHAR), 6, '0'), {_DIGITS}) || ' ' ||
    translate(lpad(CAST(l_orderkey AS VARCHAR), 7, '0'), {_DIGITS}) || ' ' ||
    translate(lpad(CAST(l_suppkey AS VARCHAR), 5, '0'), {_DIGITS}) || ' ' ||
    translate(lpad(CAST(l_linenumber AS VARCHAR), 1, '0'), {_DIGITS}) || ' ' || strftime(l_shipdate, '%Y%m%d') AS text
  FROM spots
),
lines AS (SELECT *, x0 + 100 + extra AS x1, y0 + 10 AS y1 FROM boxes),
stats AS (
  SELECT doc_id, page_num, count(*) FILTER (x0 < 286) AS nl, count(*) FILTER (x0 > 286) AS nr,
    min(x0) FILTER (x0 < 286) AS l0, max(x1) FILTER (x0 < 286) AS l1,
    min(x0) FILTER (x0 > 286) AS r0, max(x1) FILTER (x0 > 286) AS r1
  FROM lines GROUP BY 1, 2
),
cols AS (
  SELECT doc_id, page_num, nl > 5 AND nr > 5 AND r0 - l1 > 10 AS two, l0, l1, r0, r1 FROM stats
)"""

_SQUEEZE = r"trim(regexp_replace({0}, '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def _comparable(column: str) -> str:
    plain = rf"regexp_replace({column}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{fffd}}]', '', 'g')"
    plain = f"replace(translate({plain}, '“”‘’‑–—', '\"\"''''---'), '­', '')"
    for ligature, letters in zip("ﬀﬁﬂﬃﬄﬅﬆ", ("ff", "fi", "fl", "ffi", "ffl", "st", "st")):
        plain = f"replace({plain}, '{ligature}', '{letters}')"
    return _SQUEEZE.format(plain)


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_R = _with(_REF_SRC)
_S = _with(_REF_SRC, _SENT)
_O = _with(_REF_SRC, _SENT, _OUTCOME)
_B = _with(_LINES)

_MARKER_OF_T = """CASE t WHEN 0 THEN 'first reported' WHEN 1 THEN 'originally proposed' WHEN 2 THEN 'reported'
  WHEN 3 THEN 'first reported' WHEN 4 THEN 'first used' WHEN 5 THEN 'first reported' WHEN 6 THEN 'first reported'
  WHEN 7 THEN 'first reported' END"""

_BRACKET_ENTRY = """surname || ' A, Coauth B. Title ' || tag || CASE WHEN is_journal THEN ' [J]' ELSE ' [C]' END ||
  '. Journal J, ' || year || ', ' || volume || '(' || issue || '): 10-20.'"""

_CANDIDATES = """
c AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) AS INTEGER) AS cand_id, sent_idx, text,
    CASE t WHEN 0 THEN 'first reported' ELSE 'originally proposed' END AS marker, surname AS author_name, year, ref_index,
    '' AS other_refs_info, prev_sentence, next_sentence, tag, is_journal, volume,
    CASE WHEN doc_id % 2 = 0 THEN surname || ' A' ELSE surname || ', A.' END AS first_author,
    CASE WHEN doc_id % 2 = 0 THEN surname || ' A; Coauth B' ELSE surname || ', A.; Coauth, B.' END AS authors
  FROM o WHERE stage = 'passed'
)"""
_C = _with(_REF_SRC, _SENT, _OUTCOME, _CANDIDATES)
_KEPT = """, first AS (SELECT min(cand_id) AS cand_id, doc_id FROM c WHERE cand_id % 2 = 1 OR cand_id NOT IN (SELECT ref_index FROM r WHERE r.doc_id = c.doc_id)
  GROUP BY doc_id, text, first_author, year)"""

_PAIR = """
p AS (
  SELECT a.doc_id, CAST(a.ref_index - 1 AS INTEGER) AS sent_idx, a.ref_index AS i1, b.ref_index AS i2, a.surname AS n1, b.surname AS n2,
    a.year AS y1, b.year AS y2, a.is_journal AS j1, b.is_journal AS j2,
    a.surname || ' A, ' || a.year || ', ' || CASE WHEN a.is_journal THEN 'Journal J' ELSE '' END AS info1,
    b.surname || ' A, ' || b.year || ', ' || CASE WHEN b.is_journal THEN 'Journal J' ELSE '' END AS info2
  FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.ref_index = a.ref_index + 1
)"""


def _fan_out(marker: str, author1: str, author2: str) -> str:
    return _with(_REF_SRC, _PAIR) + f"""
SELECT doc_id, sent_idx, CAST(0 AS INTEGER) AS pick_no, '{marker}' AS marker, {author1} AS author_name, y1 AS year, i1 AS ref_index,
  CASE WHEN j1 = j2 THEN info2 ELSE '' END AS other_refs_info FROM p WHERE j1 OR NOT j2
UNION ALL
SELECT doc_id, sent_idx, CAST(CASE WHEN j1 = j2 THEN 1 ELSE 0 END AS INTEGER), '{marker}', {author2}, y2, i2,
  CASE WHEN j1 = j2 THEN info1 ELSE '' END FROM p WHERE j2 OR NOT j1"""


_WORKS = f"""
w AS (
  SELECT p_partkey, '10.1000/P' || p_partkey AS doi, p_name, 'x' || translate(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), {_DIGITS}) AS wtag,
    CAST(p_partkey % 9 AS VARCHAR) AS wissue, 'Inst ' || p_brand || ', Japan' AS inst
  FROM part
),
recs AS (SELECT r.*, w.* FROM r JOIN w ON l_partkey = p_partkey)"""

_META = """
meta AS (
  SELECT o_orderkey AS doc_id, c_name, 'On ' || o_orderpriority AS title, 'Journal of ' || c_mktsegment AS journal,
    CAST(year(o_orderdate) AS VARCHAR) AS pyear,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 40 + 1 AS VARCHAR) END AS pvol,
    CASE WHEN o_orderstatus = 'F' THEN '2' END AS pissue
  FROM orders JOIN customer ON o_custkey = c_custkey
),
lined AS (
  SELECT *, c_name || ', Ann Other' AS names,
    CASE WHEN pvol IS NULL THEN '' WHEN pissue IS NULL THEN pvol ELSE pvol || '(' || pissue || ')' END AS vi
  FROM meta
)"""

_REGISTER_COLUMNS = """
  coalesce(names || '. ' || title || '[J]. ' || journal || ', ' || pyear || CASE WHEN vi <> '' THEN ', ' || vi ELSE '' END || ': 1-34.', '') AS reviewing_citation,
  coalesce(c_name, '') AS reviewing_first_author, CASE WHEN c_name IS NULL THEN '' ELSE 'Ann Other' END AS reviewing_other_authors, coalesce(title, '') AS reviewing_title,
  coalesce(journal || ', ' || pyear || CASE WHEN vi <> '' THEN ', ' || vi ELSE '' END || ': 1-34.', '') AS reviewing_journal_line,
  coalesce(journal, '') AS reviewing_journal, coalesce(pyear, '') AS reviewing_year, coalesce(vi || ': 1-34', '') AS reviewing_pages_line,
  CASE WHEN c_name IS NULL THEN '' ELSE 'Some Institute' END AS reviewing_institution, CASE WHEN c_name IS NULL THEN '' ELSE '中国' END AS reviewing_country, 'Sentence about Title ' || tag AS sentence, 'first' AS marker,
  surname || ' A, Coauth B. Title ' || tag || '[J].' || CASE WHEN is_journal THEN ' Journal J,' ELSE '' END || ' ' || year || ', ' || volume ||
    '(' || issue || '): 10-20.' AS evaluated_citation,
  surname || ' A' AS evaluated_first_author, 'Coauth B' AS evaluated_other_authors, 'Title ' || tag AS evaluated_title,
  CASE WHEN is_journal THEN 'Journal J' ELSE '' END || ', ' || year || ', ' || volume || '(' || issue || '): 10-20.' AS evaluated_journal_line,
  CASE WHEN is_journal THEN 'Journal J' ELSE '' END AS evaluated_journal, year AS evaluated_year,
  volume || '(' || issue || '): 10-20.' AS evaluated_pages_line, CASE WHEN is_journal THEN 'Inst' ELSE '' END AS evaluated_institution,
  CASE WHEN is_journal THEN 'Japan' ELSE '' END AS evaluated_country, '' AS other_evaluated, 'P' AS provider, '' AS remark
"""

_ORACLES: dict[str, str] = {
    "funnel_counts": _O + """
SELECT doc_id, count(*) AS total_sentences, count(*) FILTER (stage <> 'none') AS has_marker,
  count(*) FILTER (stage IN ('vetoed', 'passed')) AS has_three_elements, count(*) FILTER (stage = 'passed') AS passed_veto,
  count(*) FILTER (stage = 'passed') AS final_records FROM o GROUP BY doc_id""",
    "candidate_records": _C + """
SELECT doc_id, cand_id, sent_idx, text, marker, author_name, year, ref_index, other_refs_info, prev_sentence, next_sentence,
  'Title ' || tag AS title FROM c""",
    "incremental_corpus": _C + "SELECT doc_id, cand_id, sent_idx, text, marker, author_name, year, ref_index FROM c",
    "veto_outcomes": _O + """
SELECT doc_id, sent_idx, stage, rule_id, substring(text, 1, 80) AS snippet FROM o WHERE stage <> 'none'""",
    "audit_summary": _O + """
SELECT stage, rule_id, count(*) AS n_sentences, count(DISTINCT doc_id) AS n_papers FROM o WHERE stage <> 'none' GROUP BY 1, 2""",
    "sentence_split_docs": r"""
WITH guarded AS (
  SELECT doc_id, regexp_replace(regexp_replace(text,
    '(^|[^A-Za-z.])(e\.g|i\.e|vs|etc|Figs?|Eqs?|Refs?|Vol|No|Dr|Prof|Mr|Mrs|Jr|Sr|Inc|Ltd|Corp|approx|ca|cf|viz|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec|et +al)\.',
    '\1\2␟', 'gi'), '(^|[^\p{L}\p{N}_])([A-Z])\.', '\1\2␟', 'g') AS t FROM documents
),
cut AS (
  SELECT doc_id, string_split(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '([。！？])', '\1␞', 'g'), '([!?])([ \n\t])', '\1␞\2', 'g'), '\.(\n)', '.␞\1', 'g'),
    '\.( +(?:[\p{Lu}\[（"“]|\p{Han}|[0-9]+\.[0-9]))', '.␞\1', 'g'), '␟', '.'), '␞') AS parts FROM guarded
),
kept AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda p: trim(p, E' \t\n\r\x0b\x0c   　')), lambda p: length(p) >= 5) AS k FROM cut
)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_idx, k[i] AS text
FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM kept)""",
    "sentence_recover": _O + """
SELECT doc_id, sent_idx, text, CAST(stop - length(text) AS INTEGER) AS start_pos, CAST(stop AS INTEGER) AS end_pos, prev_sentence, next_sentence
FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ref_index) - 1 AS stop FROM o)""",
    "noise_line_filter": _R + """
SELECT doc_id, CAST(2 * count(*) + 2 + count(*) FILTER (ref_index % 4 <> 0) AS INTEGER) AS n_lines, CAST(2 * count(*) + 2 AS INTEGER) AS n_kept
FROM r GROUP BY doc_id""",
    "ligature_hyphen_normalize": _R + """
SELECT doc_id, ref_index, '“' || tag || ' profile chemical water-in-salt ' || surname || '-repellent title” non-stop soft' AS clean FROM r""",
    "marker_forms": _R + """
SELECT doc_id, ref_index, CASE WHEN ref_index % 4 = 3 THEN 'first discovery' ELSE 'first' END AS canonical,
  'first ' || list_extract(['reported', 'used', 'observed', 'discovery'], CAST(ref_index % 4 + 1 AS INTEGER)) AS trimmed,
  'Body of ' || surname AS body FROM r""",
    "context_lag_lead": """
SELECT conv_id, turn, text, lag(text, 1, '') OVER w AS prev_sentence, lead(text, 1, '') OVER w AS next_sentence
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "context_with_gaps": """
WITH t AS (SELECT conv_id, turn - turn % 4 + CASE WHEN turn % 4 = 3 THEN 2 ELSE 0 END AS turn, text FROM conversations WHERE turn <> 1)
SELECT conv_id, turn, text, lag(text, 1, '') OVER w AS prev_sentence, lead(text, 1, '') OVER w AS next_sentence
FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)""",
    "lexicon_every_phrase": _R + f"""
, p AS (SELECT [{", ".join("'" + p + "'" for p, *_ in default_phrases())}] AS list),
b AS (SELECT [{", ".join("'" + p + "'" for p, _, _, bare in default_phrases() if bare)}] AS bare)
SELECT doc_id, ref_index, phrase AS marker, CAST(length(tag) + 1 AS INTEGER) AS start, CAST(length(tag) + 1 + length(phrase) AS INTEGER) AS "end",
  list_contains(bare, phrase) AS is_bare_word
FROM (SELECT *, list_extract(list, CAST((l_partkey * 7 + ref_index) % len(list) + 1 AS INTEGER)) AS phrase FROM r, p), b""",
    "doc_dedup_first": f"""
SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY {_SQUEEZE.format('text')}""",
    "marker_hits_greedy": _S + f"""
, hits AS (SELECT doc_id, sent_idx, text, {_MARKER_OF_T} AS marker, t = 2 AS bare FROM s)
SELECT doc_id, sent_idx, marker, CAST(strpos(text, marker) - 1 AS INTEGER) AS start,
  CAST(strpos(text, marker) - 1 + length(marker) AS INTEGER) AS "end", bare AS is_bare_word FROM hits WHERE marker IS NOT NULL
UNION ALL SELECT doc_id, CAST(sent_idx + 1000 AS INTEGER), 'proposed', 6, 14, true FROM s
UNION ALL SELECT doc_id, CAST(sent_idx + 1000 AS INTEGER), 'first reported', 15, 29, false FROM s""",
    "lexicon_counts_docs": r"""
WITH words AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
lex AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]{6,}'))
SELECT w AS phrase, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM words JOIN lex USING (w) GROUP BY w""",
    "best_marker": _R + """
SELECT doc_id, ref_index, CASE WHEN ref_index % 2 = 0 THEN 'initially proposed' ELSE 'published' END AS marker FROM r""",
    "year_mentions": _R + """
, y AS (
  SELECT doc_id, ref_index, 12 + length(tag) + 1 AS position, year, false AS in_bracket, false AS is_decade, false AS is_ref_number FROM r WHERE ref_index % 6 = 0
  UNION ALL SELECT doc_id, ref_index, 12 + length(tag) + 1 + 4 + 8, '1980s', false, true, false FROM r WHERE ref_index % 6 = 0
  UNION ALL SELECT doc_id, ref_index, length(tag || ' ran at 2000 rpm in '), year, false, false, false FROM r WHERE ref_index % 6 = 1
  UNION ALL SELECT doc_id, ref_index, length(tag || ' of November 16, 2022 cites ('), year, true, false, false FROM r WHERE ref_index % 6 = 2
  UNION ALL SELECT doc_id, ref_index, length('n=2020 for ' || tag || ', see '), year, false, false, false FROM r WHERE ref_index % 6 = 3
  UNION ALL SELECT doc_id, ref_index, length('ISBN 978-2020-1234 of ' || tag || ' ['), year, true, false, false FROM r WHERE ref_index % 6 = 4
  UNION ALL SELECT doc_id, ref_index, 0, 'ref', false, false, true FROM r WHERE ref_index % 6 = 5
  UNION ALL SELECT doc_id, ref_index, length('在文【7,8】中 ' || tag || ' '), year, false, false, false FROM r WHERE ref_index % 6 = 5
)
SELECT doc_id, ref_index, CAST(position AS INTEGER) AS position, year, in_bracket, is_decade, is_ref_number FROM y""",
    "author_mentions": _R + """
, m AS (
  SELECT doc_id, ref_index, 1 AS position, surname AS name, true AS in_bracket, true AS with_et_al, '' AS ref_numbers, false AS preceded_by_prep FROM r WHERE ref_index % 7 = 0
  UNION ALL SELECT doc_id, ref_index, length('(' || surname || ' et al., ' || year || '; '), 'Quentin', true, false, '', false FROM r WHERE ref_index % 7 = 0
  UNION ALL SELECT doc_id, ref_index, length(tag || ' was made by '), surname, false, true, CAST(ref_index AS VARCHAR), false FROM r WHERE ref_index % 7 = 1
  UNION ALL SELECT doc_id, ref_index, length(tag || ' was made by '), surname, false, false, CAST(ref_index AS VARCHAR), true FROM r WHERE ref_index % 7 = 2
  UNION ALL SELECT doc_id, ref_index, 0, surname, false, false, '', false FROM r WHERE ref_index % 7 = 3
  UNION ALL SELECT doc_id, ref_index, 0, surname, false, false, '', false FROM r WHERE ref_index % 7 = 4
  UNION ALL SELECT doc_id, ref_index, 0, surname, false, true, CAST(ref_index AS VARCHAR), false FROM r WHERE ref_index % 7 = 5
  UNION ALL SELECT doc_id, ref_index, 3, '丁传波', false, true, CAST(ref_index AS VARCHAR), false FROM r WHERE ref_index % 7 = 6
)
SELECT doc_id, ref_index, CAST(position AS INTEGER) AS position, name, in_bracket, with_et_al, ref_numbers, preceded_by_prep FROM m""",
    "citation_number_ranges": _R + """
SELECT doc_id, ref_index, ref_index AS number FROM r
UNION ALL SELECT doc_id, ref_index, CAST(unnest(generate_series(ref_index + 2, ref_index + 2 + line_no % 4)) AS INTEGER) FROM r""",
    "nearest_years": _R + """
SELECT doc_id, ref_index, year FROM r""",
    "reference_parse_bracket": _R + f"""
SELECT doc_id, ref_index, surname || ' A; Coauth B' AS authors, surname || ' A' AS first_author, 'Title ' || tag AS title,
  CASE WHEN is_journal THEN 'Journal J' END AS journal, year, volume, issue, '10-20' AS pages,
  CASE WHEN is_journal THEN 'J' ELSE 'C' END AS ref_type, is_journal, {_BRACKET_ENTRY} AS raw_text FROM r""",
    "reference_parse_dot": _R + """
SELECT doc_id, ref_index, surname || ', A.; Coauth, B.' AS authors, surname || ', A.' AS first_author,
  CASE WHEN is_journal THEN 'Title ' ELSE 'Conference title ' END || tag AS title, 'Journal J' AS journal, year, volume,
  CAST(NULL AS VARCHAR) AS issue, '10-20' AS pages, CASE WHEN is_journal THEN 'J' ELSE 'C' END AS ref_type, is_journal,
  surname || ', A., Coauth, B.: ' || CASE WHEN is_journal THEN 'Title ' ELSE 'Conference title ' END || tag || '. Journal J ' ||
  volume || ', 10–20 (' || year || ')' AS raw_text FROM r""",
    "reference_parse_authoryear": _R + """
SELECT doc_id, CAST(ref_index + 1 AS INTEGER) AS ref_index, surname || ', A.' AS authors, surname || ', A.' AS first_author,
  CASE WHEN is_journal THEN 'Title ' ELSE 'Conference title ' END || tag AS title, 'Journal J' AS journal, year, volume, issue,
  '10-20' AS pages, CASE WHEN is_journal THEN 'J' ELSE 'C' END AS ref_type, is_journal,
  surname || ', A., ' || year || '. ' || CASE WHEN is_journal THEN 'Title ' ELSE 'Conference title ' END || tag || '. Journal J ' ||
  volume || ' (' || issue || '), 10–20.' AS raw_text
FROM r WHERE doc_id IN (SELECT doc_id FROM r WHERE ref_index = 2)""",
    "reference_counts": _R + """
SELECT doc_id, count(*) AS n_refs, count(*) FILTER (is_journal) AS n_journal_refs FROM r GROUP BY doc_id""",
    "ref_type_journal": _R + """
SELECT doc_id, ref_index, list_extract(['J', 'D', 'C', 'D', 'P', 'J'], CAST(ref_index % 6 + 1 AS INTEGER)) AS ref_type, ref_index % 6 IN (0, 5) AS is_journal FROM r""",
    "link_by_number": _S + "SELECT doc_id, sent_idx, CAST(0 AS INTEGER) AS pos, ref_index FROM s WHERE t NOT IN (4, 6)",
    "link_single_number": _S + "SELECT doc_id, sent_idx, CAST(0 AS INTEGER) AS pos, ref_index FROM s WHERE t <> 4",
    "link_author_year": _S + """
SELECT s.doc_id, s.sent_idx, CAST(0 AS INTEGER) AS pos, min(r.ref_index) AS ref_index
FROM s JOIN r ON r.doc_id = s.doc_id AND r.surname = s.surname
  AND r.year = CASE WHEN t = 7 THEN CAST(CAST(s.year AS INTEGER) + 1 AS VARCHAR) ELSE s.year END
WHERE t NOT IN (5, 6) GROUP BY 1, 2""",
    "record_fanout": _fan_out("first reported", "n1", "n1"),
    "independent_pairs": _fan_out("independently reported", "n1", "n2"),
    "self_author_overlap": _O + """
SELECT doc_id, sent_idx, surname AS shared FROM o WHERE own_name = surname AND t <> 6""",
    "verdict_default_accept": """
SELECT d.doc_id, coalesce(l.quality = 1, true) AS accept, CASE WHEN l.doc_id IS NULL THEN 'no answer' ELSE 'label' END AS reason
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "judge_batches": _S + f"""
, q AS (
  SELECT doc_id, ref_index, CAST((ref_index - 1) // 2 AS INTEGER) AS batch_no,
    '候选句 #' || ref_index || ':' || chr(10) || '  原文: "' || text || '"' || chr(10) || '  标志词: first' || chr(10) ||
    '  被评作者: ' || surname || chr(10) || '  年份: ' || year ||
    CASE WHEN is_journal THEN chr(10) || '  匹配参考文献: [' || ref_index || '] ' ||
      substring('[' || ref_index || '] ' || {_BRACKET_ENTRY}, 1, 200) ELSE '' END ||
    CASE WHEN ref_index > 1 THEN chr(10) || '  上下文(前): "Before ' || tag || '"' ELSE '' END AS request
  FROM s
)
SELECT doc_id, batch_no, count(*) AS n_candidates, string_agg(request, chr(10) || chr(10) ORDER BY ref_index) AS request FROM q GROUP BY 1, 2""",
    "json_verdict_parse": _R + """
SELECT doc_id, ref_index AS cand_id, is_journal AS accept, 'a "}{" in ' || tag AS reason, 'Title ' || tag AS title FROM r WHERE doc_id % 7 <> 0""",
    "verdict_counts": _R + """
SELECT doc_id, count(*) FILTER (is_journal OR doc_id % 7 = 0) AS n_accepted,
  count(*) FILTER (NOT (is_journal OR doc_id % 7 = 0)) AS n_rejected FROM r GROUP BY doc_id""",
    "three_source_merge": _R + """
, f AS (SELECT *, ref_index % 3 <> 0 AS has_ref, ref_index % 4 <> 0 AS has_v FROM r)
SELECT doc_id, ref_index,
  CASE WHEN has_ref THEN surname || ' A; Coauth B' WHEN has_v THEN 'Judge J' ELSE 'Cand' END AS authors,
  CASE WHEN has_ref THEN surname || ' A' WHEN has_v THEN 'Judge J' ELSE 'Cand' END AS first_author,
  CASE WHEN has_ref THEN 'Coauth B' END AS other_authors,
  CASE WHEN has_ref AND ref_index % 5 <> 0 THEN 'Title ' || tag WHEN has_v THEN 'Judged title' END AS title,
  CASE WHEN has_ref AND is_journal THEN 'Journal J' WHEN has_v THEN 'Judged journal' END AS journal,
  CASE WHEN has_ref THEN year WHEN has_v THEN '1900' ELSE '1850' END AS year,
  CASE WHEN has_ref AND ref_index % 2 <> 0 THEN volume WHEN has_v THEN '99' END AS volume,
  CASE WHEN has_ref THEN issue WHEN has_v THEN '9' END AS issue,
  CASE WHEN has_ref THEN '10-20' END AS pages,
  CASE WHEN has_v THEN 'Some University' END AS institution, CAST(NULL AS VARCHAR) AS country
FROM f""",
    "works_by_doi": _with(_REF_SRC, _WORKS) + """
SELECT doc_id, ref_index AS cand_id, p_name || ' ' || wtag AS title, 'Lead, Ann; ' || wtag AS authors, wissue AS issue FROM recs WHERE ref_index % 2 = 0""",
    "works_by_title": _with(_REF_SRC, _WORKS) + """
, asked AS (SELECT DISTINCT l_partkey, list_distinct(string_split('study ' || p_name || ' ' || tag, ' ')) AS a FROM recs),
offered AS (SELECT p_partkey, doi, list_distinct(string_split(p_name || ' ' || wtag, ' ')) AS b FROM w),
pairs AS (
  SELECT l_partkey, lower(doi) AS doi, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS sim
  FROM asked JOIN offered ON l_partkey % 50 = 7 OR l_partkey % 10 = p_partkey % 10
),
best AS (SELECT l_partkey, doi, sim FROM pairs WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY sim DESC, doi) = 1)
SELECT doc_id, ref_index AS cand_id, best.doi, round(sim, 6) AS similarity FROM recs JOIN best USING (l_partkey)""",
    "enriched_records": _with(_REF_SRC, _WORKS) + """
SELECT doc_id, ref_index AS cand_id, p_name || ' ' || wtag AS title, 'Lead, Ann; ' || wtag AS authors, wtag AS other_authors,
  CASE WHEN line_no > 3 THEN '5' ELSE wissue END AS issue, '7' AS volume, '1-9' AS pages, inst AS institution, '日本' AS country FROM recs""",
    "country_infer": """
SELECT s_suppkey, 'Dept of ' || s_name || ', City, ' || CASE WHEN s_suppkey % 3 = 0 THEN 'Elsewhere' ELSE n_name END AS institution,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Elsewhere' ELSE r_name END AS country,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE r_name END AS strict_country
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "country_keywords": """
SELECT s_suppkey, list_extract(['中国', 'Indiana', '印度', 'Ukraine', '英国'], CAST(s_suppkey % 5 + 1 AS INTEGER)) AS country FROM supplier""",
    "verify_contains": f"""
WITH d AS (SELECT doc_id, {_comparable('text')} AS t FROM documents), b AS (SELECT item_id, {_comparable('text')} AS p FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(t, p)""",
    "evidence_locate": f"""
WITH d AS (SELECT doc_id, {_comparable('text')} AS t FROM documents), b AS (SELECT item_id, {_comparable('text')} AS p FROM benchmark)
SELECT doc_id, item_id, CAST(strpos(t, p) - 1 AS INTEGER) AS start, CAST(strpos(t, p) - 1 + length(p) AS INTEGER) AS "end", 'exact' AS method
FROM d JOIN b ON contains(t, p)""",
    "verify_records": _S + """
SELECT doc_id, ref_index AS cand_id, text AS sentence FROM s WHERE ref_index % 3 = 0""",
    "evidence_ladder": _S + """
, starts AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ref_index) - 1 - length(text) AS start FROM s)
SELECT doc_id, ref_index AS cand_id, CAST(start AS INTEGER) AS start, CASE WHEN ref_index % 3 <> 1 THEN 'exact' WHEN t = 4 THEN 'without_marks' ELSE 'head_and_tail' END AS method FROM starts""",
    "emphasis_spans": _S + f"""
, n AS (SELECT doc_id, ref_index, text, unnest([{_MARKER_OF_T}, surname, year]) AS needle FROM s)
SELECT doc_id, ref_index, CAST(strpos(text, needle) - 1 AS INTEGER) AS start, CAST(strpos(text, needle) - 1 + length(needle) AS INTEGER) AS "end"
FROM n WHERE needle IS NOT NULL AND strpos(text, needle) > 0""",
    "register_rows": _with(_REF_SRC, _META) + "SELECT doc_id, CAST(ref_index AS BIGINT) AS no," + _REGISTER_COLUMNS + "FROM r LEFT JOIN (SELECT * FROM lined WHERE doc_id % 13 <> 0) USING (doc_id)",
    "register_global_no": _R + """
SELECT doc_id, ref_index AS cand_id, row_number() OVER (ORDER BY doc_id, ref_index) AS no FROM r""",
    "register_hashed_no": _with(_REF_SRC, _META) + "SELECT r.doc_id * 3000000037 - 4000000000000000000 AS doc_id, row_number() OVER (ORDER BY r.doc_id, ref_index) AS no," + _REGISTER_COLUMNS + "FROM r LEFT JOIN lined USING (doc_id)",
    "form_rows": _with(_REF_SRC, _META) + """
, f AS (
  SELECT doc_id, ref_index AS cand_id, [names, journal || ', ' || pyear || ', ' || vi || ': 1-34.', '', 'Some Institute', '', title, '/', '/',
    'Sentence about Title ' || tag,
    surname || ' A, Coauth B. Title ' || tag || '[J].' || CASE WHEN is_journal THEN ' Journal J,' ELSE '' END || ' ' || year || ', ' || volume ||
      '(' || issue || '):10-20.', '', CASE WHEN is_journal THEN 'Inst, Japan' ELSE '' END, 'first', 'P'] AS content,
    ['施评文献作者', '期刊名称，年，卷，期，页', '机构中文名称', '机构英文名称', '中文题目', '英文题目', '论文关键词', '题目关键词', '学术评论句', '被评文献',
     '其他被评文献', '被评作者机构', '标志词', '提供者'] AS label
  FROM r JOIN lined USING (doc_id)
)
SELECT doc_id, cand_id, CAST(i AS INTEGER) AS row_idx, label[i] AS label, content[i] AS content FROM (SELECT *, unnest(range(1, 15)) AS i FROM f)""",
    "reviewing_papers": _with(_META.lstrip("\n")) + """
SELECT doc_id, names AS authors, c_name AS first_author, 'Ann Other' AS other_authors, title, journal, pyear AS year, pvol AS volume,
  pissue AS issue, '1-34' AS pages, 'Some Institute' AS institution, '中国' AS country FROM lined""",
    "assembled_records": _C + """
, first AS (SELECT min(cand_id) AS cand_id, doc_id FROM c WHERE cand_id % 2 = 1 OR cand_id NOT IN (SELECT ref_index FROM r WHERE r.doc_id = c.doc_id)
  GROUP BY doc_id, text, first_author, year)
SELECT doc_id, cand_id, text AS sentence, CASE marker WHEN 'first reported' THEN 'first' ELSE 'originally' END AS marker, authors, first_author,
  'Title ' || tag AS title, 'Journal J' AS journal, year, volume, '10-20' AS pages FROM c JOIN first USING (doc_id, cand_id)""",
    "verify_batches": _C + _KEPT + """
SELECT doc_id, CAST((cand_id - 1) // 2 AS INTEGER) AS batch_no, count(*) AS n_records,
  string_agg('[' || cand_id || '] ' || substring(text, 1, 300), chr(10) ORDER BY cand_id) AS request FROM c JOIN first USING (doc_id, cand_id) GROUP BY 1, 2""",
    "process_corpus": _with(_REF_SRC, _SENT, _OUTCOME, _CANDIDATES, _META) + _KEPT + """
SELECT c.doc_id, row_number() OVER (ORDER BY c.doc_id, cand_id) AS no, coalesce(title, '') AS reviewing_title, text AS sentence,
  CASE marker WHEN 'first reported' THEN 'first' ELSE 'originally' END AS marker, surname || ' A' AS evaluated_first_author, 'Title ' || tag AS evaluated_title,
  year AS evaluated_year, CASE WHEN known THEN 'Inst ' || tag || ', Japan' ELSE '' END AS evaluated_institution,
  CASE WHEN known THEN '日本' ELSE '' END AS evaluated_country, 'P' AS provider
FROM (SELECT *, author_name AS surname, right(tag, 1) IN ('a', 'c', 'e', 'g', 'i') AS known FROM c) c JOIN first USING (doc_id, cand_id) LEFT JOIN lined ON lined.doc_id = c.doc_id""",
    "batch_report": _R + """
, n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1)
SELECT o_orderkey AS doc_id, 'paper-' || o_orderkey AS name, CASE WHEN o_orderstatus = 'P' THEN 'broken file' END AS error,
  coalesce(n, 0) AS n_records, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN n > 0 THEN 'success' ELSE 'no_result' END AS status
FROM orders LEFT JOIN n ON o_orderkey = doc_id""",
    "batch_summary": _R + """
, n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1)
SELECT count(*) AS n_papers, count(*) FILTER (o_orderstatus <> 'P' AND n > 0) AS n_success,
  count(*) FILTER (o_orderstatus <> 'P' AND n IS NULL) AS n_no_result, count(*) FILTER (o_orderstatus = 'P') AS n_failed,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS n_records FROM orders LEFT JOIN n ON o_orderkey = doc_id""",
    "report_document": _R + """
, n AS (SELECT doc_id, count(*) AS n, min_by(surname, ref_index) AS surname, min_by(year, ref_index) AS year FROM r GROUP BY 1),
p AS (
  SELECT o_orderkey AS doc_id, 'paper-' || o_orderkey AS name, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN n > 0 THEN 'success' ELSE 'no_result' END AS status,
    coalesce(n, 0) AS n_records, surname || ' A(' || year || ')' AS first_author FROM orders LEFT JOIN n ON o_orderkey = doc_id)
SELECT row_number() OVER (ORDER BY CASE status WHEN 'success' THEN 0 WHEN 'no_result' THEN 1 ELSE 2 END, n_records DESC, name, doc_id) AS position,
  doc_id, name, status, n_records, CAST(n_records AS INTEGER) AS n_items, first_author FROM p""",
    "routed_results": _R + """
, n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1),
p AS (SELECT o_orderkey AS doc_id, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE coalesce(n, 0) END AS n FROM orders LEFT JOIN n ON o_orderkey = doc_id)
SELECT doc_id, 'paper-' || doc_id AS name, n AS n_records, n > 0 AS has_result,
  CASE WHEN doc_id % 4 = 0 THEN 'no_result' WHEN o_orderstatus = 'P' THEN 'failed' WHEN n > 0 THEN 'success' ELSE 'no_result' END AS status FROM p""",
    "report_items": _R + """
SELECT doc_id, CAST(ref_index - 1 AS INTEGER) AS pos, '&lt;first&gt;' AS marker, surname || ' A(' || year || ')' AS author,
  'Sentence about Title ' || tag AS sentence FROM r""",
    "name_forms": _R + """
SELECT doc_id, ref_index,
  CASE WHEN line_no % 2 = 0 AND ref_index % 4 = 1 THEN 'van der ' || surname ELSE surname END AS surname,
  CASE WHEN line_no % 2 = 0
    THEN list_extract([surname || ' O', 'van der ' || surname || ' J', surname || ' JR', surname || ' AM'], CAST(ref_index % 4 + 1 AS INTEGER))
    ELSE list_extract([surname || ' O', surname || ' JVD', surname || ' JR', surname || ' AM'], CAST(ref_index % 4 + 1 AS INTEGER)) END AS abbreviated FROM r""",
    "reference_parse_chinese": _R + """
SELECT doc_id, ref_index, '张三; 李四' AS authors, '标题' || tag AS title, CASE WHEN is_journal THEN '某某学报' END AS journal, year, volume, issue,
  '10-20' AS pages, CASE WHEN is_journal THEN 'J' ELSE 'D' END AS ref_type, '10.1000/' || tag AS doi FROM r""",
    "metadata_chinese": """
SELECT o_orderkey AS doc_id, '研究' || translate(CAST(o_orderkey AS VARCHAR), '0123456789', '零一二三四五六七八九') || '的方法' AS title_cn,
  '张' || translate(CAST(o_custkey % 100 AS VARCHAR), '0123456789', '零一二三四五六七八九') || '; 李四' AS authors, '安全学报' AS journal_cn,
  CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(o_custkey % 60 + 1 AS VARCHAR) AS volume, '2' AS issue,
  (o_orderkey % 900 + 100) || '-' || (o_orderkey % 900 + 107) AS pages, '某某大学' AS institution_cn, '中国' AS country, '10.1234/ab.' || o_orderkey AS doi FROM orders""",
    "metadata_english": """
SELECT o_orderkey AS doc_id, list_extract(['Journal of Salt', 'Cell Reports', 'Current Biology', 'iScience', 'Heliyon'], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS journal_en,
  CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(o_custkey % 60 + 1 AS VARCHAR) AS volume, CASE WHEN o_orderkey % 5 = 0 THEN '3' END AS issue,
  list_extract(['10-34', '10-34', 'R10-R34', '104642', 'e06955'], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS pages,
  'Department of ' || o_orderpriority || ', Some University, Tokyo, Japan' AS institution_en, '日本' AS country, '10.1000/xyz.' || o_orderkey AS doi FROM orders""",
    "html_title_meta": r"""
SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\s\p{Z}]+', ' ', 'g')), '') AS title FROM pages""",
    "page_columns": _B + """
SELECT doc_id, page_num, CAST(CASE WHEN two THEN 2 ELSE 1 END AS INTEGER) AS n_columns, CASE WHEN two THEN l0 ELSE 0.0 END AS first_x0,
  CASE WHEN two THEN l1 ELSE 612.0 END AS first_x1, CASE WHEN two THEN r0 ELSE 0.0 END AS last_x0, CASE WHEN two THEN r1 ELSE 612.0 END AS last_x1 FROM cols""",
    "column_assignment": _B + """
SELECT doc_id, page_num, CAST(CASE WHEN two AND x0 > 286 THEN 1 ELSE 0 END AS INTEGER) AS col, count(*) AS n_lines, min(x0) AS min_x0
FROM lines JOIN cols USING (doc_id, page_num) GROUP BY 1, 2, 3""",
    "reading_order": _B + """
SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY (x0 + x1) / 2 >= 306, y0, text) AS text FROM lines GROUP BY 1, 2""",
    "line_islands": _B + """
, l AS (SELECT *, CAST(round(y0 / 3) AS BIGINT) AS line FROM lines),
m AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page_num, line ORDER BY x0, x1, y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
f AS (SELECT *, sum(CASE WHEN before IS NULL OR x0 > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_num, line ORDER BY x0, x1, y0, y1 ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, page_num, line, CAST(island AS BIGINT) AS island, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_boxes FROM f GROUP BY 1, 2, 3, 4""",
    "title_by_font": _B + """
SELECT doc_id + page_num * 10 AS doc_id, text AS title FROM lines WHERE y0 <= 400
QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY font_size DESC, y0, x0, text DESC) = 1""",
    "lines_between": _B + """
SELECT doc_id, page_num, x0, y0, text FROM lines JOIN cols USING (doc_id, page_num)
WHERE CASE WHEN two THEN (x0 < 286 AND y0 >= 298) OR (x0 > 286 AND y1 <= 402) ELSE y0 >= 298 AND y1 <= 402 END""",
    "progress_windows": """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_completed,
  count(*) FILTER (event_type = 'purchase') AS n_success, count(*) FILTER (event_type = 'view') AS n_no_result,
  count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY 1""",
    "progress_stream": """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_completed,
  count(*) FILTER (event_type = 'purchase') AS n_success, count(*) FILTER (event_type = 'view') AS n_no_result,
  count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY 1""",
    "evidence_counts": _S + """
SELECT doc_id, count(*) AS n_records, count(*) FILTER (doc_id % 11 <> 0) AS n_located, count(*) FILTER (t <> 4) AS n_references FROM s GROUP BY 1""",
}


def all_oracles() -> dict[str, str]:
    from acclaim.testing.page_queries import PAGE_ORACLES

    return _ORACLES | PAGE_ORACLES
