"""SQL text for the result check: each registered query again, as one statement over the
given tables. Written independently of the DataFrame code, in plain joins and groupings."""

from __future__ import annotations

from docloom import constants as C

# ---- catalog and index tables -------------------------------------------------------------

CATALOG = """
parts AS (
  SELECT doc_id AS i, source, n_chars, text,
         CASE doc_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.xlsx'
           WHEN 3 THEN '.txt' WHEN 4 THEN '.md' WHEN 5 THEN '.csv' WHEN 6 THEN '.PDF'
           ELSE '.zip' END AS ext_raw,
         CASE doc_id % 13 WHEN 0 THEN '/Node_Modules' WHEN 1 THEN '/.git/x'
           WHEN 2 THEN '/Year 2024' WHEN 4 THEN '/x$Recycle.Bin2' ELSE '' END AS sub_dir,
         CASE WHEN doc_id % 17 = 0 THEN '~$' WHEN doc_id % 19 = 0 THEN '.' ELSE '' END
           || lang || ' report ' || CAST(doc_id AS VARCHAR) AS stem
  FROM documents),
catalog AS (
  SELECT i AS doc_id, stem || ext_raw AS file_name,
         '/Corpus/' || source || sub_dir || '/' || stem || ext_raw AS file_path,
         '/Corpus/' || source || sub_dir AS file_directory,
         lower(ext_raw) AS file_extension, substr(lower(ext_raw), 2) AS file_type,
         sub_dir, n_chars AS file_size,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(i * 37) AS modified_date,
         text AS content,
         sha256(lower('/Corpus/' || source || sub_dir || '/' || stem || ext_raw)) AS id
  FROM parts)"""

INDEX = CATALOG + """,
index_paths AS (
  SELECT doc_id, file_name, file_type, file_extension,
         CASE WHEN doc_id % 14 = 0 THEN '/Corpus/Old/' || file_name
              WHEN doc_id % 7 = 0 THEN '/Offline/' || file_name
              WHEN doc_id % 3 = 0 THEN upper(file_path) ELSE file_path END AS file_path,
         CASE WHEN doc_id % 5 = 0 THEN modified_date - INTERVAL 1 HOUR
              WHEN doc_id % 9 = 4 THEN modified_date - INTERVAL 1 SECOND
              ELSE modified_date END AS modified_date,
         file_size + CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END AS file_size, content
  FROM catalog),
stored AS (SELECT *, lower(file_path) AS norm_path, sha256(lower(file_path)) AS id
           FROM index_paths)"""


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


ACCEPTED = f"""(file_extension IN {_list(C.DOCUMENT_EXTENSIONS)}
  AND left(file_name, 1) NOT IN ('~', '.')
  AND sub_dir NOT IN ('/Node_Modules', '/.git/x', '/x$Recycle.Bin2'))"""

STATUS = INDEX + f""",
statuses AS (
  SELECT coalesce(c.id, s.id) AS id, coalesce(lower(c.file_path), s.norm_path) AS norm_path,
         CASE WHEN c.id IS NULL
                THEN CASE WHEN s.norm_path LIKE '/corpus/%' THEN 'ghost' ELSE 'kept' END
              WHEN NOT c.ok THEN 'ignored'
              WHEN s.id IS NOT NULL AND s.modified_date = c.modified_date
                   AND s.file_size = c.file_size THEN 'skipped'
              ELSE 'indexed' END AS status,
         c.file_size, c.modified_date
  FROM (SELECT *, {ACCEPTED} AS ok FROM catalog) c FULL JOIN stored s ON c.id = s.id)"""


def mirror(strict: bool) -> str:
    other = "'EXTRA'" if strict else "'DELETE'"
    newer = "c.m > s.m" if strict else "epoch_us(c.m) - epoch_us(s.m) > 2000000"
    return "WITH " + INDEX + f""",
c AS (SELECT substr(lower(file_path), 2) AS rel_path, modified_date AS m, file_size AS b
      FROM catalog),
s AS (SELECT substr(norm_path, 2) AS rel_path, modified_date AS m, file_size AS b FROM stored)
SELECT coalesce(c.rel_path, s.rel_path) AS rel_path,
       CASE WHEN c.rel_path IS NULL THEN {other}
            WHEN s.rel_path IS NULL OR {newer} THEN 'COPY' ELSE 'SKIP' END AS action,
       c.m AS src_mtime, s.m AS dst_mtime, coalesce(c.b, s.b) AS bytes
FROM c FULL JOIN s ON c.rel_path = s.rel_path"""


# ---- tokens -------------------------------------------------------------------------------


def tokens(text: str) -> str:
    """Tokens of an expression. The dialect has no look-around, so joining punctuation is
    first put between two private marks (twice, as matches may overlap)."""
    s = f"lower({text})"
    for left, mid in ((r"\p{L}", ".''’:·"), (r"\p{N}", ".,;''")):
        for _ in range(2):
            s = (
                f"regexp_replace({s}, '({left})([{mid}])({left})', "
                "'\\1' || chr(57344) || '\\2' || chr(57344) || '\\3', 'g')"
            )
    return (
        f"list_transform(regexp_extract_all({s}, "
        r"'(?:[\p{L}\p{M}\p{N}_]|\x{E000}.\x{E000})+'), "
        "lambda tk: replace(tk, chr(57344), ''))"
    )


POSTINGS = CATALOG + f""",
toks AS (
  SELECT doc_id, 'content' AS field, unnest({tokens('content')}) AS term FROM catalog
  UNION ALL
  SELECT doc_id, 'file_name' AS field, unnest({tokens('file_name')}) AS term FROM catalog),
dl AS (SELECT doc_id, field, count(*) AS dl FROM toks GROUP BY ALL),
post AS (SELECT doc_id, field, term, count(*) AS tf FROM toks GROUP BY ALL)"""

SCORED = POSTINGS + """,
fs AS (SELECT field, count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM dl GROUP BY field),
ts AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
scored AS (
  SELECT doc_id, field, term,
         ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf
           / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS s,
         CASE field WHEN 'content' THEN 3.0 ELSE 5.0 END AS boost
  FROM post JOIN dl USING (doc_id, field) JOIN fs USING (field) JOIN ts USING (field, term))"""

ORDER_BY = {
    "relevance": "full_score DESC NULLS LAST",
    "date_desc": "modified_date DESC NULLS LAST",
    "date_asc": "modified_date ASC NULLS LAST",
    "name_asc": "file_name ASC NULLS LAST",
    "size_desc": "file_size DESC NULLS LAST",
}


def hits(
    must: list[list[str]], types: list[str] = (), excluded: list[str] = (), raw: list[str] = ()
) -> str:
    """All hits of one query as the CTE ``found``; ``must`` holds the tokens of each term."""
    clauses = [(i, t) for i, term in enumerate(must) for t in term]
    where = ["true"]
    if types:
        where.append(f"file_type IN {_list(types)}")
    if excluded:
        where.append(f"doc_id NOT IN (SELECT doc_id FROM post WHERE term IN {_list(excluded)})")
    if raw:
        where.append(f"file_path NOT IN {_list(raw)}")
    bonus = 1.0 if types else 0.0
    if not clauses:
        return "WITH " + POSTINGS + f""",
found AS (SELECT *, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS full_score FROM catalog WHERE {' AND '.join(where)})"""
    values = ", ".join(f"({i}, '{t}')" for i, t in clauses)
    return "WITH " + SCORED + f""",
q(clause, term) AS (VALUES {values}),
per_field AS (SELECT doc_id, clause, field, sum(s * boost) AS s
              FROM scored JOIN q USING (term) GROUP BY ALL),
per_clause AS (SELECT doc_id, clause, max(s) AS s FROM per_field GROUP BY ALL),
per_doc AS (SELECT doc_id, sum(s) AS s FROM per_clause GROUP BY doc_id
            HAVING count(*) = {len(must)}),
found AS (SELECT c.*, round(p.s + {bonus}, 6) AS score, round(p.s + {bonus}, 9) AS full_score
          FROM catalog c JOIN per_doc p USING (doc_id) WHERE {' AND '.join(where)})"""


def page(found: str, order: str, number: int = 1, columns: str = "doc_id") -> str:
    keys = f"{ORDER_BY[order]}, doc_id"
    return found + f""",
ranked AS (SELECT *, row_number() OVER (ORDER BY {keys}) AS rank FROM found)
SELECT rank, {columns} FROM ranked
WHERE rank > {(number - 1) * 100} AND rank <= {number * 100}"""


# ---- query strings ------------------------------------------------------------------------

QUERY_LOG = """
asked_once AS (
  SELECT item_id AS query_id,
         CASE item_id % 8
           WHEN 1 THEN 'pdf ' || text
           WHEN 2 THEN text || ' NOT (qqq)'
           WHEN 3 THEN 'md OR txt OR docx ' || text
           WHEN 4 THEN 'report the -' || CAST(item_id AS VARCHAR) || ' ' || text
           WHEN 5 THEN 'csv xlsx ' || regexp_replace(text, '([^\\s]+)', '-\\1', 'g')
           WHEN 6 THEN regexp_replace(text, '([^\\s]+)', '-\\1', 'g')
           ELSE text END AS query
  FROM benchmark),
query_log AS (
  SELECT * FROM asked_once
  UNION ALL SELECT query_id + 1000000, query FROM asked_once
  UNION ALL SELECT item_id + 2000000,
    CASE WHEN item_id % 3 = 0 THEN '' ELSE 'docx md ' END || 'NOT ' || regexp_extract(text, '[^\\s]+')
      || 'zz -report' || CAST(item_id AS VARCHAR)
  FROM benchmark)"""

_NEG = r"regexp_matches(u, '^(?i:NOT)[\s\p{Z}]+[^\s\p{Z}]')"
_DASH = "(left(u, 1) = '-' AND length(u) > 1)"
_TYPE = "ltrim(lower(u), '.')"


def classified(source: str, key: str, text: str) -> str:
    """CTE ``parsed(key, types, must, must_not)`` of the query strings in ``source``."""
    word = f"NOT {_NEG} AND NOT {_DASH} AND upper(u) NOT IN ('AND', 'OR', 'NOT')"
    is_type = f"{_TYPE} IN {_list(C.QUERY_FILE_TYPES)}"
    return rf"""
units AS (
  SELECT {key}, regexp_extract_all(
    regexp_replace({text}, 'NOT[\s\p{{Z}}]*\([\s\p{{Z}}]*([^)]+)[\s\p{{Z}}]*\)', ' NOT \1 ', 'gi'),
    '(?i:NOT)[\s\p{{Z}}]+[^\s\p{{Z}}]+|[^\s\p{{Z}}]+') AS us
  FROM {source}),
parsed AS (
  SELECT {key},
    list_transform(list_filter(us, lambda u: {word} AND {is_type}), lambda u: {_TYPE}) AS types,
    list_filter(us, lambda u: {word} AND NOT {is_type}) AS must,
    list_filter(
      list_transform(
        list_filter(us, lambda u: {_NEG} OR {_DASH}),
        lambda u: CASE WHEN {_NEG}
          THEN nullif(trim(regexp_replace(u, '^(?i:NOT)[\s\p{{Z}}]+', ''), '()'), '')
          ELSE trim(substr(u, 2), '()') END),
      lambda v: v IS NOT NULL) AS must_not
  FROM units)"""


BATCH = "WITH " + SCORED + "," + QUERY_LOG + "," + classified(
    "query_log", "query_id", "query"
) + f""",
must_terms AS (SELECT query_id, unnest(must) AS term, generate_subscripts(must, 1) AS clause
               FROM parsed),
must_tokens AS (SELECT query_id, clause, unnest({tokens('term')}) AS term FROM must_terms),
not_terms AS (SELECT query_id, unnest(must_not) AS raw FROM parsed),
not_tokens AS (SELECT query_id, unnest({tokens('raw')}) AS term FROM not_terms),
per_field AS (SELECT query_id, doc_id, clause, field, sum(s * boost) AS s
              FROM must_tokens JOIN scored USING (term) GROUP BY ALL),
per_clause AS (SELECT query_id, doc_id, clause, max(s) AS s FROM per_field GROUP BY ALL),
per_doc AS (SELECT query_id, doc_id, sum(s) AS s, count(*) AS met FROM per_clause GROUP BY ALL),
must_hits AS (SELECT d.query_id, d.doc_id, d.s FROM per_doc d JOIN parsed p USING (query_id)
              WHERE d.met = len(p.must)),
all_hits AS (
  SELECT query_id, doc_id, s, true AS has_must FROM must_hits
  UNION ALL
  SELECT p.query_id, c.doc_id, 0.0 AS s, false AS has_must
  FROM parsed p, catalog c WHERE len(p.must) = 0),
excluded AS (
  SELECT query_id, doc_id FROM not_tokens JOIN post USING (term)
  UNION
  SELECT n.query_id, c.doc_id FROM not_terms n JOIN catalog c ON c.file_path = n.raw),
kept AS (
  SELECT h.query_id, h.doc_id, h.has_must, c.modified_date,
         CASE WHEN h.has_must
           THEN round(h.s + CASE WHEN len(p.types) > 0 THEN 1.0 ELSE 0.0 END, 9) END AS full_score,
         round(full_score, 6) AS score
  FROM all_hits h JOIN parsed p USING (query_id) JOIN catalog c USING (doc_id)
       LEFT JOIN excluded e ON e.query_id = h.query_id AND e.doc_id = h.doc_id
  WHERE e.doc_id IS NULL AND (len(p.types) = 0 OR list_contains(p.types, c.file_type))),
ranked AS (
  SELECT query_id, doc_id, score, row_number() OVER (
    PARTITION BY query_id
    ORDER BY full_score DESC NULLS LAST, CASE WHEN NOT has_must THEN modified_date END DESC NULLS LAST,
             doc_id) AS rank
  FROM kept)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


# ---- fragments ------------------------------------------------------------------------------


def _mark(piece: str, terms: list[str], escape: bool) -> str:
    s = piece
    for left, mid in ((r"\p{L}", ".''’:·"), (r"\p{N}", ".,;''")):
        for _ in range(2):
            s = (
                f"regexp_replace({s}, '({left})([{mid}])({left})', "
                "'\\1' || chr(57344) || '\\2' || chr(57344) || '\\3', 'g')"
            )
    wrapped = (
        f"regexp_replace({s}, '((?:[\\p{{L}}\\p{{M}}\\p{{N}}_]|\\x{{E000}}.\\x{{E000}})+)', "
        "chr(57346) || '\\1' || chr(57346), 'g')"
    )
    parts = f"string_split(replace({wrapped}, chr(57344), ''), chr(57346))"
    shown = escaped("part") if escape else "part"
    return (
        f"array_to_string(list_transform({parts}, lambda part: CASE WHEN lower(part) IN "
        f"{_list(terms)} THEN '<mark>' || {shown} || '</mark>' ELSE {shown} END), '')"
    )


def escaped(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        text = f"replace({text}, '{a}', '{b}')"
    return text


def passage_score(terms: list[str]) -> str:
    """The score of ``piece``, which has ``start``, by its tokens and those of ``content``."""

    def times(text: str, term: str) -> str:
        return f"len(list_filter({text}, lambda x: x = '{term}'))::DOUBLE"

    damp = "1.2 * (0.25 + 0.75 * length(piece) / 87.0)"
    points = [
        f"2.2 * ln(1 + (length(content) / 87.0 + 1.5) / ({times('all_tokens', t)} + 0.5))"
        f" * {times('piece_tokens', t)} / ({times('piece_tokens', t)} + {damp})"
        for t in terms
    ]
    return f"round(({' + '.join(points)}) * (1 + 1 / ln(start + 87.0)), 9)"


def passage_snippets(found: str, terms: list[str]) -> str:
    """Like :func:`snippets`, the pieces ranked by :func:`passage_score`."""
    sql = snippets(found, terms)
    a, b = sql.index("ranked_pieces AS ("), sql.index("best AS (")
    return sql[:a] + f"""cut_pieces AS (
  SELECT *, rtrim(raw_piece, chr(32) || chr(9) || chr(13) || chr(10)) AS piece FROM pieces),
ranked_pieces AS (
  SELECT *, {passage_score(terms)} AS n_terms
  FROM (SELECT *, {tokens('piece')} AS piece_tokens, coalesce(sum(length(piece)) OVER (
          PARTITION BY doc_id ORDER BY s_no, p_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM cut_pieces)
  JOIN (SELECT doc_id, content, {tokens('content')} AS all_tokens FROM found) USING (doc_id)),
""" + sql[b:]


def snippets(
    found: str, terms: list[str], escape: bool = False, source: str = "found", columns: str = ""
) -> str:
    """``doc_id, snippet`` of every row of ``source`` (which has ``doc_id`` and ``content``)."""
    n = C.FRAGMENT_CHARS
    plain = f"CASE WHEN length(content) > 0 THEN left(content, 300) || '...' ELSE '{C.NO_PREVIEW}' END"
    return found + rf""",
sentences AS (
  SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS s_no
  FROM (SELECT doc_id, string_split(
          regexp_replace(content, '([.!?])[ \t\r\n]+|\n', '\1' || chr(57345), 'g'), chr(57345)) AS ss
        FROM {source})),
pieces AS (
  SELECT doc_id, s_no, unnest(ps) AS raw_piece, generate_subscripts(ps, 1) AS p_no
  FROM (SELECT doc_id, s_no, regexp_extract_all(sentence,
          '(?s)[^ \t\r\n].{{0,{n - 1}}}(?:[ \t\r\n]|$)|[^ \t\r\n]{{{n}}}') AS ps FROM sentences)),
ranked_pieces AS (
  SELECT *, rtrim(raw_piece, chr(32) || chr(9) || chr(13) || chr(10)) AS piece,
         len(list_intersect(list_distinct({tokens("raw_piece")}), {_list(terms).replace("(", "[").replace(")", "]")})) AS n_terms
  FROM pieces),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_terms DESC, s_no, p_no) AS r
  FROM ranked_pieces WHERE n_terms > 0),
marked AS (
  SELECT doc_id, string_agg({_mark('piece', terms, escape)}, ' ... ' ORDER BY s_no, p_no) AS m
  FROM best WHERE r <= 2 GROUP BY doc_id)
SELECT {columns}f.doc_id, coalesce(m, {escaped(plain) if escape else plain}) AS snippet
FROM {source} f LEFT JOIN marked USING (doc_id)"""
