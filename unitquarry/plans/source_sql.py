"""The SQL that states the queries on source text: tokens by one pattern, structure by windows, chunks by a recursive walk."""

_TEXT = r"regexp_replace(regexp_replace(source_text, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g')"
_SPLIT = rf"CASE WHEN {_TEXT} = '' THEN [] ELSE string_split(regexp_replace({_TEXT}, '\n\z', ''), chr(10)) END"
_L = f"a AS (SELECT file_id, {_SPLIT} AS l FROM source_files WHERE source_text IS NOT NULL), l AS (SELECT file_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line FROM a)"
_BLANK = r"[\s\v\x1c-\x1f\x{85}\pZ]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_UNIT = r"regexp_replace(regexp_extract(file_path, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1')"
_PLAIN = r"regexp_replace(text, '''[^'']*(''|$)|\{[^}]*(\}|$)|//.*$', '', 'g')"
_W = r"[\p{L}\p{N}_]"
_KINDS = "('class', 'record', 'interface', 'dispinterface', 'object')"
_NEAR = r"length(text) - length(regexp_replace(text, '^\s+', '')) <= 4"
_TYPES = rf"""th AS (SELECT file_id, line, regexp_extract(regexp_replace(string_split(text, '=')[1], '\s*<[^>]+>\s*$', ''), '^\s*({_W}+)\s*$', 1) AS name,
  regexp_extract(substr(text, length(string_split(text, '=')[1]) + 2), '^\s*({_W}+)\s*({_W}*)', ['a', 'b']) AS m, {_NEAR} AS near FROM l),
ty AS (SELECT file_id, line, name AS identifier, lower(CASE WHEN lower(m.a) = 'packed' THEN m.b ELSE m.a END) AS kind FROM th WHERE near AND name <> '' AND lower(CASE WHEN lower(m.a) = 'packed' THEN m.b ELSE m.a END) IN {_KINDS})"""
_ROUTINES = r"""rh AS (SELECT file_id, line, regexp_extract(text, '^\s*(\S+)\s+(\S+)', ['k', 'n']) AS m, NEAR AS near FROM l),
ro AS (SELECT file_id, line, regexp_extract(m.n, '^[\pL\pN_.]+') AS identifier, lower(m.k) AS kind FROM rh WHERE near AND lower(m.k) IN ('procedure', 'function', 'constructor', 'destructor') AND regexp_extract(m.n, '^[\pL\pN_.]+') <> '')""".replace("NEAR", _NEAR)
_SHOWN = r"CASE WHEN lower(trim(regexp_replace(PLAIN, '\s+', ' ', 'g'))) IN ('published', 'public', 'protected', 'private', 'strict protected', 'strict private') THEN string_split(lower(trim(regexp_replace(PLAIN, '\s+', ' ', 'g'))), ' ')[-1] END".replace("PLAIN", _PLAIN)

_TOKEN = rf"{_BLANK}+|\{{[^}}]*\}}?|\(\*\)|\(\*(?s:.*?)(?:\*\)|\z)|//[^\n]*|''(?:''''|[^''])*''?|[\pL\p{{Nl}}\p{{No}}_][\pL\pN_]*|\p{{Nd}}[\p{{Nd}}.]*|(?s:.)"
_KIND = rf"""CASE WHEN starts_with(text, '{{$') OR starts_with(text, '(*$') THEN 'directive' WHEN text[1] = '{{' OR starts_with(text, '(*') OR starts_with(text, '//') THEN 'comment' WHEN text[1] = '''' THEN 'string'
  WHEN regexp_matches(text, '^{_BLANK}') THEN 'whitespace' WHEN regexp_matches(text, '^\p{{Nd}}') THEN 'number' WHEN regexp_matches(text, '^[\pL\p{{Nl}}\p{{No}}_]') THEN 'identifier' ELSE 'symbol' END"""


def _tokens(source: str = "source_text") -> str:
    return rf"""t0 AS (SELECT file_id, regexp_extract_all({source}, '{_TOKEN}') AS l FROM source_files WHERE source_text IS NOT NULL),
t1 AS (SELECT file_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM t0), t AS (SELECT *, {_KIND} AS kind FROM t1)"""


_PLACES = r"""p0 AS (SELECT *, sum(length(text)) OVER w AS z, sum(length(text) - length(replace(text, chr(10), ''))) OVER w AS nl FROM t WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
p1 AS (SELECT *, z - length(text) AS o, max(CASE WHEN contains(text, chr(10)) THEN z - length(regexp_extract(text, '[^\n]*\z')) ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos) AS s FROM p0),
p AS (SELECT file_id, pos, kind, text, (1 + coalesce(lag(nl) OVER w, 0))::INTEGER AS start_line, (o - coalesce(lag(s) OVER w, 0) + 1)::INTEGER AS start_column, (1 + nl)::INTEGER AS end_line, (z - s + 1)::INTEGER AS end_column FROM p1 WINDOW w AS (PARTITION BY file_id ORDER BY pos))"""

_REGIONS = rf"""i0 AS (SELECT *, trim(text) AS x FROM p WHERE kind = 'directive'),
i1 AS (SELECT *, {_trim("CASE WHEN starts_with(x, '{$') AND ends_with(x, '}') THEN substr(x, 3, length(x) - 3) WHEN starts_with(x, '(*$') AND ends_with(x, '*)') THEN substr(x, 4, length(x) - 5) ELSE x END")} AS y FROM i0),
m AS (SELECT * EXCLUDE (text, kind), upper(split_part(y, ' ', 1)) AS directive, nullif({_trim("regexp_extract(y, '(?s)^[^ ]+ +(.*)$', 1)")}, '') AS condition FROM i1 WHERE y <> ''),
d AS (SELECT *, CASE WHEN directive IN ('ENDIF', 'IFEND') THEN -1 ELSE 1 END AS step FROM m WHERE directive IN ('IFDEF', 'IFNDEF', 'IF', 'IFOPT', 'ENDIF', 'IFEND')),
d1 AS (SELECT *, sum(step) OVER w AS total FROM d WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
d2 AS (SELECT *, least(0, min(total) OVER (PARTITION BY file_id ORDER BY pos)) AS low, least(0, min(total) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS was FROM d1),
stray AS (SELECT * FROM d2 WHERE step = -1 AND low < coalesce(was, 0)),
kept AS (SELECT *, total - low + CASE WHEN step = -1 THEN 1 ELSE 0 END AS depth FROM d2 WHERE NOT (step = -1 AND low < coalesce(was, 0))),
met AS (SELECT *, lead(pos) OVER w AS until, lead(end_line) OVER w AS line, lead(end_column) OVER w AS col FROM kept WINDOW w AS (PARTITION BY file_id, depth ORDER BY pos))"""

_SECTIONS = "('interface', 'implementation', 'initialization', 'finalization')"
_LEAVES = "('const', 'var', 'procedure', 'function', 'class', 'constructor', 'destructor', 'implementation', 'initialization', 'finalization', 'begin')"
_PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_NODES = f"""g AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS i, CASE WHEN kind = 'identifier' THEN lower(text) ELSE '' END AS w FROM p WHERE kind IN ('identifier', 'symbol', 'string', 'number')),
g1 AS (SELECT *, w <> '' AND lead(kind) OVER o = 'symbol' AND lead(text) OVER o = '=' AND coalesce(lead(w, 2) OVER o, '') IN ('class', 'record', 'interface') AS decl, lead(w, 2) OVER o AS of, lead(end_line, 2) OVER o AS l2, lead(end_column, 2) OVER o AS c2,
  min(CASE WHEN kind = 'symbol' AND text = ';' THEN i END) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM g WINDOW o AS (PARTITION BY file_id ORDER BY i)),
g2 AS (SELECT *, coalesce(lag(decl, 2) OVER (PARTITION BY file_id ORDER BY i), false) AS dk FROM g1),
g3 AS (SELECT *, w = 'uses' AND count(*) FILTER (w IN {_SECTIONS} AND NOT dk) OVER (PARTITION BY file_id ORDER BY i) > 0 AS u0 FROM g2),
g4 AS (SELECT *, u0 AND row_number() OVER (PARTITION BY file_id, u0, stop ORDER BY i) = 1 AS us FROM g3),
g5 AS (SELECT *, coalesce(max(CASE WHEN us THEN coalesce(stop, 1000000000) END) OVER (PARTITION BY file_id ORDER BY i {_PRIOR}) >= i, false) AS inside, max(CASE WHEN us THEN i END) OVER (PARTITION BY file_id ORDER BY i {_PRIOR}) AS clause FROM g4),
g6 AS (SELECT *, CASE WHEN inside THEN NULL WHEN w IN {_SECTIONS} AND NOT dk THEN 0 WHEN w = 'type' THEN 1 WHEN w IN {_LEAVES} AND NOT dk THEN 0 END AS event FROM g5),
g7 AS (SELECT *, decl AND NOT inside AND w NOT IN {_SECTIONS} AND w NOT IN {_LEAVES} AND w NOT IN ('type', 'uses') AND coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY i {_PRIOR}), 0) = 1 AS active FROM g6),
g8 AS (SELECT *, CASE WHEN NOT inside AND w IN {_SECTIONS} AND NOT (dk AND coalesce(lag(active, 2) OVER (PARTITION BY file_id ORDER BY i), false)) THEN w END AS mark FROM g7),
g9 AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY i) AS section FROM g8),
s AS (SELECT file_id, i, mark || '_section' AS kind, mark AS name, start_line, start_column, end_line, end_column, NULL::VARCHAR AS parent FROM g9 WHERE mark IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, mark ORDER BY i) = 1),
c0 AS (SELECT *, kind = 'symbol' AND text IN (',', ';') AS sep, count(*) FILTER (kind = 'symbol' AND text IN (',', ';')) OVER (PARTITION BY file_id, clause ORDER BY i {_PRIOR}) AS part FROM g9 WHERE inside),
c1 AS (SELECT *, bool_or(w = 'in') OVER (PARTITION BY file_id, clause, part ORDER BY i) AS skip FROM c0),
c AS (SELECT file_id, max(CASE WHEN sep THEN i END) AS i, 'uses' AS kind, trim(string_agg(text, '' ORDER BY i) FILTER (NOT skip AND (kind = 'identifier' OR kind = 'symbol' AND text = '.')), '.') AS name, 0 AS start_line, 0 AS start_column, 0 AS end_line, 0 AS end_column, min(section) AS parent FROM c1 GROUP BY file_id, clause, part),
y AS (SELECT file_id, i, CASE of WHEN 'interface' THEN 'interface_type' ELSE of END AS kind, text AS name, start_line, start_column, l2 AS end_line, c2 AS end_column, section AS parent FROM g9 WHERE active),
n0 AS (FROM s UNION ALL FROM (SELECT * FROM c WHERE i IS NOT NULL AND name <> '') UNION ALL FROM y),
n1 AS (SELECT *, 'n' || (1 + row_number() OVER (PARTITION BY file_id ORDER BY i)) AS id FROM n0),
whole AS (SELECT file_id, min(pos) AS a, max(pos) AS b FROM g GROUP BY file_id),
named AS (SELECT file_id, text FROM (SELECT file_id, i, lead(text) OVER o AS text, w, lead(w) OVER o AS next FROM g WINDOW o AS (PARTITION BY file_id ORDER BY i)) WHERE w = 'unit' AND next <> '' QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY i) = 1),
nodes AS (SELECT f.file_id, 'n1' AS id, NULL::VARCHAR AS parent_id, 'unit' AS kind, coalesce(named.text, '<unknown-unit>') AS name, coalesce(pa.start_line, 0) AS start_line, coalesce(pa.start_column, 0) AS start_column, coalesce(pb.end_line, 0) AS end_line, coalesce(pb.end_column, 0) AS end_column
    FROM source_files f LEFT JOIN whole ON whole.file_id = f.file_id LEFT JOIN named ON named.file_id = f.file_id LEFT JOIN p pa ON pa.file_id = f.file_id AND pa.pos = whole.a LEFT JOIN p pb ON pb.file_id = f.file_id AND pb.pos = whole.b WHERE source_text IS NOT NULL
  UNION ALL SELECT n.file_id, n.id, coalesce(q.id, 'n1'), n.kind, n.name, n.start_line, n.start_column, n.end_line, n.end_column FROM n1 n LEFT JOIN n1 q ON q.file_id = n.file_id AND q.kind = n.parent || '_section')"""
_STRUCTURE = f"WITH {_tokens()}, {_PLACES}, {_NODES}"
_TYPE_NODES = "kind IN ('class', 'record', 'interface_type')"

_NORMAL = rf"""WITH {_tokens()}, e0 AS (SELECT file_id, pos, kind, CASE WHEN kind IN ('directive', 'comment') THEN {_trim('text')} ELSE text END AS x FROM t WHERE kind <> 'whitespace'),
e1 AS (SELECT *, lag(kind) OVER o AS k0, lag(x) OVER o AS x0 FROM e0 WINDOW o AS (PARTITION BY file_id ORDER BY pos)),
e2 AS (SELECT *, k0 IS NULL AS first, kind = 'directive' OR coalesce(k0 = 'directive', false) OR (kind = 'identifier' AND lower(x) IN ('unit', 'interface', 'implementation', 'initialization', 'finalization', 'type', 'var', 'const')) OR coalesce(k0 = 'symbol' AND x0 = ';', false) AS breaks FROM e1),
e AS (SELECT file_id, pos, CASE WHEN first THEN '' WHEN breaks THEN chr(10) WHEN kind = 'comment' OR (kind <> 'symbol' AND (k0 <> 'symbol' OR x0 IN (')', ']'))) THEN ' ' ELSE '' END || x || CASE WHEN kind = 'symbol' AND x = ',' THEN ' ' ELSE '' END AS piece FROM e2),
f AS (SELECT file_id, regexp_replace(replace(string_agg(piece, '' ORDER BY pos), chr(13) || chr(10), chr(10)), '[\n \t]+\z', '') AS text FROM e GROUP BY file_id)
SELECT file_id, md5(coalesce(text, '')) AS md5, length(coalesce(text, '')) AS size FROM (SELECT file_id FROM source_files WHERE source_text IS NOT NULL) LEFT JOIN f USING (file_id)"""

_WORDS = rf"regexp_extract_all(lower({_PLAIN}), '{_W}+')"
_COUNT = "len(list_filter(ws, lambda v: v = '{}'))"
_CHUNKS = rf"""WITH RECURSIVE {_L}, {_TYPES}, {_ROUTINES},
b0 AS (SELECT file_id, line, text, {_PLAIN} AS plain, {_WORDS} AS ws, {_SHOWN} AS shown, lower({_trim('text')}) AS whole FROM l),
b AS (SELECT *, {_COUNT.format('end')} AS ends, {_COUNT.format('begin')} AS begins, CASE WHEN whole IN ('interface', 'implementation') THEN whole END AS mark,
  CASE WHEN (list_contains(ws, 'record') AND {_COUNT.format('end')} = 0) OR (list_contains(ws, 'case') AND list_contains(ws[list_position(ws, 'case'):], 'of')) THEN 1 ELSE 0 END - {_COUNT.format('end')} AS step FROM b0),
k AS (SELECT *, sum(step) OVER w AS deep, sum(begins - ends) OVER w AS nest, sum(begins) OVER w AS begun, count(*) OVER (PARTITION BY file_id) AS n FROM b WINDOW w AS (PARTITION BY file_id ORDER BY line)),
h AS (SELECT file_id, line, identifier, 'type' AS chunk_type, regexp_matches(regexp_replace(lower(plain), '^.*=', ''), '^\s*(packed\s+)?(class|record|interface|dispinterface|object)(\s+of\s+{_W}+)?\s*;\s*$') AND contains(plain, '=') AS forward FROM ty JOIN b USING (file_id, line)
  UNION ALL SELECT file_id, line, identifier, 'routine', false FROM ro ANTI JOIN ty USING (file_id, line)),
ts AS (SELECT h.file_id, h.line, min(k.line) + 1 AS stop FROM h JOIN k a USING (file_id, line) JOIN k ON k.file_id = h.file_id AND k.line > h.line AND k.line < h.line + 301 AND k.ends > 0 AND 1 + k.deep - a.deep <= 0 WHERE chunk_type = 'type' GROUP BY ALL),
rs AS (SELECT h.file_id, h.line, min(k.line) FILTER (k.begun - a.begun + a.begins > 0 AND k.nest - a.nest + a.begins - a.ends <= 0) + 1 AS body, min(k.line) FILTER (contains(k.plain, ';')) + 1 AS semi
  FROM h JOIN k a USING (file_id, line) JOIN k ON k.file_id = h.file_id AND k.line >= h.line AND k.line < h.line + 201 WHERE chunk_type = 'routine' GROUP BY ALL),
hs AS (SELECT h.*, a.n, CASE WHEN forward THEN h.line + 1 WHEN chunk_type = 'type' THEN coalesce(ts.stop, least(n, h.line + 301)) ELSE coalesce(least(rs.body, rs.semi), rs.body, rs.semi, least(n, h.line + 201)) END AS stop_i,
  CASE WHEN forward THEN h.line + 1 WHEN chunk_type = 'type' THEN coalesce(ts.stop, least(n, h.line + 301)) ELSE coalesce(rs.body, least(n, h.line + 201)) END AS stop_m FROM h JOIN k a USING (file_id, line) LEFT JOIN ts USING (file_id, line) LEFT JOIN rs USING (file_id, line)),
nx AS (SELECT file_id, line, min(CASE WHEN hs.line IS NOT NULL THEN b.line END) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS head, max(CASE WHEN mark IS NOT NULL THEN line END) OVER w AS marked, last_value(mark IGNORE NULLS) OVER w AS mark
  FROM b LEFT JOIN hs USING (file_id, line) WINDOW w AS (PARTITION BY file_id ORDER BY line)),
hx AS (SELECT nx.file_id, nx.line AS here, hs.line, hs.identifier, hs.chunk_type, hs.forward, hs.stop_i, hs.stop_m, m.marked, m.mark FROM nx JOIN hs ON hs.file_id = nx.file_id AND hs.line = nx.head JOIN nx m ON m.file_id = nx.file_id AND m.line = nx.head),
walk AS (SELECT file_id, 0::BIGINT AS here, 'interface' AS section, NULL::BIGINT AS line, NULL::VARCHAR AS identifier, NULL::VARCHAR AS chunk_type, true AS forward FROM a
  UNION ALL SELECT x.file_id, CASE WHEN coalesce(CASE WHEN x.marked >= x.here THEN x.mark END, w.section) = 'interface' THEN x.stop_i ELSE x.stop_m END, coalesce(CASE WHEN x.marked >= x.here THEN x.mark END, w.section), x.line, x.identifier, x.chunk_type, x.forward FROM walk w JOIN hx x USING (file_id, here)),
w1 AS (SELECT w.file_id, w.section, w.chunk_type, w.identifier, w.line, {_trim("array_to_string(a.l[w.line + 1:w.here], chr(10))")} AS content,
  (SELECT min(CASE shown WHEN 'published' THEN 0 WHEN 'public' THEN 1 WHEN 'protected' THEN 2 ELSE 3 END) FROM b WHERE b.file_id = w.file_id AND b.line >= w.line AND b.line < w.here AND shown IS NOT NULL) AS best FROM walk w JOIN a USING (file_id) WHERE NOT forward),
blocks AS (SELECT *, CASE least(CASE WHEN section = 'implementation' THEN 3 ELSE 1 END, CASE WHEN chunk_type = 'type' THEN coalesce(best, 9) ELSE 9 END) WHEN 0 THEN 'published' WHEN 1 THEN 'public' WHEN 2 THEN 'protected' ELSE 'private' END AS visibility FROM w1
  WHERE length(content) + length(regexp_replace(content, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) >= CASE chunk_type WHEN 'type' THEN 20 ELSE 10 END),
pieces AS (SELECT file_id, library, version, {_UNIT} AS unit_name, file_path, section, chunk_type, identifier, content, line::INTEGER AS start_line, visibility, (row_number() OVER (PARTITION BY file_id ORDER BY line))::INTEGER AS ordinal FROM blocks JOIN source_files USING (file_id))"""

ORACLE = {
    "src_lines": f"WITH {_L} SELECT file_id, len(l) AS lines, len(list_filter(l, lambda x: {_trim('x')} = '')) AS blank FROM a",
    "chunk_header": f"WITH {_L} SELECT file_id, {_UNIT} AS unit_name, array_to_string(l[1:30], chr(10)) AS content FROM a JOIN source_files USING (file_id)",
    "unit_names": f"SELECT file_id, {_UNIT} AS unit_name FROM source_files",
    "strip_line": f"WITH {_L}, s AS (SELECT file_id, sum(length({_PLAIN}))::BIGINT AS left, count(*) FILTER ({_PLAIN} <> text) AS changed FROM l GROUP BY file_id) SELECT file_id, coalesce(s.left, 0) AS left, coalesce(changed, 0) AS changed FROM a LEFT JOIN s USING (file_id)",
    "kw_counts": rf"WITH {_L}, s AS (SELECT file_id, sum(len(regexp_extract_all({_PLAIN}, '(?i)\bbegin\b')))::BIGINT AS begins, sum(len(regexp_extract_all({_PLAIN}, '(?i)\bend\b')))::BIGINT AS ends FROM l GROUP BY file_id) SELECT file_id, coalesce(begins, 0) AS begins, coalesce(ends, 0) AS ends FROM a LEFT JOIN s USING (file_id)",
    "section_track": f"""WITH {_L}, m AS (SELECT file_id, line, lower({_trim('text')}) AS w FROM l),
s AS (SELECT file_id, coalesce(last_value(CASE WHEN w IN ('interface', 'implementation') THEN w END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line), 'interface') AS section FROM m)
SELECT file_id, section, count(*) AS lines FROM s GROUP BY ALL""",
    "type_headers": f"WITH {_L}, {_TYPES} SELECT * FROM ty",
    "routine_headers": f"WITH {_L}, {_ROUTINES} SELECT * FROM ro",
    "visibility_parse": f"WITH {_L}, v AS (SELECT file_id, {_SHOWN} AS visibility FROM l) SELECT file_id, visibility, count(*) AS lines FROM v WHERE visibility IS NOT NULL GROUP BY ALL",
    "str_trim": f"SELECT file_id, length({_trim('source_text')}) AS size FROM source_files WHERE source_text IS NOT NULL",
    "chunk_types": f"{_CHUNKS} SELECT * FROM pieces WHERE chunk_type = 'type'",
    "chunk_routines": f"{_CHUNKS} SELECT * FROM pieces WHERE chunk_type = 'routine'",
    "index_resume": f"""{_CHUNKS}, every AS (SELECT file_id, library, version, file_path, identifier, ordinal FROM pieces UNION ALL SELECT file_id, library, version, file_path, {_UNIT}, 0 FROM source_files WHERE source_text IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY library, version ORDER BY file_path, file_id, ordinal) AS place FROM every), have AS (SELECT library, version, count(*) AS chunks FROM chunks GROUP BY ALL)
SELECT file_id, ordinal, place, library, version, identifier FROM placed LEFT JOIN have USING (library, version) WHERE place > coalesce(chunks, 0)""",
    "lex_kinds": f"WITH {_tokens()} SELECT file_id, kind, count(*) AS tokens, sum(length(text))::BIGINT AS chars FROM t GROUP BY ALL",
    "directive_regions": f"WITH {_tokens()}, {_PLACES}, {_REGIONS} SELECT file_id, directive, condition, start_line, start_column, line AS end_line, col AS end_column, depth::INTEGER AS depth FROM met WHERE step = 1 AND until IS NOT NULL",
    "directive_diagnostics": f"""WITH {_tokens("source_text || CASE file_id % 3 WHEN 1 THEN chr(10) || '{$ENDIF}' WHEN 2 THEN chr(10) || '{$IFDEF OPEN}' ELSE '' END")}, {_PLACES}, {_REGIONS}
SELECT file_id, 'DP2001' AS code, directive, start_line, start_column, end_line, end_column FROM stray UNION ALL SELECT file_id, 'DP2002', directive, start_line, start_column, end_line, end_column FROM met WHERE step = 1 AND until IS NULL""",
    "unit_structure": f"{_STRUCTURE} SELECT * FROM nodes",
    "unit_report": f"""{_STRUCTURE}, r AS (SELECT file_id, nullif(max(name) FILTER (kind = 'unit'), '<unknown-unit>') AS unit_name, count(*) AS nodes, count(*) FILTER (ends_with(kind, '_section')) AS sections, count(*) FILTER (kind = 'uses') AS uses, count(*) FILTER ({_TYPE_NODES}) AS types FROM nodes GROUP BY file_id)
SELECT *, types + (unit_name IS NOT NULL)::BIGINT AS symbols, least(nodes, 5000) AS returned_nodes, least(types + (unit_name IS NOT NULL)::BIGINT, 2000) AS returned_symbols, nodes > 5000 OR types + (unit_name IS NOT NULL)::BIGINT > 2000 AS truncated, CASE WHEN unit_name IS NULL THEN 'DP3001' END AS code FROM r""",
    "symbol_signature": f"""{_STRUCTURE}, u AS (SELECT file_id, nullif(name, '<unknown-unit>') AS unit_name FROM nodes WHERE kind = 'unit')
SELECT file_id, unit_name, unit_name AS name, 'unit' AS kind, 'unit ' || unit_name || ';' AS signature, NULL AS visibility, NULL AS declaring_type, 0 AS start_line, 0 AS start_column, 0 AS end_line, 0 AS end_column FROM u WHERE unit_name IS NOT NULL
UNION ALL SELECT file_id, unit_name, name, replace(kind, '_type', ''), name || ' = ' || replace(kind, '_type', '') || ';', NULL, NULL, start_line, start_column, end_line, end_column FROM nodes JOIN u USING (file_id) WHERE {_TYPE_NODES}""",
    "uses_units": f"""{_STRUCTURE}, o AS (SELECT n.file_id, s.name AS section, n.name AS unit, substr(n.id, 2)::INTEGER AS pos FROM nodes n JOIN nodes s ON s.file_id = n.file_id AND s.id = n.parent_id WHERE n.kind = 'uses')
SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY file_id, section, lower(unit) ORDER BY pos) = 1""",
    "parse_result": f"""{_STRUCTURE}, m AS (SELECT *, substr(id, 2)::INTEGER AS n FROM nodes), u AS (SELECT file_id, nullif(name, '<unknown-unit>') AS unit_name FROM nodes WHERE kind = 'unit'),
y2 AS (SELECT file_id, 0 AS n, 'unit ' || unit_name || ';' AS sig FROM u WHERE unit_name IS NOT NULL UNION ALL SELECT file_id, n, name || ' = ' || replace(kind, '_type', '') || ';' FROM m WHERE {_TYPE_NODES}),
a2 AS (SELECT file_id, string_agg(sig, '|' ORDER BY n) FILTER (r <= 3) AS symbols, count(*) > 3 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n) AS r FROM y2) GROUP BY file_id)
SELECT file_id, unit_name, string_agg(id || ' ' || coalesce(parent_id, '-') || ' ' || kind || ' ' || name, '|' ORDER BY n) FILTER (n <= 12) AS nodes, coalesce(any_value(symbols), '') AS symbols,
  CASE WHEN unit_name IS NULL THEN 'DP3001' ELSE '' END AS codes, count(*) > 12 AS nodes_truncated, coalesce(any_value(cut), false) AS symbols_truncated FROM m JOIN u USING (file_id) LEFT JOIN a2 USING (file_id) GROUP BY file_id, unit_name""",
    "normal_form": _NORMAL,
}
