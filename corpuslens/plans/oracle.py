"""SQL with the same result as the registered queries, for an independent check.

The statements read the given tables by name. Derived views are written out as common table
expressions; where a view is built by rule, the expected rows follow from the rule directly.
"""

from __future__ import annotations

from corpuslens.plans.views import EXTENSIONS
from corpuslens.registry import KINDS

LF = "chr(10)"
WS = r"\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _trim(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[\\n{WS}]+', ''), '[\\n{WS}]+$', '')"


def _cut(text: str) -> str:
    return (
        f"CASE WHEN length({text}) <= 5000 THEN {text} "
        f"ELSE substr({text}, 1, 5000) || {LF} || '…' END"
    )


ORACLE_SQL: dict[str, str] = {}

# -- detection -------------------------------------------------------------------------------

_LISTING = f"""
named AS (SELECT *, {_list(EXTENSIONS)}[1 + doc_id % {len(EXTENSIONS)}] AS ext FROM documents),
listing AS (
  SELECT doc_id AS id, source AS tree_id, doc_id AS seq,
    lang || '/b' || (doc_id % 7) || CASE WHEN doc_id % 5 = 0 THEN '/deep/er' ELSE '' END
    || CASE WHEN doc_id % 53 = 11 THEN '/__MACOSX' ELSE '' END || '/'
    || CASE WHEN doc_id % 29 = 3 THEN 'Sub' || doc_id ELSE
         CASE WHEN doc_id % 37 = 5 THEN '.' ELSE '' END
         || CASE WHEN doc_id % 41 = 7 THEN '._' ELSE '' END || 'doc' || doc_id
         || CASE WHEN ext <> '' THEN '.' || ext ELSE '' END END AS path,
    doc_id % 29 = 3 AS is_dir,
    CASE WHEN doc_id % 29 <> 3 THEN n_chars END AS size,
    CASE WHEN doc_id % 29 = 3 THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END AS mode,
    CASE WHEN doc_id % 29 = 3 OR ext = '' THEN NULL
         WHEN ext = 'tar.gz' THEN 'gz' ELSE lower(ext) END AS low,
    text, lang, source
  FROM named)"""

_KINDS = """
ext_kind(low, kind) AS (VALUES ('md', 'markdown'), ('html', 'code'), ('py', 'code'),
  ('json', 'data'), ('csv', 'data'), ('ini', 'data'), ('eml', 'email'), ('ipynb', 'notebook'),
  ('pdf', 'pdf'), ('gz', 'archive'), ('xls', 'spreadsheet'), ('svg', 'code'),
  ('doc', 'legacy_office'), ('fb2', 'ebook'), ('opf', 'ebook'), ('tsv', 'data'),
  ('yaml', 'data'), ('png', 'image'), ('mp3', 'media'), ('rtf', 'document'),
  ('docx', 'document'), ('zip', 'archive'), ('xml', 'code'), ('sqlite', 'database'),
  ('ttf', 'font'), ('cbz', 'ebook'), ('7z', 'archive'), ('plist', 'plist')),
known AS (
  SELECT listing.*, CASE WHEN is_dir THEN 'directory' WHEN kind IS NOT NULL THEN kind
    WHEN low IS NULL AND id % 64 = 11 THEN 'image' WHEN low IS NULL THEN 'pdf' END AS kind
  FROM listing LEFT JOIN ext_kind USING (low))"""

_RULED = """
CASE WHEN is_dir THEN NULL WHEN low = 'nb9' THEN 'notes9' WHEN low = 'zzz' THEN 'zeta'
     WHEN low IS NULL AND id % 64 = 11 THEN 'gifs' END"""

ORACLE_SQL["ext_of"] = f"WITH {_LISTING} SELECT id, low AS ext FROM listing"
ORACLE_SQL["kind_by_ext"] = (
    f"WITH {_LISTING}, {_KINDS} SELECT id, path, e.kind FROM listing LEFT JOIN ext_kind e USING (low)"
)
ORACLE_SQL["detect_kind"] = (
    f"WITH {_LISTING}, {_KINDS} SELECT id, coalesce(kind, {_RULED}, 'fallback') AS kind FROM known"
)
ORACLE_SQL["detect_kind_strict"] = f"WITH {_LISTING}, {_KINDS} SELECT id, kind FROM known"
ORACLE_SQL["kind_by_rules"] = f"WITH {_LISTING} SELECT id, {_RULED} AS kind FROM listing"

ORACLE_SQL["kind_by_rules_table"] = f"""
WITH {_LISTING},
rules AS (SELECT 'r' || lpad(doc_id::VARCHAR, 9, '0') AS name, doc_id AS n, lower(ext) AS e FROM named
  WHERE doc_id % 101 <> 7),
by_ext AS (SELECT e, min(name) AS x FROM rules WHERE n % 11 = 3 GROUP BY e),
found AS (SELECT id, CASE WHEN is_dir THEN NULL WHEN low IS NULL AND id % 64 = 11 THEN 'gif'
    WHEN low IS NULL OR (low = 'pdf' AND id % 64 = 9) THEN 'pdf' END AS m, low FROM listing)
SELECT id, CASE WHEN x IS NULL OR y < x THEN y ELSE x END AS rule_kind FROM (
  SELECT id, x, CASE m WHEN 'gif' THEN (SELECT min(name) FROM rules WHERE n % 97 IN (50, 53))
    WHEN 'pdf' THEN (SELECT min(name) FROM rules WHERE n % 97 = 51) END AS y
  FROM found LEFT JOIN by_ext ON low = e)"""

# The formats whose leading bytes the view puts before the texts, in its order.
_FORMATS = """
  image/png image/jpeg image/gif image/webp image/bmp image/tiff image/tiff image/vnd.microsoft.icon
  image/heif image/heif image/vnd.djvu application/pdf application/x-mobipocket-ebook
  application/epub+zip application/zip application/zip application/gzip application/x-bzip2
  application/x-xz application/x-7z-compressed application/x-tar application/vnd.sqlite3 audio/mpeg
  audio/mpeg audio/x-wav audio/x-flac audio/ogg audio/x-aiff audio/m4a video/quicktime video/mp4
  video/x-matroska video/x-msvideo application/font-woff application/font-woff application/font-sfnt
  application/font-sfnt
""".split()
_MIMES = (
    f"mimes AS (SELECT doc_id AS id, {_list(_FORMATS)}"
    f"[1 + doc_id % {len(_FORMATS) + 1}] AS mime FROM documents)"
)
_PATTERNS = ", ".join(f"('{k.name}', '{m}')" for k in KINDS for m in k.mime)
ORACLE_SQL["sniff_mime"] = f"WITH {_MIMES} SELECT id, mime FROM mimes"
ORACLE_SQL["mime_matches"] = f"""
WITH {_MIMES}, patterns(kind, pattern) AS (VALUES {_PATTERNS})
SELECT id, mime, kind, pattern FROM mimes JOIN patterns
  ON mime = pattern OR (pattern LIKE '%*' AND starts_with(mime, rtrim(pattern, '*')))"""

_REGISTRY = ", ".join(
    f"('{k.name}', {i}, '{', '.join(k.extensions)}', {len(k.mime)}, {int(k.name == 'markdown')})"
    for i, k in enumerate(KINDS, start=1)
)
ORACLE_SQL["registry_report"] = f"""
WITH {_LISTING}, {_KINDS},
registry(kind, priority, extensions, n_patterns, n_rules) AS (VALUES {_REGISTRY},
  ('gifs', {len(KINDS) + 1}, '', 1, 1), ('notes9', {len(KINDS) + 2}, 'NB9', 0, 1),
  ('zeta', {len(KINDS) + 3}, 'zzz, nb9', 1, 1)),
counts AS (SELECT coalesce(kind, {_RULED}, 'fallback') AS kind, count(*) AS n FROM known GROUP BY 1)
SELECT kind, priority, extensions, n_patterns, n_rules, coalesce(n, 0) AS n_files,
  n IS NOT NULL AS in_use FROM registry LEFT JOIN counts USING (kind)"""

_ASCII = r"regexp_full_match({0}, '[\x21-\x7E \t\n\f\r]*')"
ORACLE_SQL["text_or_hex"] = (
    f"SELECT doc_id AS id, CASE WHEN {_ASCII.format('text')} THEN 'text' ELSE 'hex' END AS form "
    "FROM documents"
)

# -- text ------------------------------------------------------------------------------------


def _strip(html: str) -> str:
    return f"replace(regexp_replace({html}, '<[^>]*(>|\\z)', '', 'g'), '>', '')"


def _html_text(html: str) -> str:
    out = html
    for markup in ("<mbp:pagebreak/>", "<mbp:pagebreak />", "<mbp:pagebreak>"):
        out = f"replace({out}, '{markup}', {LF} || {LF})"
    for markup in ("</p>", "</div>", "</h1>", "</h2>", "</h3>"):
        out = f"replace({out}, '{markup}', '{markup}' || {LF})"
    for markup in ("<br>", "<br/>", "<br />"):
        out = f"replace({out}, '{markup}', {LF})"
    for markup in ("<p", "<P"):
        out = f"replace({out}, '>{markup}', '>' || {LF} || '{markup}')"
    out = f"regexp_replace({_strip(out)}, '[{WS}]+', ' ', 'g')"
    out = f"regexp_replace({out}, '(^|\\n) ', '\\1', 'g')"
    return f"regexp_replace({out}, '[\\n{WS}]+\\z', '')"


ORACLE_SQL["strip_tags"] = f"SELECT page_id AS id, {_strip('html')} AS text FROM pages"
ORACLE_SQL["html_to_text"] = f"SELECT page_id AS id, {_html_text('html')} AS text FROM pages"
ORACLE_SQL["truncate_chars"] = f"SELECT doc_id AS id, {_cut('text')} AS text FROM documents"

_LINES = f"""
lines AS (SELECT doc_id AS id, n AS line_no, v AS line
  FROM documents, unnest(string_split(text, {LF})) WITH ORDINALITY u(v, n))"""
_PAGES = f"""
paged AS (SELECT id, (line_no - 1) // 3 + 1 AS page_no,
  string_agg(line, {LF} ORDER BY line_no) AS text FROM lines GROUP BY ALL)"""
ORACLE_SQL["split_pages"] = f"WITH {_LINES}, {_PAGES} SELECT id, page_no, text FROM paged"
ORACLE_SQL["join_pages"] = f"""
WITH {_LINES}, {_PAGES}
SELECT id, string_agg(CASE WHEN page_no > 1 THEN
  {LF} || '--- page ' || page_no || ' ---' || {LF} || {LF} ELSE '' END || text, ''
  ORDER BY page_no) || {LF} AS text FROM paged GROUP BY id"""

_BARE = r"regexp_replace({0}, '(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>', '<>', 'g')"


def _nodes(xml: str) -> str:
    found = f"regexp_extract_all({_BARE.format(xml)}, '(?:^|>)([^<]+)', 1)"
    kept = f"list_filter(list_transform({found}, lambda x: {_trim('x')}), lambda x: x <> '')"
    return f"array_to_string(list_transform({kept}, lambda x: x || {LF}), '')"


ORACLE_SQL["xml_text_nodes"] = f"SELECT page_id AS id, {_nodes('html')} AS text FROM pages"

ORACLE_SQL["notebook_cells"] = f"""
WITH t AS (SELECT conv_id || '-' || turn AS id, conv_id + turn AS n, role, text,
  to_json(text)::VARCHAR AS one, to_json(string_split(text, {LF}))::VARCHAR AS listed
  FROM conversations)
SELECT id, NULL::BIGINT AS cell_no, NULL AS cell_type, '{{not json ' || text AS text,
  'invalid json' AS error FROM t WHERE n % 7 = 6
UNION ALL SELECT id, 1, role, '## Cell 1 (' || role || ')' || {LF} || {LF} ||
  CASE WHEN n % 2 = 0 THEN text ELSE replace(text, {LF}, '') END, NULL FROM t WHERE n % 7 <> 6
UNION ALL SELECT id, 2, 'cell', '## Cell 2 (cell)' || {LF} || {LF} || 'end', NULL
  FROM t WHERE n % 7 <> 6"""

ORACLE_SQL["join_slides"] = f"""
WITH j AS (SELECT conv_id, string_agg(text, {LF} || {LF} || '---' || {LF} || {LF} ORDER BY turn) AS t
  FROM conversations GROUP BY 1)
SELECT conv_id, t AS text FROM j"""
ORACLE_SQL["join_slides_titled"] = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
j AS (SELECT conv_id, string_agg(CASE WHEN k > 1 THEN {LF} || '--- slide ' || k || ' ---' || {LF}
  || {LF} ELSE '' END || text, '' ORDER BY turn) || {LF} AS t FROM r GROUP BY 1)
SELECT conv_id, t AS text FROM j"""

_RUNS = (
    r"trim(regexp_replace(array_to_string(regexp_extract_all(text, '[\x20-\x7e\n\t]{4,}'), ' '), "
    r"'[ \n\t]+', ' ', 'g'))"
)
ORACLE_SQL["printable_runs"] = f"""
WITH r AS (SELECT doc_id AS id, {_RUNS} AS runs FROM documents)
SELECT id, runs, CASE WHEN length(runs) >= 20 THEN runs || {LF} END AS legacy FROM r"""

_MAIL = r"""
mail AS (SELECT conv_id || '-' || turn AS id, role || '@example.org' AS sender,
  'conv' || conv_id AS recipient,
  CASE WHEN (conv_id + turn) % 2 = 0 THEN 'tür à n° ' || turn ELSE 'turn ' || turn END AS subject,
  CASE (conv_id + turn) % 9 WHEN 6 THEN '€ café ' || regexp_replace(replace(text, chr(10), chr(13) || chr(10)),
      '[^\x00-\x7F]|=', '?', 'g')
    WHEN 7 THEN 'über ' WHEN 8 THEN NULL ELSE text END AS body,
  CASE WHEN (conv_id + turn) % 9 = 8 THEN 'no text part' END AS error FROM conversations)"""
ORACLE_SQL["email_fields"] = f"WITH {_MAIL} SELECT * FROM mail"
ORACLE_SQL["email_text"] = f"""
WITH {_MAIL} SELECT id, 'From: ' || sender || {LF} || 'To: ' || recipient || {LF} || 'Subject: '
  || subject || {LF} || {LF} || coalesce(body, '') AS text FROM mail"""

ORACLE_SQL["number_lines"] = (
    f"WITH {_LINES} SELECT id, line_no, line AS text, "
    "lpad(line_no::VARCHAR, greatest(4, length(line_no::VARCHAR))::INTEGER, ' ') || '| ' || line AS rendered "
    "FROM lines"
)
ORACLE_SQL["sanitize"] = (
    f"SELECT doc_id AS id, replace(replace(text, ' ', ' ' || chr(9)), {LF}, '') AS text FROM documents"
)


def _wrapped(lines: str, width: int) -> str:
    return f"""
pieces AS (SELECT id, line_no, k AS piece_no, substr(line, (k - 1) * {width} + 1, {width}) AS text
  FROM (SELECT id, line_no, line, unnest(range(1, greatest(1, (length(line) + {width - 1}) // {width}) + 1)) AS k
        FROM {lines})),
visual AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY line_no, piece_no) AS row_no,
  line_no, piece_no, text FROM pieces)"""


ORACLE_SQL["wrap_lines"] = f"""
WITH tabbed AS (SELECT doc_id AS id, n AS line_no, list_reduce(string_split(v, chr(9)),
    lambda a, b: rpad(a, ((length(a) // 8) + 1)::INTEGER * 8, ' ') || b) AS line
  FROM documents, unnest(string_split(replace(text, ', ', ',' || chr(9)) || {LF}, {LF}))
    WITH ORDINALITY u(v, n)), {_wrapped('tabbed', 40)}
SELECT * FROM visual"""
ORACLE_SQL["paginate"] = f"""
WITH {_LINES}, {_wrapped('lines', 80)}
SELECT id, row_no, text, (row_no - 1) // 23 + 1 AS page_no FROM visual"""
ORACLE_SQL["page_counts"] = f"""
WITH {_LINES}, {_wrapped('lines', 80)}
SELECT id, count(*) AS n_lines, max((row_no - 1) // 23 + 1) AS n_pages FROM visual GROUP BY id"""

# A cursor that goes through the characters; chr(1) stands for a wide one's second column.
_LAST = "string_split(a, chr(10))[-1]"
_WIDE = f"""
wide AS (SELECT doc_id AS id, n AS line_no, list_transform(regexp_extract_all(replace(v, chr(769), ''), '(?s).'),
    lambda c: CASE WHEN c IN ('漢', 'Ａ', '🙂') THEN c || chr(1) ELSE c END) AS chars,
    v <> '' AND replace(v, chr(769), '') = '' AS gone
  FROM documents, unnest(string_split(replace(translate(text, 'wvkc', '漢Ａ' || chr(769) || '🙂'),
    ', ', ',' || chr(9)), {LF})) WITH ORDINALITY u(v, n)),
walked AS (SELECT id, line_no, list_reduce(list_prepend('', chars), lambda a, c: CASE
    WHEN c <> chr(9) AND {_LAST} <> '' AND length({_LAST}) + length(c) > 30 THEN a || {LF} || c
    WHEN c <> chr(9) THEN a || c
    WHEN length({_LAST}) + 8 - length({_LAST}) % 8 <= 30 THEN a || repeat(' ', 8 - length({_LAST}) % 8)
    ELSE a || repeat(' ', 30 - length({_LAST})) || {LF}
      || repeat(' ', 8 - length({_LAST}) % 8 - 30 + length({_LAST})) END) AS t FROM wide WHERE NOT gone),
visual AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY line_no, k) AS row_no, line_no, k AS piece_no,
  replace(p, chr(1), '') AS text FROM walked, unnest(string_split(t, {LF})) WITH ORDINALITY u(p, k))"""
ORACLE_SQL["wrap_lines_wide"] = f"WITH {_WIDE} SELECT * FROM visual"
ORACLE_SQL["page_counts_wide"] = f"""
WITH {_WIDE} SELECT id, count(*) AS n_lines, max((row_no - 1) // 20 + 1) AS n_pages FROM visual GROUP BY id"""


def _hex_lines(source: str) -> str:
    """Rows of the hex dump of ``content`` (text) of ``source (id, content)``."""
    return f"""
bytes AS (SELECT id, lower(substr(hex(encode(content)), 1, 131072)) AS h FROM {source}),
chunks AS (SELECT id, o, substr(h, o * 2 + 1, 32) AS c
  FROM (SELECT id, h, unnest(range(0, length(h) // 2, 16)) AS o FROM bytes)),
pairs AS (SELECT id, o, [c[i * 2 + 1 : i * 2 + 2] for i in range(0, length(c) // 2)] AS p FROM chunks),
hexed AS (SELECT id, o AS offset_no, lpad(lower(to_hex(o)), 8, '0') || '  '
  || rpad(array_to_string(p, ' '), 47, ' ') || '  |'
  || array_to_string([CASE WHEN b BETWEEN '20' AND '7e' THEN chr(('0x' || b)::INTEGER) ELSE '.' END
       for b in p], '') || '|' AS line FROM pairs)"""


ORACLE_SQL["hex_dump"] = f"""
WITH src AS (SELECT doc_id AS id, text AS content FROM documents), {_hex_lines('src')}
SELECT id, offset_no AS "offset", line FROM hexed"""

ORACLE_SQL["json_canonical"] = """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '{' || props ELSE replace(props, ': ', ':') END AS text,
  CASE WHEN event_id % 4 = 3 THEN 'invalid json' END AS error FROM events"""
ORACLE_SQL["first_success"] = r"""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '{' || props
    ELSE regexp_extract(props, '(\d+)', 1) END AS text,
  CASE WHEN event_id % 4 = 3 THEN 'no candidate gave output' END AS error FROM events"""

_PLAIN = f"""
plain AS (SELECT doc_id AS id, list_filter(list_transform(string_split(text, {LF}), lambda l:
  trim(regexp_replace(regexp_replace(l, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g'))),
  lambda l: l <> '') AS l FROM documents),
each AS (SELECT id, len(l) AS m, len(l) + (len(l) + 1) // 3 AS b,
  unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM plain)"""

_INI = f"""{_PLAIN},
entries AS (SELECT id, 's' || ((i - i % 4) % 3) AS section, 'k' || (i % 5) AS key,
  arg_max(CASE WHEN i % 6 = 5 THEN '' ELSE line END, i) AS value FROM each GROUP BY ALL
  UNION ALL SELECT doc_id, '', 'top', '1' FROM documents)"""
ORACLE_SQL["ini_rows"] = f"WITH {_INI} SELECT id, section, key, value FROM entries"
ORACLE_SQL["ini_text"] = f"""
WITH {_INI}, s AS (SELECT id, section, CASE WHEN section <> '' THEN '[' || section || ']' || {LF}
  ELSE '' END || string_agg(key || ' = ' || value || {LF}, '' ORDER BY key) || {LF} AS t
  FROM entries GROUP BY id, section)
SELECT id, string_agg(t, '' ORDER BY section) AS text FROM s GROUP BY id"""

# -- markdown --------------------------------------------------------------------------------

def _joined(item: str) -> str:
    return f"array_to_string(list_transform(l, lambda x, j: {item}), '')"


_MD_DOC = f"""{_PLAIN},
md AS (SELECT id, '# Doc **' || id || '** `a*b*`' || {LF} || {LF}
  || {_joined(f"'- ' || x || {LF} || CASE WHEN (j - 1) % 3 = 1 THEN '  - *in* _it_' || {LF} ELSE '' END")}
  || {LF} || {_joined(f"((j - 1) * 2 + 5) || '. ' || x || {LF}")}
  || {LF} || '```sql' || {LF} || '# not a heading' || {LF} || {_joined(f"x || {LF}")}
  || '```' || {LF} || {LF} || '| line | size |' || {LF} || '| :--- | ---: |' || {LF}
  || {_joined(f"'| ' || x || CASE WHEN (j - 1) % 4 = 2 THEN '' ELSE ' | ' || length(x) END || ' |' || {LF}")}
  || {LF} || '## [End](http://example.org/' || id || ') ![alt](p.png)' || {LF} || {LF}
  || '~~~' || {LF} || ' ' || {LF} || '~~~' || {LF} AS text FROM plain)"""
ORACLE_SQL["md_lines"] = f"""
WITH {_MD_DOC},
rows AS (SELECT id, n AS line_no, v AS text, regexp_matches(v, '^(```|~~~)') AS mark
  FROM md, unnest(string_split(text, {LF})) WITH ORDINALITY u(v, n)),
counted AS (SELECT *, sum(mark::INTEGER) OVER (PARTITION BY id ORDER BY line_no) AS c FROM rows),
flagged AS (SELECT id, line_no, text, mark OR c % 2 = 1 AS in_fence,
  CASE WHEN mark OR c % 2 = 1 THEN (c + 1) // 2 END::BIGINT AS fence_no FROM counted)
SELECT *, CASE WHEN fence_no = 1 THEN 'sql' WHEN fence_no = 2 THEN '' END AS lang FROM flagged"""
_SIZES = "sizes AS (SELECT id, len(l) AS m, len(l) + (len(l) + 1) // 3 AS b, l FROM plain)"
ORACLE_SQL["md_headings"] = f"""
WITH {_PLAIN}, {_SIZES}
SELECT id, 1 AS line_no, 1 AS level, 'Doc ' || id || ' `a*b*`' AS text FROM sizes
UNION ALL SELECT id, 12 + b + 3 * m, 2, 'End [image: alt]' FROM sizes"""
ORACLE_SQL["md_code_blocks"] = f"""
WITH {_PLAIN} SELECT id, 1 AS block_no, 'sql' AS lang,
  array_to_string(list_concat(['# not a heading'], l), {LF}) AS code FROM plain"""
ORACLE_SQL["md_headings_nested"] = f"""
WITH {_PLAIN}
SELECT id, 1 + 10 * (i // 4) + [0, 3, 5][1 + i % 4] AS line_no, [1, 2, 2][1 + i % 4] AS level, line AS text
FROM each WHERE i % 4 < 3"""
ORACLE_SQL["md_code_indented"] = f"""
WITH {_PLAIN}
SELECT id, 1 + i // 4 AS block_no, '' AS lang, '  ' || line AS code FROM each WHERE i % 4 = 3"""
ORACLE_SQL["md_tables"] = f"""
WITH {_PLAIN}, {_SIZES}
SELECT id, 1 AS table_no, 9 + b + 2 * m AS line_no, 'line|size' AS headers, 'left|right' AS aligns,
  array_to_string(list_transform(l, lambda x, j: x || '|' || CASE WHEN (j - 1) % 4 = 2 THEN ''
    ELSE length(x)::VARCHAR END)[1:1000], {LF}) AS rows, greatest(m - 1000, 0) AS more_rows FROM sizes"""
ORACLE_SQL["md_lists"] = f"""
WITH {_PLAIN}
SELECT id, 1 AS list_no, 3 + i + (i + 1) // 3 AS line_no, 0 AS depth, false AS ordered,
  NULL::BIGINT AS number, line AS text, '• ' || line AS rendered FROM each
UNION ALL SELECT id, 1, 4 + i + (i + 1) // 3, 1, false, NULL, 'in it', '  • in it' FROM each
  WHERE i % 3 = 1
UNION ALL SELECT id, 2, 4 + b + i, 0, true, 5 + i, line, (5 + i) || '. ' || line FROM each"""
ORACLE_SQL["md_reference_links"] = f"""
WITH {_PLAIN}
SELECT id, i + 1 AS line_no, CASE WHEN i % 5 = 4 THEN '[' || line || '][No4]' ELSE line END
  || ' [image: Two pic] No  1 no3 `[no3]`' AS text FROM each"""
ORACLE_SQL["md_inline_text"] = f"""
WITH {_PLAIN}
SELECT id, i AS line_no, CASE i % 6 WHEN 0 THEN line || ' x' WHEN 1 THEN 'a ' || line || ' b'
  WHEN 2 THEN '`**' || line || '**` c' WHEN 3 THEN line || ' https://e.org/x'
  WHEN 4 THEN '[image: title ' || line || '] [image: image]'
  ELSE line || ' snake_case_word *' END AS text FROM each"""

# -- tables ----------------------------------------------------------------------------------

ORACLE_SQL["head_rows"] = """
SELECT * FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate LIMIT 500"""
ORACLE_SQL["cap_columns"] = (
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem"
)


def _number(column: str) -> str:
    return f"regexp_replace({column}::VARCHAR, '\\.0$', '')"


ORACLE_SQL["stringify"] = f"""
SELECT o_orderkey::VARCHAR AS o_orderkey, {_number('o_totalprice')} AS o_totalprice,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE 'NULL' END AS status,
  '<blob ' || strlen(o_orderpriority) || ' bytes>' AS blob FROM orders"""

ORACLE_SQL["sheet_preview"] = f"""
SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
  {_number('o_totalprice')} AS o_totalprice, o_orderdate::VARCHAR AS o_orderdate, o_orderpriority
FROM orders ORDER BY orders.o_orderkey LIMIT 499"""

_TABLES = (
    "benchmark conversations customer documents embeddings events labels lineitem nation orders "
    "pages part region supplier"
).split()
_TYPES = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  WHEN 'FLOAT[]' THEN 'array<float>' ELSE column_type END"""
ORACLE_SQL["schema_report"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, row_number() OVER () AS ordinal, column_name, {_TYPES} AS type, "
    f"(SELECT count(*) FROM {t}) AS n_rows FROM (DESCRIBE {t})"
    for t in _TABLES
)
ORACLE_SQL["pad_cells"] = f"""
WITH c AS (SELECT doc_id AS id, string_split(text, {LF}) AS l FROM documents)
SELECT id, coalesce(l[1], '') || '|' || coalesce(l[2], '') || '|' || coalesce(l[3], '') || '|'
  || coalesce(l[4], '') AS cells FROM c"""
ORACLE_SQL["tsv_lines"] = f"""
SELECT 0 AS part, NULL::BIGINT AS c_custkey,
  array_to_string(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'], chr(9)) AS line
UNION ALL SELECT 1, c_custkey, c_custkey || chr(9) || c_name || chr(9) || c_nationkey || chr(9)
  || {_number('c_acctbal')} || chr(9) || CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE '' END
FROM customer"""
ORACLE_SQL["head_per_group"] = """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no,
  greatest(count(*) OVER (PARTITION BY o_custkey) - 3, 0) AS more_rows FROM orders)
SELECT *, CASE WHEN more_rows > 0 THEN '… ' || more_rows || ' more row(s)' END AS note
FROM r WHERE row_no <= 3"""
ORACLE_SQL["catalog_preview"] = f"""
WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation),
s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier),
p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS k FROM part)
SELECT 'lens_nation' AS table_name, 'n_nationkey, n_name, n_regionkey' AS columns, k AS row_no,
  n_nationkey || '|' || n_name || '|' || n_regionkey AS cells FROM n WHERE k <= 50
UNION ALL SELECT 'lens_supplier', 's_suppkey, s_name, s_nationkey, s_acctbal', k,
  s_suppkey || '|' || s_name || '|' || s_nationkey || '|' || {_number('s_acctbal')} FROM s WHERE k <= 50
UNION ALL SELECT 'lens_part', 'p_partkey, p_name, p_brand, p_type, p_size, p_retailprice', k,
  p_partkey || '|' || p_name || '|' || p_brand || '|' || p_type || '|' || p_size || '|'
  || {_number('p_retailprice')} FROM p WHERE k <= 50"""

# -- trees -----------------------------------------------------------------------------------

_CLEAN = r"""
clean AS (SELECT * FROM listing WHERE NOT (
  starts_with(split_part(path, '/', -1), '._') OR split_part(path, '/', -1) IN ('.DS_Store', 'PaxHeader')
  OR regexp_matches(path, '(^|/)(__MACOSX|PaxHeader)/')))"""


def _nodes_sql(source: str) -> str:
    return f"""
capped AS (SELECT *, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM (
  SELECT * FROM {source})),
touch AS (SELECT tree_id, seq, size, mode, is_dir, parts, unnest(range(1, len(parts) + 1)) AS depth FROM capped),
nodes AS (SELECT tree_id, array_to_string(parts[1:depth], '/') AS path,
  array_to_string(parts[1:depth - 1], '/') AS parent, parts[depth] AS name, depth::INTEGER AS depth,
  arg_max(depth < len(parts) OR is_dir, seq) AS is_dir,
  arg_max(size, seq) FILTER (depth = len(parts) AND size IS NOT NULL) AS size,
  arg_max(mode, seq) FILTER (depth = len(parts) AND mode IS NOT NULL) AS mode, min(seq) AS seq
  FROM touch GROUP BY ALL)"""


_URLS = r"""
urls AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS tree_id, page_id AS seq, p AS path,
  suffix(p, '/') AS is_dir, length(html) AS size, NULL::VARCHAR AS mode
  FROM (SELECT *, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS p FROM pages))"""
# Place among siblings, then keys of all ancestors in order.
_ORDERED = """
ranked AS (SELECT *, row_number() OVER w AS r, lead(path) OVER w IS NULL AS last FROM nodes
  WINDOW w AS (PARTITION BY tree_id, parent ORDER BY NOT is_dir, lower(name), seq)),
chained AS (SELECT n.tree_id, n.path, list(a.r ORDER BY a.depth) AS k,
  list(a.last ORDER BY a.depth) AS lasts
  FROM ranked n JOIN ranked a ON n.tree_id = a.tree_id
    AND (n.path = a.path OR starts_with(n.path, a.path || '/')) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY k) AS pos FROM chained)"""


def _rendered(icons: bool) -> str:
    icon = "CASE WHEN is_dir THEN '📁 ' ELSE '📄 ' END" if icons else "''"
    return f"""
SELECT tree_id, pos, path, '    ' || array_to_string(list_transform(lasts[1:-2], lambda x:
  CASE WHEN x THEN '    ' ELSE '│   ' END), '') || CASE WHEN lasts[-1] THEN '└── ' ELSE '├── ' END
  || {icon} || name || coalesce(' (' || size || ' B)', '') || coalesce(' ' || mode, '') AS line
FROM placed JOIN nodes USING (tree_id, path)"""


_NODE_COLUMNS = "tree_id, path, parent, name, depth, is_dir, size, mode, seq"
_DOC_NODES = f"{_LISTING}, {_CLEAN}, {_nodes_sql('clean')}"
ORACLE_SQL["drop_noise"] = (
    f"WITH {_LISTING}, {_CLEAN} SELECT tree_id, seq, path, is_dir, size, mode FROM clean"
)
ORACLE_SQL["build_nodes"] = f"WITH {_DOC_NODES} SELECT {_NODE_COLUMNS} FROM nodes"
ORACLE_SQL["build_nodes_urls"] = f"WITH {_URLS}, {_nodes_sql('urls')} SELECT {_NODE_COLUMNS} FROM nodes"
ORACLE_SQL["count_nodes"] = (
    f"WITH {_DOC_NODES} SELECT tree_id, count(*) + 1 AS n_nodes FROM nodes GROUP BY 1"
)
ORACLE_SQL["preorder"] = f"WITH {_DOC_NODES}, {_ORDERED} SELECT tree_id, path, pos FROM placed"
ORACLE_SQL["render_tree"] = f"WITH {_DOC_NODES}, {_ORDERED} {_rendered(False)}"
ORACLE_SQL["render_tree_urls"] = f"WITH {_URLS}, {_nodes_sql('urls')}, {_ORDERED} {_rendered(True)}"
ORACLE_SQL["list_limit"] = f"""
WITH {_LISTING},
levels AS (SELECT tree_id, is_dir, size, parts, unnest(range(1, least(len(parts), 4) + 1)) AS d
  FROM (SELECT *, string_split(path, '/') AS parts FROM listing)),
kept AS (SELECT tree_id, parts[1:d] AS p, bool_or(d < len(parts) OR is_dir) AS is_dir,
  max(CASE WHEN d = len(parts) THEN size END) AS size FROM levels
  WHERE len(list_filter(parts[1:d], lambda x: starts_with(x, '.'))) = 0 GROUP BY ALL),
keyed AS (SELECT *, list_transform(p, lambda x, i: CASE WHEN i < len(p) OR is_dir THEN '0' ELSE '1' END || x) AS k
  FROM kept),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY k) AS seq FROM keyed)
SELECT tree_id, seq, array_to_string(p, '/') AS path, is_dir, CASE WHEN NOT is_dir THEN size END AS size,
  CASE WHEN is_dir THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END AS mode FROM placed WHERE seq <= 500"""
ORACLE_SQL["mode_string"] = """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'l' ELSE '-' END
  || array_to_string(list_transform(range(0, 9), lambda i:
    CASE WHEN (o_orderkey % 512) >> (8 - i)::INTEGER & 1 = 1 THEN 'rwx'[i % 3 + 1] ELSE '-' END), '') AS mode
FROM orders"""

# -- corpus ----------------------------------------------------------------------------------

_RAW = f"""
files AS (SELECT * REPLACE (coalesce(kind, 'fallback') AS kind), string_split(path, '/')[-1] AS name,
  CASE WHEN low IS NULL AND id % 64 = 11 THEN 'GIF89a' || text
       WHEN low IS NULL THEN '%PDF-' || text
       WHEN low = 'pdf' AND id % 64 = 9 THEN '%PDF-1.4' || {LF} || text ELSE text END AS content
  FROM known),
hex_src AS (SELECT id, content FROM files WHERE NOT is_dir AND NOT {_ASCII.format('content')}),
{_hex_lines('hex_src')},
dump AS (SELECT id, string_agg(line || {LF}, '' ORDER BY offset_no) AS t FROM hexed GROUP BY id),
raw AS (SELECT f.id, CASE WHEN d.id IS NULL THEN 'text' ELSE 'hex' END AS raw_shape,
  CASE WHEN d.id IS NULL THEN content ELSE 'file: ' || path || {LF} || 'size: '
    || size || ' bytes' || {LF} || 'mime: ' || CASE WHEN kind = 'image' AND low IS NULL
    THEN 'image/gif' WHEN starts_with(content, '%PDF') THEN 'application/pdf' ELSE 'unknown' END
    || {LF} || t END AS raw_text
  FROM files f LEFT JOIN dump d USING (id) WHERE NOT is_dir)"""

_XML = """
zipped AS (SELECT doc_id, string_split(translate(text, '&<>', '+++'), chr(10)) AS l FROM documents),
packed AS (SELECT doc_id, l, '<w:document><w:body>' || array_to_string(list_transform(l, lambda x:
  '<w:p><w:r><w:t>' || x || '</w:t></w:r></w:p>'), '') || '</w:body></w:document>' AS xml FROM zipped)"""
_ZIP_ENTRIES = """unnest(list_concat(
  [{'seq': 1, 'path': 'word/', 'size': 0}, {'seq': 2, 'path': 'word/document.xml', 'size': strlen(xml)}],
  list_transform(l, lambda x, i: {'seq': 3 + i, 'path': 'lines/l' || (i - 1) || '.txt', 'size': strlen(x)})),
  recursive := true)"""


_COMIC = f"""'Comic book archive — ' || (3 + len(l))
  || ' file(s)' || {LF} || {LF} || 'word/' || {LF} || 'word/document.xml (' || strlen(xml) || ' bytes)' || {LF}
  || array_to_string(list_transform(l, lambda x, i: 'lines/l' || (i - 1) || '.txt (' || strlen(x) || ' bytes)'
  || {LF}), '')"""
_DOCX = f"array_to_string(list_transform(l, lambda x: trim(x) || ' '), {LF} || {LF})"
# Trees of the corpus: zip and tar files by their members, directories by their listing.
_DRAWN = f"""{_XML}, {_INI.removeprefix(',')},
ini AS (SELECT id, string_agg(t, '' ORDER BY section) AS ini_text FROM (
  SELECT id, section, CASE WHEN section <> '' THEN '[' || section || ']' || {LF} ELSE '' END
    || string_agg(key || ' = ' || value || {LF}, '' ORDER BY key) || {LF} AS t
  FROM entries GROUP BY id, section) GROUP BY id),
rows_of AS (SELECT id, string_agg((i + 1) || chr(9) || line || {LF}, '' ORDER BY i) AS tsv_text,
  string_agg(line || {LF}, '' ORDER BY i) AS opf_text FROM each GROUP BY id),
csv AS (SELECT id, string_agg(line_no || chr(9) || line || chr(9) || 'x' || {LF}, '' ORDER BY line_no) AS csv_text
  FROM lines GROUP BY id),
shelves AS (SELECT f.id AS tree_id, 'd' || (i % 3) AS shelf, line || '.txt' AS leaf, max(length(line)) AS size
  FROM files f JOIN each ON f.id = each.id WHERE is_dir GROUP BY ALL),
members AS (
  SELECT tree_id, seq, path, suffix(path, '/') AS is_dir, size,
    CASE WHEN suffix(path, '/') THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END AS mode
  FROM (SELECT f.id AS tree_id, {_ZIP_ENTRIES} FROM files f JOIN packed p ON f.id = p.doc_id WHERE low = 'zip')
  UNION ALL SELECT f.id, i, 'part' || ((i - 1) % 2) || '/l' || (i - 1) || '.txt', false, strlen(line), '-rw-r-----'
  FROM files f JOIN (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM packed) m
    ON f.id = m.doc_id WHERE f.low = 'gz'
  UNION ALL SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY shelf, leaf), shelf || '/' || leaf,
    false, size, '-rw-r--r--' FROM shelves
  UNION ALL SELECT DISTINCT tree_id, 0, shelf, true, NULL::BIGINT, 'drwxr-xr-x' FROM shelves),
{_nodes_sql('members')}, {_ORDERED}, drawn AS ({_rendered(False)}),
trees AS (SELECT tree_id AS id, string_agg(line || {LF}, '' ORDER BY pos) AS tree FROM drawn GROUP BY 1),
lists AS (SELECT doc_id AS id, {_COMIC} AS comic, {_DOCX} AS docx FROM packed)"""
_PIECES = f"""
WITH {_LISTING}, {_KINDS}, {_RAW}, {_LINES}, {_PAGES}, {_DRAWN},
fb2 AS (SELECT id, string_agg(line || {LF}, '' ORDER BY line_no) AS fb2_text FROM
  (SELECT id, line_no, {_trim('line')} AS line FROM lines) WHERE line <> '' GROUP BY id),
pdf AS (SELECT id, string_agg(CASE WHEN line_no > 1 THEN {LF} || '--- page ' || line_no || ' ---'
  || {LF} || {LF} ELSE '' END || line, '' ORDER BY line_no) || {LF} AS pdf_text FROM lines GROUP BY id),
legacy AS (SELECT doc_id AS id, {_RUNS} AS runs FROM documents),
pieces AS (
  SELECT id, kind, name, path, size, CASE
    WHEN kind = 'directory' OR low IN ('zip', 'gz') THEN 'tree' WHEN kind = 'markdown' THEN 'markdown'
    WHEN kind = 'code' THEN 'text' WHEN low IN ('csv', 'tsv') THEN 'table'
    WHEN low IN ('json', 'ini', 'eml', 'rtf', 'fb2', 'opf', 'cbz', 'docx') THEN 'text'
    WHEN kind = 'notebook' THEN 'slides'
    WHEN kind = 'pdf' AND NOT starts_with(content, '%PDF') THEN 'text'
    WHEN kind = 'legacy_office' THEN CASE WHEN length(runs) >= 20 THEN 'text' ELSE 'unsupported' END
    WHEN kind IN ('image', 'media', 'font', 'spreadsheet', 'database', 'plist')
      AND raw_shape = 'hex' THEN 'unsupported'
    ELSE raw_shape END AS shape,
  CASE
    WHEN kind = 'directory' OR low IN ('zip', 'gz') THEN coalesce(tree, '')
    WHEN low = 'cbz' THEN comic
    WHEN low = 'docx' THEN docx
    WHEN kind IN ('markdown', 'code') OR low = 'rtf' THEN text
    WHEN low = 'csv' THEN 'doc' || chr(9) || 'lang' || {LF} || csv_text
    WHEN low = 'tsv' THEN 'doc' || chr(9) || 'lang' || {LF} || coalesce(tsv_text, '')
    WHEN low = 'json' AND id % 3 = 0 THEN '{{"id": ' || id || ', "text": ' || to_json(text)::VARCHAR
    WHEN low = 'json' THEN '{{"id":' || id || ',"lang":"' || lang || '","text":' || to_json(text)::VARCHAR || '}}'
    WHEN low = 'ini' THEN ini_text
    WHEN low = 'eml' THEN 'From: ' || source || '@example.org' || {LF} || 'To: list' || {LF}
      || 'Subject: doc ' || id || {LF} || {LF} || text
    WHEN low = 'fb2' THEN fb2_text
    WHEN low = 'opf' THEN 'EPUB package (OPF)' || {LF} || {LF} || id || {LF} || coalesce(opf_text, '')
    WHEN kind = 'notebook' THEN '## Cell 1 (markdown)' || {LF} || {LF} || '# doc' || {LF} || {LF} || '---'
      || {LF} || {LF} || '## Cell 2 (cell)' || {LF} || {LF} || text
    WHEN kind = 'pdf' AND NOT starts_with(content, '%PDF') THEN pdf_text
    WHEN kind = 'legacy_office' AND length(runs) >= 20 THEN runs || {LF}
    WHEN kind = 'legacy_office' THEN 'Legacy Office file: ' || path || ' (' || size || ' bytes)' || {LF}
      || 'Best-effort OLE text extraction failed. Open in LibreOffice/Microsoft Office or convert to '
      || 'OpenXML (docx/xlsx/pptx).'
    WHEN kind IN ('image', 'media', 'font', 'spreadsheet', 'database', 'plist')
      AND raw_shape = 'hex' THEN kind || ' file: ' || path || ' (' || size || ' bytes)' || {LF}
      || 'No text extractor for this kind; register one.'
    ELSE raw_text END AS t,
  CASE WHEN low = 'json' AND id % 3 = 0 THEN 'invalid json' END AS bad
  FROM files LEFT JOIN raw USING (id) LEFT JOIN fb2 USING (id) LEFT JOIN pdf USING (id)
    LEFT JOIN legacy USING (id) LEFT JOIN trees USING (id) LEFT JOIN lists USING (id) LEFT JOIN ini USING (id)
    LEFT JOIN rows_of USING (id) LEFT JOIN csv USING (id)),
previews AS (SELECT id, kind, shape,
  CASE WHEN kind = 'directory' THEN 'Directory: ' || path WHEN shape = 'tree' THEN 'Archive: ' || path
    ELSE name END AS title,
  t AS text, length(t) AS n_chars, false AS truncated,
  coalesce(bad, CASE WHEN shape = 'unsupported' THEN split_part(t, {LF}, 1) END) AS error FROM pieces)"""
ORACLE_SQL["preview_corpus"] = f"{_PIECES} SELECT * FROM previews"
ORACLE_SQL["write_previews"] = ORACLE_SQL["preview_corpus"]
ORACLE_SQL["register_extractor"] = f"""
{_PIECES}, k AS (SELECT p.*, f.low, f.text AS src FROM previews p JOIN files f USING (id))
SELECT id, CASE WHEN low = 'nb9' AND kind = 'fallback' THEN 'notes9' ELSE kind END AS kind,
  CASE WHEN kind IN ('markdown', 'code') OR (low = 'nb9' AND kind = 'fallback') THEN 'text' ELSE shape END AS shape,
  CASE WHEN kind = 'markdown' THEN 'md: ' || substr(src, 1, 20)
       WHEN low = 'nb9' AND kind = 'fallback' THEN 'notes: ' || substr(src, 1, 9)
       WHEN kind = 'code' AND contains(src, '|') THEN 'piped' WHEN kind = 'code' AND contains(src, '#')
       THEN 'hashed' ELSE text END AS text
FROM k"""

# -- sources ---------------------------------------------------------------------------------

ORACLE_SQL["scan_files"] = f"""
SELECT lang, true AS whole, unnest(string_split(text, {LF})) AS line FROM documents"""
ORACLE_SQL["read_lines"] = f"""
WITH {_LINES} SELECT id AS doc_id, line_no - 1 AS place, line_no - 1 AS after_first, line FROM lines"""
ORACLE_SQL["read_delimited"] = f"""
WITH c AS (SELECT o_orderkey, list_concat([o_orderkey::VARCHAR],
  CASE WHEN o_orderkey % 3 <> 0 THEN [o_orderstatus] ELSE [] END,
  CASE WHEN o_orderkey % 5 = 0 THEN ['a,' || o_orderpriority || {LF} || '"b"'] ELSE [] END,
  CASE WHEN o_orderkey % 7 = 0 THEN ['x', '', ''] ELSE [] END) AS l FROM orders)
SELECT o_orderkey, len(l) AS n_cells, array_to_string(l, '|') AS cells FROM c"""
ORACLE_SQL["delimited_headers"] = """
SELECT c_custkey, 'c_custkey|c_name|c_nationkey|c_acctbal|c_mktsegment' AS headers, c_name, c_mktsegment
FROM customer"""
ORACLE_SQL["read_json_docs"] = """
SELECT CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS s_name,
  CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END AS s_suppkey,
  CASE WHEN s_suppkey % 4 = 0 THEN 'invalid json' END AS error,
  CASE WHEN s_suppkey % 4 = 0 THEN '{' || s_name END AS raw FROM supplier"""
ORACLE_SQL["read_parquet_preview"] = f"""
SELECT 'o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, '
  || 'o_orderdate timestamp_ntz, o_orderpriority string' AS columns,
  (SELECT count(*) FROM orders) AS n_rows, row_number() OVER (ORDER BY o_orderkey) AS row_no,
  o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || {_number('o_totalprice')} || '|'
  || o_orderdate || '|' || o_orderpriority AS cells
FROM orders ORDER BY o_orderkey LIMIT 20"""

ORACLE_SQL["image_headers"] = """
SELECT 'img' || doc_id AS path, ['png', 'gif', 'bmp', 'jpeg', 'webp', 'ico', 'png'][1 + doc_id % 8] AS format,
  CASE doc_id % 8 WHEN 5 THEN 256 WHEN 6 THEN NULL ELSE n_chars % 5000 + 1 END AS width,
  CASE WHEN doc_id % 8 = 6 THEN NULL WHEN doc_id % 8 <> 5 THEN doc_id % 3000 + 1
    WHEN (doc_id % 3000 + 1) % 256 = 0 THEN 256 ELSE (doc_id % 3000 + 1) % 256 END AS height
FROM documents WHERE doc_id % 8 <> 7"""
ORACLE_SQL["archive_manifest"] = f"""
WITH {_XML},
entries AS (
  SELECT doc_id, 1 AS seq, 'word/' AS path, true AS is_dir, 0 AS size FROM packed
  UNION ALL SELECT doc_id, 2, 'word/document.xml', false, strlen(xml) FROM packed
  UNION ALL SELECT doc_id, 4 + i, 'lines/l' || i || '.txt', false, strlen(line) FROM
    (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM packed)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS r FROM entries)
SELECT 'doc' || doc_id || '.zip' AS archive, seq, path, is_dir, size,
  CASE WHEN is_dir THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END AS mode, NULL::VARCHAR AS error
FROM ranked"""
ORACLE_SQL["archive_tree"] = f"""
WITH {_XML} SELECT 'doc' || doc_id || '.zip' AS tree_id, 4 + len(l) AS n_nodes FROM packed"""
_PREVIEW = "t AS text, length(t) AS n_chars, false AS truncated, NULL::VARCHAR AS error"
ORACLE_SQL["preview_containers"] = f"""
WITH {_XML}, texts AS (SELECT 'doc' || doc_id || '.docx' AS id, array_to_string(
  list_transform(l, lambda x: trim(x) || ' '), {LF} || {LF}) AS t FROM packed)
SELECT id, 'document' AS kind, 'text' AS shape, id AS title, {_PREVIEW} FROM texts"""
ORACLE_SQL["preview_archives"] = f"""
WITH {_XML},
files AS (SELECT 'doc' || doc_id || '.zip' AS tree_id, {_ZIP_ENTRIES} FROM packed),
entries AS (SELECT tree_id, seq, path, suffix(path, '/') AS is_dir, size,
  CASE WHEN suffix(path, '/') THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END AS mode FROM files),
{_nodes_sql('entries')}, {_ORDERED}, drawn AS ({_rendered(False)}),
texts AS (SELECT tree_id, string_agg(line || {LF}, '' ORDER BY pos) AS t FROM drawn GROUP BY 1)
SELECT tree_id AS id, 'archive' AS kind, 'tree' AS shape, 'Archive: ' || tree_id AS title, {_PREVIEW}
FROM texts"""
ORACLE_SQL["preview_comics"] = f"""
WITH {_XML}, texts AS (SELECT 'doc' || doc_id || '.cbz' AS id, {_COMIC} AS t FROM packed)
SELECT id, 'ebook' AS kind, 'text' AS shape, id AS title, {_PREVIEW} FROM texts"""
ORACLE_SQL["zip_member_text"] = f"""
WITH {_XML} SELECT 'doc' || doc_id || '.docx' AS path, 'word/document.xml' AS member, 2 AS seq,
  xml AS text, NULL::VARCHAR AS error FROM packed"""
ORACLE_SQL["docx_paragraphs"] = f"""
WITH {_XML} SELECT 'doc' || doc_id || '.docx' AS path,
  array_to_string(list_transform(l, lambda x: trim(x) || ' '), {LF} || {LF}) AS text FROM packed"""
ORACLE_SQL["odt_text"] = f"""
WITH {_XML} SELECT 'doc' || doc_id || '.odt' AS path,
  array_to_string(list_transform(l, lambda x: x || {LF}), '') AS text FROM packed"""
