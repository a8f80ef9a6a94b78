"""DuckDB queries with the same results as the registered ones."""

from __future__ import annotations

from bindery.options import PROMPT_TEMPLATES

RULE = "=" * 80
STAMP = "2024-06-01 12:00:00"
NL = "chr(10)"

# Fixed values, as SQL literals.
EMAIL = r"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'"
VALUE = r"[A-Za-z0-9!@#$%^&*()_+\-=\[\]{};:,.<>?]"
PASSWORD = rf"""'(password|pwd|passwd|pass)\s*[=:]\s*["'']?({VALUE}{{8,}})["'']?'"""
SECRET = rf"""'(secret|token|key)\s*[=:]\s*["'']?({VALUE}{{16,}})["'']?'"""
API_KEYS = (
    (r"'\bsk-[A-Za-z0-9]{48}\b'", "OpenAI API key"),
    (r"'\bAKIA[0-9A-Z]{16}\b'", "AWS Access Key"),
    (r"'\bxoxb-[0-9]+-[0-9]+-[A-Za-z0-9]+\b'", "Slack Bot Token"),
    (r"'\bghp_[A-Za-z0-9]{36}\b'", "GitHub Personal Access Token"),
)
NAMES = ("alice", "bob lee")
ARCHIVED = "contains(rel_path, '/archive/')"
SENSITIVE = "(rel_path LIKE '%/tokens.txt' OR rel_path LIKE '%.key')"

MD5 = "md5(doc_id::VARCHAR)"
SK = f"'sk-' || {MD5} || substr({MD5}, 1, 16)"
PLANT_NAMES = f"""(CASE doc_id % 3
  WHEN 0 THEN {NL} || 'Alice wrote to BOB LEE, not alice@example.com'
  WHEN 1 THEN {NL} || 'bob  lee and Bob Lee' ELSE '' END)"""
PLANT_KEYS = f"""({NL} || CASE doc_id % 5
  WHEN 0 THEN 'use ' || {SK} || ' now'
  WHEN 1 THEN 'id AKIA' || upper(substr({MD5}, 1, 16))
  WHEN 2 THEN 'xoxb-' || doc_id || '-' || doc_id * 7 || '-' || {MD5}
  WHEN 3 THEN '(ghp_' || {MD5} || substr({MD5}, 1, 4) || ')'
  ELSE 'API Key: ' || {SK} END)"""
PLANT_PASSWORDS = f"""(CASE doc_id % 4
  WHEN 0 THEN {NL} || 'Password: secret' || doc_id || 'xyz'
  WHEN 1 THEN {NL} || 'pass = short'
  WHEN 2 THEN {NL} || 'PWD="pw' || {MD5} || '"' || {NL} || 'compass=north-by-west' ELSE '' END)"""
PLANT_ALL = f"{PLANT_NAMES} || {PLANT_KEYS} || {PLANT_PASSWORDS}"
PLANT_HASH = f"""({NL} || '# note ' || doc_id || {NL} || 'x = ' || doc_id || '  # note' || {NL} || {NL}
  || '    a    b   ' || {NL} || 'c = "#fff"' || {NL} || 's = "it''s"  # keep' || {NL}
  || '  #!/bin/sh  -x' || {NL} || '   ' || {NL})"""
PLANT_SLASH = f"""({NL} || '// only' || {NL} || 'int x = 1;  // note' || {NL} || 'u = "http://h' || doc_id
  || '"' || {NL} || {NL} || chr(9) || ' call(  a,   b )  ' || {NL})"""


def files(planted: str = "''") -> str:
    return f"""files AS (
  SELECT *, regexp_extract(rel_path, '[.][^./]+$') AS ext, strlen(text) AS length FROM (
    SELECT doc_id, source AS bundle, lang, text || {planted} AS text,
      TIMESTAMP '2024-01-01' + to_days((doc_id % 365)::INT) AS mtime,
      coalesce(lang, 'none') || '/' || CASE WHEN doc_id % 11 = 0 THEN 'archive/' ELSE '' END
        || CASE WHEN doc_id % 13 = 0 THEN 'd' || doc_id || '/tokens.txt'
           ELSE 'd' || doc_id
             || ['.txt', '.md', '.py', '.js', '.json', '.csv', '.key', '.log'][(doc_id % 8 + 1)::INT] END
        AS rel_path
    FROM documents))"""


def swap(text: str, pattern: str, mark: str, flags: str = "g") -> str:
    return f"regexp_replace({text}, {pattern}, '{mark}', '{flags}')"


def swap_keys(text: str) -> str:
    for pattern, _ in API_KEYS:
        text = swap(text, pattern, "<REDACTED_API_KEY>")
    return text


def swap_names(text: str) -> str:
    for i, name in enumerate(NAMES, 1):
        text = swap(text, f"'{name}'", f"<USER_{i}>", "gi")
    return text


def swap_emails(text: str) -> str:
    return swap(text, EMAIL, "<EMAIL_ADDRESS>")


def swap_passwords(text: str) -> str:
    return swap(text, PASSWORD, r"\1=<REDACTED_SECRET>", "gi")


def swap_secrets(text: str) -> str:
    return swap(text, SECRET, r"\1=<REDACTED_SECRET>", "gi")


def hashed(planted: str, text: str, extra: str = "") -> str:
    return f"""WITH {files(planted)}{extra}, done AS (SELECT bundle, rel_path, {text} AS t FROM files)
SELECT bundle, rel_path, length(t) AS chars, md5(t) AS text_md5 FROM done"""


def kept(where: str) -> str:
    return f"WITH {files()} SELECT bundle, rel_path, length FROM files WHERE {where}"


# Text of kept files with the default stages, for everything built on it.
KEPT = f"""{files()}, kept AS (SELECT * FROM files
  WHERE ext IN ('.txt', '.py', '.md', '.json', '.xml', '.csv')
    AND NOT {ARCHIVED} AND NOT {SENSITIVE}),
prep AS (SELECT * REPLACE ({swap_secrets(swap_passwords(swap_keys(swap_emails('text'))))} AS text),
  bundle || '/' || rel_path AS display_path FROM kept)"""


def tree(source: str) -> str:
    """Lines of the tree of ``source`` by a self-join on path prefixes."""
    return f"""parts AS (SELECT bundle, string_split(rel_path, '/') AS p FROM {source}),
nodes AS (SELECT DISTINCT bundle, i = len(p) AS is_file,
    list_transform(range(1, i + 1), lambda j: (CASE WHEN j < len(p) THEN '0' ELSE '1' END) || p[j]) AS key
  FROM (SELECT bundle, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
flags AS (SELECT *, lead(key) OVER (PARTITION BY bundle, key[1:len(key) - 1] ORDER BY key) IS NULL AS is_last
  FROM nodes),
indents AS (SELECT n.bundle, n.key,
    string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY len(a.key)) AS indent
  FROM flags n JOIN flags a ON a.bundle = n.bundle AND len(a.key) < len(n.key)
    AND n.key[1:len(a.key)] = a.key GROUP BY ALL),
tree AS (SELECT bundle, []::VARCHAR[] AS key, bundle || '/' AS line FROM (SELECT DISTINCT bundle FROM {source})
  UNION ALL SELECT f.bundle, f.key, coalesce(i.indent, '') || CASE WHEN is_last THEN '└── ' ELSE '├── ' END
    || substr(f.key[len(f.key)], 2) || CASE WHEN is_file THEN '' ELSE '/' END
  FROM flags f LEFT JOIN indents i ON i.bundle = f.bundle AND i.key = f.key)"""


def lines(*parts: str) -> str:
    return f" || {NL} || ".join(parts)


COUNTS = "counts AS (SELECT bundle, count(*) AS n FROM prep GROUP BY 1)"
PARTS = "string_split(rel_path, '/')"
EMPTY = "[]::VARCHAR[]"

STANDARD_HEAD = lines(
    "'Generated by Bindery'", f"'Timestamp: {STAMP}'", "'Total files: ' || n",
    "'PII Sanitization: ENABLED'", "''", f"'{RULE}'", "''", "'DIRECTORY STRUCTURE:'", f"'{RULE}'",
)
STANDARD_BODY = lines(
    "''", f"'{RULE}'", "'BEGIN FILE: ' || display_path", f"'{RULE}'",
    f"text || CASE WHEN text <> '' AND NOT ends_with(text, {NL}) THEN {NL} ELSE '' END",
    f"'{RULE}'", "'END FILE: ' || display_path", f"'{RULE}'",
)
STANDARD = f"""WITH {KEPT}, {COUNTS}, {tree('prep')}, sections AS (
  SELECT bundle, 0 AS part, {EMPTY} AS key, {STANDARD_HEAD} AS section FROM counts
  UNION ALL SELECT bundle, 1, key, line FROM tree
  UNION ALL SELECT bundle, 2, {EMPTY}, '{RULE}' FROM counts
  UNION ALL SELECT bundle, 3, {PARTS}, {STANDARD_BODY} FROM prep)"""

XML_HEAD = lines(
    "'<?xml version=''1.0'' encoding=''UTF-8''?>'", "'<context>'", "'  <metadata>'",
    "'    <generated_by>Bindery</generated_by>'", f"'    <timestamp>{STAMP}</timestamp>'",
    "'    <total_files>' || n || '</total_files>'", "'    <output_format>xml</output_format>'",
    "'    <pii_sanitization>ENABLED</pii_sanitization>'", "'  </metadata>'", "'  <documents>'",
)
XML_BODY = lines(
    "'    <document index=''' || i || '''>'", "'      <source>' || display_path || '</source>'",
    "'      <document_content>'",
    "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')",
    "'      </document_content>'", "'    </document>'",
)
XML = f"""WITH {KEPT}, {COUNTS}, indexed AS (
  SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY {PARTS}) AS i FROM prep),
sections AS (
  SELECT bundle, 0 AS part, {EMPTY} AS key, {XML_HEAD} AS section FROM counts
  UNION ALL SELECT bundle, 3, {PARTS}, {XML_BODY} FROM indexed
  UNION ALL SELECT bundle, 4, {EMPTY}, {lines("'  </documents>'", "'</context>'")} FROM counts)"""

MARKDOWN_HEAD = lines(
    "'# AI Context'", "''", "'## Metadata'", "'- **Generated By**: Bindery'",
    f"'- **Timestamp**: {STAMP}'", "'- **Total Files**: ' || n", "'- **Output Format**: markdown'",
    "'- **Pii Sanitization**: ENABLED'", "''", "'## Files'",
)
FENCE = """CASE ext WHEN '.py' THEN 'python' WHEN '.json' THEN 'json' WHEN '.md' THEN 'markdown' ELSE '' END"""
MARKDOWN_BODY = lines(
    "''", "'### File: `' || display_path || '`'", "''", f"'```' || {FENCE}", "text", "'```'"
)
MARKDOWN = f"""WITH {KEPT}, {COUNTS}, sections AS (
  SELECT bundle, 0 AS part, {EMPTY} AS key, {MARKDOWN_HEAD} AS section FROM counts
  UNION ALL SELECT bundle, 3, {PARTS}, {MARKDOWN_BODY} FROM prep)"""

NUMBERED = """ SELECT bundle, row_number() OVER (PARTITION BY bundle ORDER BY part, key) AS ordinal, section
FROM sections"""

# The whole standard text of each bundle, and statistics taken from it.
TEXTS = f"""{STANDARD}, texts AS (
  SELECT bundle, string_agg(section || {NL}, '' ORDER BY part, key) AS t FROM sections GROUP BY bundle),
sizes AS (SELECT bundle, count(*) AS total_files, sum(length)::BIGINT AS total_size_bytes FROM prep GROUP BY 1),
types AS (SELECT bundle, string_agg(ext || ':' || n, ' ' ORDER BY ext) AS file_types
  FROM (SELECT bundle, ext, count(*) AS n FROM prep GROUP BY ALL) GROUP BY 1),
stats AS (SELECT bundle, total_files, file_types, total_size_bytes,
    round(total_size_bytes / 1024, 2) AS total_size_kb, length(t) AS character_count,
    len(string_split(t, {NL})) AS line_count, length(t) // 4 AS token_count,
    round((length(t) // 4) / total_files, 2) AS avg_tokens_per_file,
    round((1 - length(t) / total_size_bytes) * 100, 2) AS compression_ratio
  FROM texts JOIN sizes USING (bundle) JOIN types USING (bundle))"""


def hash_line(line: str) -> str:
    even = " AND ".join(
        f"(length({line}) - length(replace({line}, '{q}', ''))) % 2 = 0" for q in ('"', "''")
    )
    return rf"""CASE WHEN NOT contains({line}, '#') OR regexp_matches({line}, '^\s*#!') THEN {line}
      WHEN regexp_matches({line}, '^\s*#') THEN ''
      WHEN {even} THEN split_part({line}, '#', 1) ELSE {line} END"""


def slash_line(line: str) -> str:
    return f"split_part({line}, '//', 1)"


def squeeze_line(line: str) -> str:
    bare = rf"regexp_replace({line}, '^\s+|\s+$', '', 'g')"
    return rf"regexp_extract({line}, '^\s*') || regexp_replace({bare}, '\s+', ' ', 'g')"


def minified(text: str, cut: str) -> str:
    rows = f"list_transform(string_split({text}, {NL}), lambda l: {cut})"
    full = rf"list_filter({rows}, lambda l: regexp_matches(l, '\S'))"
    return f"array_to_string(list_transform({full}, lambda l: {squeeze_line('l')}), {NL})"


HASHED = minified("text", hash_line("l"))
SLASHED = minified("text", slash_line("l"))
MIXED = f"CASE WHEN ext = '.js' THEN {SLASHED} ELSE {HASHED} END"

IGNORED_CASES = r"""CASE
  WHEN regexp_matches(rel_path, '(^|/)d[^/]3\.md(/|$)') THEN true
  WHEN regexp_matches(rel_path, '^es/(.*/)?tokens\.txt(/|$)') THEN true
  WHEN regexp_matches(rel_path, '^de/d1[^/]*\.txt(/|$)') THEN true
  WHEN regexp_matches(rel_path, '(^|/)archive/') THEN true
  WHEN regexp_matches(rel_path, '^fr/[^/]*\.log(/|$)') THEN false
  WHEN regexp_matches(rel_path, '(^|/)[^/]*\.log(/|$)') THEN true
  ELSE false END"""

CLASSIFIED = f"""WITH {files("CASE WHEN doc_id % 3 = 0 THEN chr(0) ELSE '' END")},
classified AS (SELECT *, CASE
    WHEN {ARCHIVED} THEN 'in archive folder'
    WHEN {IGNORED_CASES} THEN 'matched .gitignore/.gptignore'
    WHEN doc_id % 3 = 0 AND length <= 1024 THEN 'binary file'
    WHEN {SENSITIVE} THEN 'excluded by Safe Mode'
    WHEN length / 1024 < 0.5 OR mtime < TIMESTAMP '2024-02-01' THEN 'filtered by size/date criteria'
    END AS reason FROM files)"""

STAGES = f"""WITH {files(PLANT_ALL)},
s1 AS (SELECT bundle, rel_path, text AS t0, {swap("text", "'alice'", "<USER_1>", "gi")} AS t1 FROM files),
s2 AS (SELECT *, {swap("t1", "'bob lee'", "<USER_2>", "gi")} AS t2 FROM s1),
s3 AS (SELECT *, {swap_emails("t2")} AS t3 FROM s2),
s4 AS (SELECT *, {swap("t3", API_KEYS[0][0], "<REDACTED_API_KEY>")} AS t4 FROM s3),
s5 AS (SELECT *, {swap("t4", API_KEYS[1][0], "<REDACTED_API_KEY>")} AS t5 FROM s4),
s6 AS (SELECT *, {swap("t5", API_KEYS[2][0], "<REDACTED_API_KEY>")} AS t6 FROM s5),
s7 AS (SELECT *, {swap("t6", API_KEYS[3][0], "<REDACTED_API_KEY>")} AS t7 FROM s6),
s8 AS (SELECT *, {swap_passwords("t7")} AS t8 FROM s7),
found AS (
  SELECT bundle, rel_path, 'name' AS kind, regexp_matches(t0, 'alice', 'i')::BIGINT AS n,
    'Replaced ''alice'' with <USER_1>' AS message FROM s8
  UNION ALL SELECT bundle, rel_path, 'name', regexp_matches(t1, 'bob lee', 'i')::BIGINT,
    'Replaced ''bob lee'' with <USER_2>' FROM s8
  UNION ALL SELECT bundle, rel_path, 'email', e, 'Redacted ' || e || ' email address(es)'
    FROM (SELECT *, len(list_distinct(regexp_extract_all(t2, {EMAIL}))) AS e FROM s8)
  {"".join(
    f'''UNION ALL SELECT bundle, rel_path, 'api_key', regexp_matches(t{3 + i}, {pattern})::BIGINT,
    'Redacted {kind}' FROM s8 ''' for i, (pattern, kind) in enumerate(API_KEYS)
  )}
  UNION ALL SELECT bundle, rel_path, 'password', c, 'Redacted ' || c || ' password/secret assignment(s)'
    FROM (SELECT *, len(regexp_extract_all(t7, {PASSWORD}, 0, 'i')) AS c FROM s8)
  UNION ALL SELECT bundle, rel_path, 'secret', c, 'Redacted ' || c || ' password/secret assignment(s)'
    FROM (SELECT *, len(regexp_extract_all(t8, {SECRET}, 0, 'i')) AS c FROM s8))"""

PER_BUNDLE = f"""WITH {files()}, per_bundle AS (
  SELECT bundle, sum(length(text) // 4)::BIGINT AS tokens FROM files GROUP BY 1)"""

PROMPT = "Review the files below."
RULE_GAP = f"{NL} || {NL} || '{RULE}' || {NL} || {NL}"
PROMPT_META = [
    ("generated_by", "'Bindery'"), ("timestamp", f"'{STAMP}'"), ("total_files", "n"),
    ("output_format", "'{layout}'"), ("skeleton_mode", "'ENABLED (signatures only)'"),
]


def _prompt_sql() -> str:
    standard = f"'SYSTEM INSTRUCTIONS:' || {NL} || '{PROMPT}' || {RULE_GAP} || " + lines(
        "'Generated by Bindery'", f"'Timestamp: {STAMP}'", "'Total files: ' || n",
        "'Skeleton Mode: ENABLED (signatures only)'", "''", f"'{RULE}'", "''",
        "'DIRECTORY STRUCTURE:'", f"'{RULE}'",
    )
    xml = f"'<!-- System Instructions -->' || {NL} || '{PROMPT}' || {NL} || {NL} || " + lines(
        "'<?xml version=''1.0'' encoding=''UTF-8''?>'", "'<context>'", "'  <metadata>'",
        *[f"'    <{k}>' || {v.format(layout='xml')} || '</{k}>'" for k, v in PROMPT_META],
        "'  </metadata>'", "'  <documents>'",
    )
    markdown = f"'## System Instructions' || {NL} || {NL} || '{PROMPT}' || {NL} || {NL} || " + lines(
        "'# AI Context'", "''", "'## Metadata'",
        *[
            f"'- **{k.replace('_', ' ').title()}**: ' || {v.format(layout='markdown')}"
            for k, v in PROMPT_META
        ],
        "''", "'## Files'",
    )
    layouts = {"standard": standard, "xml": xml, "markdown": markdown}
    selects = " UNION ALL ".join(
        f"SELECT '{name}' AS layout, bundle, {section} AS section FROM counts"
        for name, section in layouts.items()
    )
    return f"WITH counts AS (SELECT source AS bundle, count(*) AS n FROM documents GROUP BY 1) {selects}"


CODE = f"""WITH code AS (
  SELECT p_partkey AS k, p_name, p_brand, p_size, replace(p_brand, '#', '_') AS bundle,
    'src/p' || p_partkey || '.py' AS rel_path,
    'import os' || {NL} || {NL} || {NL} || 'class P' || p_partkey || '(Base' || p_partkey % 3 || ', object):' || {NL}
    || '    ""\"Part ' || p_name || '""\"' || {NL} || '    size = ' || p_size || {NL} || {NL}
    || '    def price(self, qty: int) -> float:' || {NL} || '        ""\"Price of qty""\"' || {NL}
    || '        return qty * self.size' || {NL} || {NL} || '    async def skip(self):' || {NL}
    || '        pass' || {NL} || {NL} || '    def brand(self):' || {NL} || '        return "' || p_brand || '"' || {NL}
    || CASE WHEN p_partkey % 7 = 0 THEN {NL} || '    class Inner:' || {NL} || '        def deep(self, n: int):'
       || {NL} || '            return n' || {NL} ELSE '' END
    || {NL} || {NL} || 'def make_' || p_partkey || '(x, y: str = "a", *rest) -> P' || p_partkey || ':' || {NL}
    || '    return P' || p_partkey || '()' || {NL} || {NL} || {NL} || 'async def load_' || p_partkey || '(path):' || {NL}
    || '    ""\"Load it""\"' || {NL} || '    return path' || {NL}
    || CASE WHEN p_partkey % 10 = 0 THEN 'def broken(:' || {NL} ELSE '' END AS source
  FROM part)"""
OUTLINE = " || ".join(
    [
        lines(
            "'class P' || k || '(Base' || k % 3 || ', object):'", "'    \"\"\"Part ' || p_name || '\"\"\"'",
            "'    def price(self, qty: int) -> float:'", "'        \"\"\"Price of qty\"\"\"'",
            "'        ...'", "''", "'    def brand(self):'", "'        ...'", "''", "''",
            "'def make_' || k || '(x, y: str) -> P' || k || ':'", "'    ...'", "''",
            "'def load_' || k || '(path):'", "'    \"\"\"Load it\"\"\"'", "'    ...'", "''",
        ),
        "CASE WHEN k % 7 = 0 THEN "
        + f"{NL} || "
        + lines("'class Inner:'", "'    def deep(self, n: int):'", "'        ...'", "''", "''")
        + " ELSE '' END",
    ]
)
OUTLINED = f"{CODE}, outlined AS (SELECT *, CASE WHEN k % 10 = 0 THEN source ELSE {OUTLINE} END AS t FROM code)"
SYMBOL_ROWS = [
    ("1", "'class'", "NULL", "'P' || k", "'class P' || k || '(Base' || k % 3 || ', object)'", "NULL", "'Part ' || p_name", ""),
    ("2", "'method'", "'P' || k", "'price'", "'def price(self, qty: int) -> float'", "'float'", "'Price of qty'", ""),
    ("3", "'method'", "'P' || k", "'brand'", "'def brand(self)'", "NULL", "NULL", ""),
    ("4", "'function'", "NULL", "'make_' || k", "'def make_' || k || '(x, y: str) -> P' || k", "'P' || k", "NULL", ""),
    ("5", "'function'", "NULL", "'load_' || k", "'def load_' || k || '(path)'", "NULL", "'Load it'", ""),
    ("6", "'class'", "NULL", "'Inner'", "'class Inner'", "NULL", "NULL", " AND k % 7 = 0"),
    ("7", "'method'", "'Inner'", "'deep'", "'def deep(self, n: int)'", "NULL", "NULL", " AND k % 7 = 0"),
]
SYMBOLS = " UNION ALL ".join(
    f"SELECT bundle, rel_path AS path, {o}::INT AS ordinal, {kind} AS kind, {parent}::VARCHAR AS parent, "
    f"{name} AS name, {sig} AS signature, {ret}::VARCHAR AS returns, {doc}::VARCHAR AS docstring "
    f"FROM code WHERE k % 10 <> 0{where}"
    for o, kind, parent, name, sig, ret, doc, where in SYMBOL_ROWS
)

STORE_SIDES = """old AS (
  SELECT 'profile-' || c_custkey AS name, 'segment' AS key, c_mktsegment AS value FROM customer
  UNION ALL SELECT 'profile-' || c_custkey, 'nation', c_nationkey::VARCHAR FROM customer),
new AS (
  SELECT 'profile-' || p_partkey * 2 AS name, 'segment' AS key, p_type AS value FROM part
  UNION ALL SELECT 'profile-' || p_partkey * 2, 'size', p_size::VARCHAR FROM part WHERE p_partkey % 3 = 0)"""

TEMPLATES = {"en": "Code Review", "de": "Documentation", "fr": "Refactoring"}
TEMPLATE_NAME = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{name}'" for k, name in TEMPLATES.items()) + " ELSE 'none' END"
TEMPLATE_BODY = "CASE lang " + " ".join(
    f"WHEN '{k}' THEN {lines(*[repr(x) for x in PROMPT_TEMPLATES[name].split(chr(10))])}" for k, name in TEMPLATES.items()
) + " ELSE 'own prompt for ' || count(*) END"

CHUNKED = f"""{XML}, sized AS (
  SELECT *, sum(length(section) + 1) OVER (PARTITION BY bundle ORDER BY part, key) - length(section) - 1 AS before,
    row_number() OVER (PARTITION BY bundle ORDER BY part DESC, key DESC) = 1 AS is_last FROM sections)
SELECT bundle, (before // 20000)::BIGINT AS chunk,
  string_agg(section || CASE WHEN is_last THEN '' ELSE {NL} END, '' ORDER BY part, key) AS text
FROM sized GROUP BY ALL"""

RULES_BY_BUNDLE = r"""CASE
  WHEN regexp_matches(rel_path, '^de/(.*/)?tokens\.txt(/|$)') THEN true
  WHEN regexp_matches(rel_path, '(^|/)d[^/]*' || (b % 10) || '\.[^/]*(/|$)') THEN false
  WHEN b % 2 = 0 AND regexp_matches(rel_path, '(^|/)es/') THEN true
  WHEN b % 2 = 1 AND regexp_matches(rel_path, '^fr(/|$)') THEN true
  ELSE regexp_matches(rel_path, '(^|/)[^/]*\.log(/|$)') END"""

PAGES = r"""pages_as_files AS (SELECT DISTINCT bundle, rel_path FROM (
  SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS bundle,
    rtrim(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/') AS rel_path FROM pages)
  WHERE rel_path <> '')"""

SELECTIVE_TEXTS = TEXTS.replace(f"AND NOT {SENSITIVE})", f"AND NOT {SENSITIVE} AND length / 1024 >= 24)")


def manifest(texts: str, dropped: str) -> str:
    return f"""{texts}, classified AS (SELECT * FROM files
      WHERE ext IN ('.txt', '.py', '.md', '.json', '.xml', '.csv')),
    skips AS (SELECT bundle, count(*) AS n FROM classified WHERE {dropped} GROUP BY 1),
    r AS (SELECT bundle, text AS t0, {swap_emails("text")} AS t1, {swap_keys(swap_emails("text"))} AS t2,
      {swap_passwords(swap_keys(swap_emails("text")))} AS t3 FROM kept),
    messages AS (SELECT bundle, sum((t1 <> t0)::INT + (t3 <> t2)::INT
      + regexp_matches(t3, {SECRET}, 'i')::INT
      + {" + ".join(f"regexp_matches(t1, {p})::INT" for p, _ in API_KEYS)})::BIGINT AS n FROM r GROUP BY 1)
    SELECT bundle, coalesce(total_files, 0) AS total_files, coalesce(character_count, 0) AS character_count,
      coalesce(token_count, 0) AS token_count, coalesce(round(token_count / 1000000 * 2.5, 8), 0) AS cost_usd,
      coalesce(messages.n, 0) AS redaction_messages, coalesce(skips.n, 0) AS skipped_files,
      0::BIGINT AS read_errors, CASE WHEN total_files > 0 THEN 'written' ELSE 'no matching files' END AS status
    FROM (SELECT DISTINCT bundle FROM classified) LEFT JOIN stats USING (bundle)
      LEFT JOIN messages USING (bundle) LEFT JOIN skips USING (bundle)"""


#: The run order of the bundles, not their name order.
SOURCE_ORD = "coalesce(TRY_CAST(regexp_extract(bundle, '[0-9]+$') AS INT), 0) * 7 % 20"

MEMBER_NUMBERS = [f"({n}) % 1000 + 1" for n in ("doc_id * 7", "doc_id", "doc_id * 3 + 1")]
MEMBER_MARKS = "chr(10) || '<USER_' || ({}) || '> met <USER_' || ({}) || '><USER_' || ({}) || '>'".format(*MEMBER_NUMBERS)
MEMBERS_FOUND = f"""list_transform(list_sort(list_distinct([{', '.join(MEMBER_NUMBERS)}])),
  lambda n: 'Replaced ''member' || lpad(CAST(n - 1 AS VARCHAR), 4, '0') || ''' with <USER_' || n || '>')"""

ORACLES: dict[str, str] = {
    "manifest": manifest(TEXTS, f"{ARCHIVED} OR {SENSITIVE}"),
    "manifest_every_source": manifest(SELECTIVE_TEXTS, f"{ARCHIVED} OR {SENSITIVE} OR length / 1024 < 24"),
    "scan_select_ext": f"""WITH {files()} SELECT bundle, rel_path, bundle || '/' || rel_path AS display_path,
      ext, length FROM files WHERE ext IN ('.txt', '.py', '.md', '.json')""",
    "filter_archive": kept(f"NOT {ARCHIVED}"),
    "filter_safe_mode": kept(f"NOT {SENSITIVE}"),
    "filter_size": kept("length / 1024 BETWEEN 1 AND 4"),
    "filter_mtime": kept("mtime >= TIMESTAMP '2024-06-01'"),
    "filter_combined": kept("length / 1024 BETWEEN 1 AND 8 AND mtime >= TIMESTAMP '2024-03-01'"),
    "filter_binary": f"""WITH {files("CASE WHEN doc_id % 3 = 0 THEN chr(0) ELSE '' END")}
      SELECT bundle, rel_path, length FROM files WHERE NOT (doc_id % 3 = 0 AND length <= 1024)""",
    "skip_reasons": f"""{CLASSIFIED} SELECT bundle, reason, count(*) AS n FROM classified
      WHERE reason IS NOT NULL GROUP BY ALL""",
    "skip_topk": f"""{CLASSIFIED}, counts AS (SELECT bundle,
        count(*) FILTER (reason <> 'filtered by size/date criteria') AS singles,
        count(*) FILTER (reason = 'filtered by size/date criteria') AS criteria
      FROM classified WHERE reason IS NOT NULL GROUP BY 1),
      listed AS (SELECT bundle, row_number() OVER (PARTITION BY bundle ORDER BY {PARTS}) AS rank,
          regexp_extract(rel_path, '[^/]+$') || ' (' || reason || ')' AS line
        FROM classified WHERE reason <> 'filtered by size/date criteria'
        UNION ALL SELECT bundle, singles + 1, criteria || ' file(s) filtered by size/date criteria'
        FROM counts WHERE criteria > 0)
      SELECT bundle, rank, line, greatest(singles + (criteria > 0)::INT - 5, 0) AS more
      FROM listed JOIN counts USING (bundle) WHERE rank <= 5""",
    "ignore_rules": f"WITH {files()} SELECT bundle, rel_path, {IGNORED_CASES} AS ignored FROM files",
    "ignore_rules_by_bundle": f"""WITH {files()}, n AS (
        SELECT bundle, rel_path, regexp_extract(bundle, '[0-9]+$')::INT AS b FROM files)
      SELECT bundle, rel_path, {RULES_BY_BUNDLE} AS ignored FROM n""",
    "redact_names": hashed(PLANT_NAMES, swap_names("text")),
    "redact_many_names": f"""WITH {files(MEMBER_MARKS)}
      SELECT bundle, rel_path, md5({swap_secrets(swap_passwords(swap_keys(swap_emails("text"))))}) AS text_md5,
        array_to_string({MEMBERS_FOUND}, '; ') AS found FROM files""",
    "redact_emails": hashed(PLANT_NAMES, swap_emails("text")),
    "redact_api_keys": hashed(PLANT_KEYS, swap_keys("text")),
    "redact_passwords": hashed(PLANT_PASSWORDS, swap_passwords("text")),
    "redact_secrets": hashed(PLANT_KEYS, swap_secrets("text")),
    "redact_all": hashed(
        PLANT_ALL, swap_secrets(swap_passwords(swap_keys(swap_emails(swap_names("text")))))
    ),
    "redaction_counts": f"""{STAGES} SELECT bundle, kind, sum(n)::BIGINT AS n, count(*) AS messages
      FROM found WHERE n > 0 GROUP BY ALL""",
    "redaction_log": f"""{STAGES} SELECT bundle, bundle || '/' || rel_path || ': ' || message AS line
      FROM found WHERE n > 0""",
    "token_estimate": f"WITH {files()} SELECT bundle, rel_path, length(text) // 4 AS tokens FROM files",
    "model_cost": f"""{PER_BUNDLE} SELECT bundle, model, tokens, round(tokens / 1000000 * usd, 8) AS cost_usd
      FROM per_bundle, (VALUES ('gpt-4o', 2.5::DOUBLE), ('gpt-4o-mini', 0.15::DOUBLE),
        ('claude-3.5-sonnet', 3.0::DOUBLE), ('claude-3-opus', 15.0::DOUBLE),
        ('unknown-model', 2.5::DOUBLE)) AS prices(model, usd)""",
    "token_budget_running": f"""{PER_BUNDLE}, running AS (SELECT *,
        sum(tokens) OVER (ORDER BY {SOURCE_ORD})::BIGINT AS running_tokens,
        row_number() OVER (ORDER BY {SOURCE_ORD}) || '/' || count(*) OVER () AS progress FROM per_bundle)
      SELECT bundle, progress, tokens AS token_count, running_tokens,
        round(running_tokens / 1000000 * 2.5, 8) AS running_cost,
        round(least(100.0::DOUBLE, running_tokens / 128000 * 100), 4) AS budget_percent,
        CASE WHEN running_tokens > 128000 THEN 'over_hard' WHEN running_tokens > 32000 THEN 'over_soft'
          ELSE 'ok' END AS status FROM running""",
    "minify_hash": hashed(PLANT_HASH, HASHED),
    "minify_slash": hashed(PLANT_SLASH, SLASHED),
    "minify_mixed": hashed(f"{PLANT_HASH} || {PLANT_SLASH}", MIXED),
    "minify_reduction": f"""WITH {files(f"{PLANT_HASH} || {PLANT_SLASH}")}, sums AS (
        SELECT CASE ext WHEN '.js' THEN 'javascript' ELSE 'python' END AS language,
          sum(length(text))::BIGINT AS old_chars, sum(length({MIXED}))::BIGINT AS new_chars FROM files GROUP BY 1)
      SELECT *, round((1 - new_chars / old_chars) * 100, 1) AS reduction_pct FROM sums""",
    "doc_index": f"""WITH {files()} SELECT bundle, rel_path,
        row_number() OVER (PARTITION BY bundle ORDER BY {PARTS}) AS doc_index FROM files""",
    "path_order": f"""WITH {files()} SELECT bundle, rel_path,
        row_number() OVER (ORDER BY bundle, {PARTS}) AS position FROM files""",
    "dir_tree": f"""WITH {files()}, {tree("files")} SELECT bundle,
        row_number() OVER (PARTITION BY bundle ORDER BY key) AS ordinal, line FROM tree""",
    "page_tree": f"""WITH {PAGES}, {tree("pages_as_files")} SELECT bundle,
        row_number() OVER (PARTITION BY bundle ORDER BY key) AS ordinal, line FROM tree""",
    "sections_standard": STANDARD + NUMBERED,
    "sections_xml": XML + NUMBERED,
    "sections_markdown": MARKDOWN + NUMBERED,
    "prompt_prefix": _prompt_sql(),
    "prompt_templates": f"""SELECT source || '/' || lang AS bundle, {TEMPLATE_NAME} AS template,
        {TEMPLATE_BODY} AS prompt FROM documents GROUP BY source, lang""",
    "bundle_text": f"""{STANDARD}, sized AS (
        SELECT *, sum(length(section) + 1) OVER (PARTITION BY bundle ORDER BY part, key) - length(section) - 1 AS before
        FROM sections),
      chunks AS (SELECT bundle, (before // 16777216)::BIGINT AS chunk,
        string_agg(section || {NL}, '' ORDER BY part, key) AS t FROM sized GROUP BY ALL)
      SELECT bundle, chunk, length(t) AS chars, md5(t) AS text_md5 FROM chunks""",
    "bundle_text_chunks": CHUNKED,
    "all_bundles": f"""{MARKDOWN}, gapped AS (SELECT * FROM sections
        UNION ALL SELECT bundle, 5, {EMPTY}, {NL} FROM counts)
      SELECT row_number() OVER (ORDER BY {SOURCE_ORD}, bundle, part, key) AS position, bundle, section
      FROM gapped""",
    "bundle_stats": f"{TEXTS} SELECT * FROM stats",
    "file_type_histogram": f"""WITH {files()} SELECT bundle, ext, count(*) AS n, sum(length)::BIGINT AS bytes
      FROM files GROUP BY ALL""",
    "run_totals": f"""{TEXTS}, t AS (SELECT bundle, count(*) AS bundles, sum(total_files)::BIGINT AS files,
        sum(token_count)::BIGINT AS tokens FROM stats GROUP BY ROLLUP (bundle))
      SELECT *, round(tokens / 1000000 * 2.5, 8) AS cost_usd FROM t""",
    "report_lines": f"""{TEXTS} SELECT bundle, 'Tokens: ' || format('{{:,}}', token_count)
        || ' | Estimated cost: $' || printf('%.4f', token_count / 1000000 * 2.5) || ' (gpt-4o)' AS line FROM stats""",
    "code_symbols": f"{CODE} {SYMBOLS}",
    "symbol_counts": f"""SELECT bundle, kind, count(*) AS n, count(DISTINCT path) AS files
      FROM ({CODE} {SYMBOLS}) GROUP BY ALL""",
    "code_outline": f"{OUTLINED} SELECT bundle, rel_path, t AS text FROM outlined",
    "outline_reduction": f"""{OUTLINED}, sums AS (SELECT bundle, sum(length(source))::BIGINT AS old_chars,
        sum(length(t))::BIGINT AS new_chars FROM outlined GROUP BY 1)
      SELECT *, round((1 - new_chars / old_chars) * 100, 1) AS reduction_pct FROM sums""",
    "upsert_merge": f"""WITH {STORE_SIDES} SELECT * FROM old WHERE name NOT IN (SELECT name FROM new)
      UNION ALL SELECT * FROM new""",
    "upsert_replace": f"WITH {STORE_SIDES} SELECT * FROM new",
    "store_roundtrip": f"""WITH {STORE_SIDES} SELECT * FROM old UNION ALL
      SELECT p_type, 'template', 'Parts:' || {NL} || '- ' || count(*) FROM part GROUP BY p_type""",
    "store_typed": """WITH old AS (
        SELECT 'profile-' || c_custkey AS name, unnest([
          {'key': 'segment', 'value': '"' || c_mktsegment || '"'}, {'key': 'nation', 'value': c_nationkey::VARCHAR},
          {'key': 'safe_mode', 'value': CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END},
          {'key': 'extensions', 'value': '[".py","' || c_mktsegment || '"]'}, {'key': 'template', 'value': 'null'}]) AS s
        FROM customer),
      new AS (
        SELECT 'profile-' || p_partkey * 3 AS name, unnest([
          {'key': 'segment', 'value': '"' || p_type || '"'}, {'key': 'size', 'value': p_size::VARCHAR},
          {'key': 'limits', 'value': '[' || p_size || ',' || p_partkey || ']'}]) AS s FROM part)
      SELECT name, s.key AS key, s.value AS value FROM (
        SELECT * FROM old WHERE name NOT IN (SELECT name FROM new) UNION ALL SELECT * FROM new)""",
    "read_files_decode": f"""WITH written AS (
        SELECT coalesce(lang, 'none') AS lang, (strlen(coalesce(text, '')) + 17)::BIGINT AS length,
          coalesce(text, '') || ' café' || {NL} || 'end' || {NL} AS t FROM documents)
      SELECT bundle, lang, length, CASE WHEN length / 1024 > 4 THEN 'filtered by size/date criteria' END AS reason,
        CASE WHEN length / 1024 <= 4 THEN md5(t) END AS text_md5
      FROM written, (VALUES ('all'), ('top')) AS sources(bundle) WHERE bundle = 'all' OR lang = 'en'""",
    "sink_roundtrip": f"""{TEXTS}, numbered AS (
        SELECT bundle, unnest(string_split(t, {NL})) AS line, unnest(range(1, len(string_split(t, {NL})) + 1)) AS i,
          len(string_split(t, {NL})) AS n FROM texts)
      SELECT bundle || '_20240601_120000.txt' AS bundle_file, sum(length(line) + 1)::BIGINT AS chars,
        count(*) AS newlines, sum(('0x' || substr(md5(line), 1, 7))::BIGINT * i % 1000003)::BIGINT AS line_order
      FROM numbered WHERE i < n GROUP BY bundle""",
}
