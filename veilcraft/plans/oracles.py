"""The catalog's queries as plain SQL, for checking results side by side."""

from __future__ import annotations

from veilcraft.plans import catalog
from veilcraft.plans.known import NATION_TOKENS, REGION_TOKENS
from veilcraft.functions import names


def _text(value: str) -> str:
    """A SQL string literal; line breaks and tabs as characters of their own."""
    quoted = "'" + value.replace("'", "''") + "'"
    for char in "\n\t":
        quoted = quoted.replace(char, f"' || chr({ord(char)}) || '")
    return f"({quoted})" if "chr(" in quoted else quoted


def _updated(text: str, rules) -> str:
    for find, put in rules:
        text = f"replace({text}, {_text(find)}, {_text(put)})"
    return text


def _matches(text: str, rules) -> str:
    counts = []
    for i, (find, _) in enumerate(rules):
        before = _updated(text, rules[:i])
        counts.append(f"(length({before}) - length(replace({before}, {_text(find)}, ''))) // {len(find)}")
    return f"CAST({' + '.join(counts)} AS BIGINT)"


def _sheet(index: int, name: str, title: str, headers: list[str], source: str, key: str, values: list[str]) -> str:
    top = [(1, "A", title)] + [(2, chr(65 + i), h) for i, h in enumerate(headers)]
    head = ", ".join(f"({r}, '{c}', {_text(v)})" for r, c, v in top)
    body = " UNION ALL ".join(
        f"SELECT {key} + 3, '{chr(65 + i)}', CAST({v} AS VARCHAR) FROM {source}" for i, v in enumerate(values)
    )
    return (
        f"SELECT {index} AS sheet_index, '{name}' AS sheet_name, r AS \"row\", c AS col, v AS value FROM ("
        f"SELECT * FROM (VALUES {head}) AS h(r, c, v) UNION ALL {body}) AS t(r, c, v)"
    )


PARTY_CELLS = (
    "cells AS ("
    + _sheet(0, "Customers", "Customer Export",
             ["Customer Key", "Customer Name", "Nation", "Account Balance", "Market Segment"],
             "customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    + " UNION ALL "
    + _sheet(1, "Suppliers", "Supplier Export", ["Supplier Key", "Supplier Name", "Nation", "Balance"],
             "supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    + ")"
)

_NUMERIC = (
    "regexp_full_match(replace(replace(replace(regexp_replace(trim({0}), '^\\((.*)\\)$', '\\1'), ',', ''), '.', ''), ' ', ''),"
    " '[+-]*[0-9]+')"
)


def _score(value: str) -> str:
    text = f"trim({value})"
    return (
        f"CASE WHEN {text} = '' THEN 0 WHEN {_NUMERIC.format(value)} THEN -4 ELSE"
        f" CASE WHEN length({text}) <= 2 THEN -1 ELSE 0 END"
        f" + CASE WHEN regexp_matches({text}, '[A-Za-z]{{3,}}') THEN 4 ELSE 0 END"
        f" + CASE WHEN contains({text}, ' ') THEN 1 ELSE 0 END END"
    )


SCORES = (
    "scores AS (SELECT sheet_index, sheet_name, \"row\", COUNT(*) AS n_cells,"
    f" CAST(SUM({_score('value')}) + COUNT(*) AS BIGINT) AS score"
    " FROM cells WHERE \"row\" <= 10 AND value <> '' GROUP BY ALL)"
)
PICK = (
    "pick AS (SELECT s.sheet_index, s.sheet_name, COALESCE(b.\"row\", s.first_row) AS header_row FROM"
    " (SELECT sheet_index, sheet_name, MIN(\"row\") AS first_row FROM cells WHERE value <> '' GROUP BY ALL) s"
    " LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sheet_index ORDER BY score DESC, n_cells DESC, \"row\") AS k"
    " FROM scores WHERE n_cells > 1) b ON b.sheet_index = s.sheet_index AND b.k = 1)"
)


def _slug(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', '-', 'g'), '-')"


FOUND = (
    "found AS (SELECT c.sheet_index, c.sheet_name, c.col, COALESCE(MAX(CASE WHEN c.\"row\" = p.header_row THEN c.value END),"
    " 'Column ' || c.col) AS header, p.header_row + 1 AS start_row, c.sheet_index || '|' || c.col AS key"
    " FROM cells c JOIN pick p USING (sheet_index) WHERE c.value <> ''"
    " GROUP BY c.sheet_index, c.sheet_name, c.col, p.header_row)"
)
DISCOVER = f"WITH {PARTY_CELLS}, {SCORES}, {PICK}, {FOUND}"
_KEYS = "('" + "', '".join(catalog.PARTY_KEYS) + "')"
_FOUND_COLUMNS = f"sheet_index, col, header, start_row, key, {_slug('header')} AS namespace"


def _eligible(cells: str = "cells", rules=()) -> str:
    """Data rows of the selected columns; rules apply to the values and leave the headers alone."""
    value = _updated("c.value", rules)
    return (
        f"rows_ AS (SELECT c.sheet_index, c.sheet_name, c.\"row\", c.col, f.header, {_slug('f.header')} AS namespace,"
        f" {value} AS value FROM {cells} c JOIN found f USING (sheet_index, col)"
        f" WHERE f.key IN {_KEYS} AND c.\"row\" >= f.start_row AND c.value <> ''"
        " AND lower(trim(c.value)) NOT IN ('', '(blank)', 'grand total', 'total'))"
    )


LINES = (
    "lines AS (SELECT p_brand AS file_path, l_orderkey + 1 AS \"row\", chr(CAST(64 + l_linenumber AS INTEGER)) AS col,"
    " CASE WHEN l_linenumber = 1 THEN l_partkey END AS old_index, CASE WHEN l_linenumber = 1 THEN p_name ELSE l_linestatus END AS value"
    " FROM lineitem JOIN part ON l_partkey = p_partkey)"
)
REBUILT = (
    "rebuilt AS (SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY old_index) - 1 AS ss_index,"
    " old_index, value, uses FROM (SELECT file_path, old_index, value, COUNT(*) AS uses FROM lines"
    " WHERE old_index IS NOT NULL GROUP BY ALL))"
)

NUMBER_TEXTS = (
    "texts AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN ' (' || p || ') ' WHEN 2 THEN '+-' || p"
    " WHEN 3 THEN p || ' ' || l_returnflag WHEN 4 THEN p || 'e5' WHEN 5 THEN '1_' || l_partkey WHEN 6 THEN '0x' || l_partkey"
    " ELSE ' ' || p END AS text FROM (SELECT *, CAST(l_extendedprice AS VARCHAR) AS p FROM lineitem))"
)
TOKEN_LIKE = (
    "likes AS (SELECT doc_id, CASE WHEN lang = 'de' THEN upper(source) ELSE source END AS space,"
    " CASE WHEN lang = 'fr' THEN '::' ELSE ':' END AS sep,"
    " left(md5(text) || '_-', CAST(n_chars % 20 + 16 AS INTEGER)) AS body FROM documents)"
)
_IS_TOKEN = "(sep = ':' AND space = lower(space) AND length(body) >= 22 AND length(body) % 4 <> 1)"
FILE_NAMES = (
    "named AS (SELECT page_id, mode, parse_filename(url || CASE WHEN url LIKE 'https%' THEN '.Encrypted.XLSX'"
    " WHEN contains(url, '?') THEN '.docx' ELSE '' END, false, 'forward_slash') AS base FROM pages,"
    " (VALUES ('encrypt'), ('decrypt'), ('replace')) AS m(mode))"
)
_SUFFIX = "lower(regexp_extract(base, '^.+(\\.[^.]+)$', 1))"


def _public_message(message: str, mode: str) -> str:
    cases = []
    for fragments, shown in names.PUBLIC_MESSAGES:
        test = " OR ".join(f"contains(lower({message}), '{f}')" for f in fragments)
        answer = _text(shown)
        if "no values were found" in fragments:
            answer = f"CASE WHEN {mode} = 'decrypt' THEN {_text(names.NOTHING_TO_DECRYPT)} ELSE {answer} END"
        if fragments == ["replacement"]:
            answer = f"CASE WHEN contains(lower({message}), 'pymupdf') THEN {_text(names.PDF_LIBRARY_MISSING)} ELSE {answer} END"
        cases.append(f"WHEN {test} THEN {answer}")
    return f"CASE {' '.join(cases)} ELSE {_text(names.DEFAULT_MESSAGE)} END"


def _token_chars(size: str, namespace: str) -> str:
    return f"CAST({len(namespace) + 1} + ceil(({size} + 16) * 4 / 3.0) AS BIGINT)"


def _two_passes(rows: str, key: str, rules, sep: str, name: str) -> str:
    """``rows`` gives ``key`` and the list ``runs``."""
    first = f"list_transform(runs, lambda x: {_updated('x', rules)})"
    return (
        f"SELECT {key}, CASE WHEN n2 > 0 AND after <> whole THEN after || repeat({sep}, len(runs) - 1)"
        f" ELSE array_to_string(done, {sep}) END AS text, CAST(n1 + CASE WHEN after <> whole THEN n2 ELSE 0 END AS BIGINT) AS {name}"
        f" FROM (SELECT *, {_updated('whole', rules)} AS after, {_matches('whole', rules)} AS n2 FROM"
        f" (SELECT *, array_to_string(done, '') AS whole FROM (SELECT {key}, runs, {first} AS done,"
        f" list_sum(list_transform(runs, lambda x: {_matches('x', rules)})) AS n1 FROM ({rows}))))"
    )


def _totals(rows: str, error: str) -> str:
    return (
        f"SELECT doc, replacements, CASE WHEN replacements = 0 THEN '{error}' END AS error FROM ({rows})"
    )


def _hits(rules) -> str:
    spans = (
        "SELECT doc_id AS doc, CAST(i - 1 AS INTEGER) AS span_id, lines[i] AS text FROM (SELECT doc_id, lines,"
        " unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"
        " WHERE lines[i] <> ''"
    )
    table = ", ".join(f"({i}, {_text(f.lower())}, {_text(p)})" for i, (f, p) in enumerate(rules))
    pieces = f"SELECT *, string_split(lower(text), find) AS pieces FROM ({spans}) s, (VALUES {table}) AS r(rule_id, find, put)"
    each = f"SELECT *, unnest(range(1, len(pieces))) AS k FROM ({pieces})"
    return (
        "SELECT *, list_sum(list_transform(pieces[1:k], lambda x: length(x))) + (k - 1) * length(find) AS start"
        f" FROM ({each})"
    )


BOXES = (
    "line AS (SELECT l_orderkey AS page, l_linenumber AS ln, l_partkey AS pk, l_quantity AS q, l_suppkey AS sk, row_number() OVER (PARTITION BY"
    " l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS id FROM lineitem),"
    " spans AS (SELECT page, id AS span_id, pk % 300 AS x0, ln * 12 AS y0, pk % 300 + 60 + q AS x1, ln * 12 + 14 AS y1,"
    " CASE WHEN q > 10 THEN q * 2 ELSE 0 END AS size, CASE WHEN sk % 3 > 0 THEN pk * 977 END AS color,"
    " CASE sk % 4 WHEN 0 THEN 'cour' WHEN 1 THEN 'tiro' WHEN 2 THEN 'zadb' ELSE 'helv' END AS font,"
    " CASE WHEN q > 25 THEN ln * 12 + 11 END AS origin_y FROM line),"
    " hits AS (SELECT page, id AS hit_id, pk * 7 % 300 AS x0, ln * 10 + 3 AS y0, pk * 7 % 300 + 50 AS x1, ln * 10 + 7 + q AS y1 FROM line),"
    " best AS (SELECT h.page, h.hit_id, s.span_id, s.size, s.color, s.font, s.origin_y, row_number() OVER (PARTITION BY h.page, h.hit_id"
    " ORDER BY (least(h.x1, s.x1) - greatest(h.x0, s.x0)) * (least(h.y1, s.y1) - greatest(h.y0, s.y0)) DESC, s.span_id) AS k"
    " FROM hits h JOIN spans s ON h.page = s.page AND h.x0 < s.x1 AND s.x0 < h.x1 AND h.y0 < s.y1 AND s.y0 < h.y1)"
)
_FALLBACK = "greatest(4.0, least(72.0, CAST(y1 - y0 AS DOUBLE) * CAST(0.78 AS DOUBLE)))"
_PARTS = (
    "parts AS (SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS file_path, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS part,"
    " CASE WHEN contains(url, '#') THEN 1 ELSE 0 END AS flag, length(html) AS size FROM pages)"
)
_JSON_RULES = (
    "raw AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'decrypt' ELSE 'replace' END AS mode, CASE c_mktsegment"
    " WHEN 'MACHINERY' THEN q || ']' WHEN 'FURNITURE' THEN q || ', {\"find\": \"\", \"replace\": \"x\"}]'"
    " WHEN 'HOUSEHOLD' THEN q || ', {\"find\": \"a\", \"replace\": 1}]' WHEN 'BUILDING' THEN q"
    " ELSE q || ', {}, {\"find\": \"b\", \"replace\": \"b \"}]' END AS raw FROM (SELECT *, '[{\"find\": \" ' || c_name ||"
    " '\", \"replace\": \"CLIENT_' || c_custkey || '\"}' AS q FROM customer)),"
    " items AS (SELECT c_custkey, mode, raw, CASE WHEN json_valid(raw) THEN json_extract(raw, '$[*]') END AS items FROM raw),"
    " judged AS (SELECT *, CASE WHEN items IS NULL THEN 'Find and replace rules could not be read'"
    " WHEN len(list_filter(items, lambda x: coalesce(json_type(x, '$.find'), 'VARCHAR') <> 'VARCHAR'"
    " OR coalesce(json_type(x, '$.replace'), 'VARCHAR') <> 'VARCHAR')) > 0 THEN 'Find and replace rules could not be read'"
    " WHEN len(list_filter(items, lambda x: coalesce(trim(x->>'$.find'), '') = '' AND coalesce(trim(x->>'$.replace'), '') <> '')) > 0"
    " THEN 'Each replacement needs a sensitive value and a safe label' END AS error,"
    " list_filter(items, lambda x: coalesce(trim(x->>'$.find'), '') <> coalesce(trim(x->>'$.replace'), '')) AS kept FROM items)"
)

ORACLES: dict[str, str] = {
    "replace_documents": f"SELECT doc_id, {_updated('text', catalog.TEXT_RULES)} AS text,"
    f" {_matches('text', catalog.TEXT_RULES)} AS replacements FROM documents",
    "replace_customer_columns": f"SELECT c_custkey, {_updated('c_name', catalog.PARTY_RULES)} AS c_name,"
    f" {_updated('c_mktsegment', catalog.PARTY_RULES)} AS c_mktsegment, {_matches('c_name', catalog.PARTY_RULES)}"
    f" + {_matches('c_mktsegment', catalog.PARTY_RULES)} AS replacements FROM customer",
    "replace_cells_total": f"WITH {PARTY_CELLS} SELECT CAST(SUM({_matches('value', catalog.PARTY_RULES)}) AS BIGINT) AS replacements FROM cells",
    "replace_by_rule_column": "WITH a AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS f, p_name, p_brand, p_size FROM part),"
    " b AS (SELECT *, replace(p_name, f, p_brand) AS t, (length(p_name) - length(replace(p_name, f, ''))) // length(f) AS n1 FROM a)"
    " SELECT p_partkey, replace(t, 'Brand#', CAST(p_size AS VARCHAR)) AS text,"
    " CAST(n1 + (length(t) - length(replace(t, 'Brand#', ''))) // 6 AS BIGINT) AS n FROM b",
    "paragraph_replace": _two_passes(
        "SELECT doc_id AS doc, string_split(text, chr(10)) AS runs FROM documents", "doc", catalog.LINE_RULES, "chr(10)", "replacements"
    ),
    "paragraph_replace_runs": _two_passes(
        "SELECT conv_id AS para_index, list(text ORDER BY turn) AS runs FROM conversations GROUP BY conv_id",
        "para_index", catalog.TURN_RULES, "'|'", "replacements",
    ),
    "document_totals": _totals(
        _two_passes(
            "SELECT doc_id AS doc, string_split(text, chr(10)) AS runs FROM documents", "doc",
            [("nicht", "NOT"), ("dans", "IN")], "chr(10)", "replacements",
        ),
        "No replacement values were found in the document",
    ),
    "rules_from_json": f"WITH {_JSON_RULES} SELECT c_custkey, CASE WHEN mode = 'decrypt' THEN 0 WHEN error IS NULL THEN len(kept) END AS n_rules,"
    " CASE WHEN mode = 'replace' AND error IS NULL THEN trim(kept[1]->>'$.find') END AS find,"
    " CASE WHEN mode = 'replace' AND error IS NULL THEN trim(kept[1]->>'$.replace') END AS put,"
    " CASE WHEN mode = 'replace' THEN error END AS error FROM judged",
    "columns_from_json": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN array_to_string(list_sort(list_distinct([o_custkey || '|B', '0|A'])), ',') END AS keys,"
    " CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'Selected columns could not be read' ELSE 'Select at least one column to encrypt' END AS error FROM orders",
    "slug_headers": "SELECT p_partkey, " + _slug("' ' || p_name || ' / ' || p_brand || ' (' || p_type || ')!'") + " AS slug FROM part",
    "normalize_labels": "SELECT p_partkey, trim(regexp_replace(lower('--' || p_brand || '__ ' || upper(p_name) || '?'), '[^a-z0-9]+', ' ', 'g')) AS label FROM part",
    "numeric_look": f"WITH {NUMBER_TEXTS} SELECT l_orderkey, l_linenumber, text, CAST({_NUMERIC.format('text')} AS INTEGER) AS is_numeric FROM texts",
    "restore_types": f"WITH {NUMBER_TEXTS} SELECT l_orderkey, l_linenumber, text, CASE WHEN regexp_full_match(trim(text),"
    " '[+-]?[0-9]+(_[0-9]+)*([.][0-9]*)?([eE][+-]?[0-9]+)?') THEN 'n' ELSE 'inlineStr' END AS cell_type FROM texts",
    "skip_values": "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 1 ELSE 0 END AS skipped FROM orders",
    "token_test": f"WITH {TOKEN_LIKE} SELECT doc_id, CAST({_IS_TOKEN} AS INTEGER) AS is_token FROM likes",
    "token_split": f"WITH {TOKEN_LIKE} SELECT doc_id, CASE WHEN {_IS_TOKEN} THEN space END AS namespace,"
    f" CASE WHEN {_IS_TOKEN} THEN body END AS ciphertext FROM likes",
    "b64url_roundtrip": "SELECT doc_id, rtrim(translate(to_base64(encode(text)), '+/', '-_'), '=') AS coded, text FROM documents",
    "cell_references": "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber < 7 THEN chr(CAST(65 + l_suppkey % 26 AS INTEGER))"
    " || chr(CAST(64 + l_linenumber AS INTEGER)) END AS col, CASE WHEN l_linenumber < 7 THEN l_orderkey END AS \"row\","
    " CASE WHEN l_linenumber < 7 THEN CAST((l_suppkey % 26 + 1) * 26 + l_linenumber AS BIGINT) END AS col_ord FROM lineitem",
    "column_keys": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS INTEGER) END AS sheet_index,"
    " CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS col FROM orders",
    "target_paths": "SELECT page_id, CASE WHEN url LIKE 'https%' THEN ltrim(p, '/') ELSE 'xl' || rtrim(p, '/') END AS target,"
    " regexp_replace(substr(p, 2), '([^/]*)$', '_rels/\\1.rels') AS rels"
    " FROM (SELECT *, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) AS p FROM pages)",
    "document_parts": "SELECT event_id, CAST(event_type IN ('click', 'view', 'error') AND value > 20 AS INTEGER) AS kept FROM events",
    "header_scores": f"WITH {PARTY_CELLS}, {SCORES} SELECT sheet_index, \"row\", n_cells, score FROM scores",
    "header_pick": f"WITH {PARTY_CELLS}, {SCORES}, {PICK} SELECT sheet_index, sheet_name, header_row FROM pick",
    "discover_columns": f"{DISCOVER} SELECT {_FOUND_COLUMNS} FROM found",
    "describe_sheets": f"{DISCOVER} SELECT sheet_name, string_agg(key || '=' || {_slug('header')} || '=' || sheet_name || ': ' || header, ';'"
    " ORDER BY length(col), col) AS columns FROM found GROUP BY sheet_name",
    "select_columns": f"{DISCOVER} SELECT {_FOUND_COLUMNS} FROM found WHERE key IN {_KEYS}",
    "data_rows": f"{DISCOVER}, {_eligible()} SELECT sheet_index, \"row\", col, namespace, value FROM rows_",
    "encrypt_roundtrip": "SELECT c_custkey, c_name, 'c-name' AS namespace, "
    + _token_chars("strlen(c_name)", "c-name") + " AS token_chars FROM customer",
    "encrypt_documents_roundtrip": "SELECT doc_id, text, " + _token_chars("strlen(text)", "text") + " AS token_chars FROM documents",
    "encrypt_group_counts": "SELECT COUNT(*) AS n FROM orders GROUP BY o_orderpriority",
    "encrypt_join": "SELECT c_mktsegment, o_orderstatus, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "encrypt_tampered": "SELECT c_mktsegment, COUNT(*) AS n, CAST(0 AS BIGINT) AS wrong FROM customer GROUP BY ALL",
    "namespaces_separate": "SELECT p_brand, CAST(1 AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS shared, COUNT(*) AS n FROM part GROUP BY ALL",
    "scrub_counts": f"{DISCOVER}, {_eligible(rules=catalog.PARTY_RULES)} SELECT namespace, COUNT(*) AS n FROM rows_ GROUP BY ALL",
    "scrub_columns": f"{DISCOVER}, {_eligible(rules=catalog.PARTY_RULES)} SELECT sheet_name, col, header, MIN(\"row\") AS first_row, COUNT(*) AS n FROM rows_ GROUP BY ALL",
    "headers_by_sheet": f"{DISCOVER}, {_eligible()} SELECT sheet_name, string_agg(header, ';' ORDER BY r, col) AS headers FROM"
    " (SELECT sheet_name, col, header, MIN(\"row\") AS r FROM rows_ GROUP BY ALL) GROUP BY sheet_name",
    "scrub_roundtrip": f"WITH {PARTY_CELLS} SELECT sheet_index, \"row\", col, CASE WHEN \"row\" <= 2 OR sheet_index || '|' || col IN {_KEYS}"
    f" THEN 'inlineStr' END AS cell_type, {_updated('value', catalog.PARTY_RULES)} AS value FROM cells",
    "double_encryption_report": f"WITH {TOKEN_LIKE} SELECT space AS source, CAST(SUM(CASE WHEN {_IS_TOKEN} THEN 1 ELSE 0 END) AS BIGINT) AS refused FROM likes GROUP BY ALL",
    "dictionary_decode": f"WITH {LINES} SELECT file_path, col, value, COUNT(*) AS n FROM lines GROUP BY ALL",
    "dictionary_rebuild": f"WITH {LINES}, {REBUILT} SELECT file_path, ss_index, old_index, value, uses FROM rebuilt",
    "dictionary_remap": f"WITH {LINES}, {REBUILT} SELECT l.file_path, l.\"row\", l.col, r.ss_index, l.value FROM lines l"
    " LEFT JOIN rebuilt r ON l.file_path = r.file_path AND l.old_index = r.old_index",
    "dictionary_counts": f"WITH {LINES}, {REBUILT} SELECT file_path, CAST(SUM(uses) AS BIGINT) AS count, COUNT(*) AS unique_count FROM rebuilt GROUP BY ALL",
    "dictionary_replace_counts": "WITH s AS (SELECT p_brand AS file_path, p_partkey AS ss_index, split_part(p_name, ' ', 1) || ' ' AS a,"
    " split_part(p_name, ' ', 2) AS b FROM part) SELECT file_path, ss_index, "
    + _updated("a", catalog.PART_RULES) + " || " + _updated("b", catalog.PART_RULES) + " AS value, "
    + _matches("a", catalog.PART_RULES) + " + " + _matches("b", catalog.PART_RULES) + " AS replacements FROM s",
    "dictionary_dangling": "SELECT DISTINCT p_brand AS file_path, p_partkey AS ss_index, 'Shared-string cell index is out of range' AS error"
    " FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 AND p_type = 'SMALL'",
    "dictionary_decrypt": "SELECT p_partkey AS ss_index, p_name || split_part(p_name, ' ', 2) AS value, 'first,second' AS namespaces FROM part",
    "pivot_field_match": "SELECT 0 AS field_index, 'order-status' AS namespace, COUNT(DISTINCT o_orderstatus) AS n_items, '1' AS contains_string,"
    " CAST(NULL AS VARCHAR) AS contains_number FROM orders UNION ALL"
    " SELECT 1, 'order-priority', COUNT(DISTINCT o_orderpriority), '1', NULL FROM orders",
    "pivot_encrypt_roundtrip": "SELECT o_orderkey AS \"row\", 0 AS field_index, 's' AS tag, CASE WHEN o_orderstatus = 'P' THEN ' Total' ELSE o_orderstatus END AS v,"
    " CASE WHEN o_orderstatus <> 'P' THEN 'order-status' END AS namespace FROM orders UNION ALL"
    " SELECT o_orderkey, 1, 'x', left(o_orderpriority, 1), NULL FROM orders UNION ALL"
    " SELECT o_orderkey, 2, 'n', CAST(o_totalprice AS VARCHAR), NULL FROM orders",
    "pivot_counts": "SELECT 'pivot-order-status' AS namespace, COUNT(DISTINCT o_orderstatus) AS n FROM orders UNION ALL"
    " SELECT 'pivot-order-priority', COUNT(DISTINCT o_orderpriority) FROM orders UNION ALL"
    " SELECT 'pivot-record-order-status', COUNT(*) FROM orders WHERE o_orderstatus <> 'P'",
    "pivot_replace": "SELECT \"row\", field_index, " + _updated("v", [("Total", "Sum"), (".", ","), ("F", "Filled")]) + " AS v, "
    + _matches("v", [("Total", "Sum"), (".", ","), ("F", "Filled")]) + " AS replacements FROM ("
    "SELECT o_orderkey AS \"row\", 0 AS field_index, CASE WHEN o_orderstatus = 'P' THEN ' Total' ELSE o_orderstatus END AS v FROM orders"
    " UNION ALL SELECT o_orderkey, 1, left(o_orderpriority, 1) FROM orders UNION ALL SELECT o_orderkey, 2, CAST(o_totalprice AS VARCHAR) FROM orders)",
    "overlay_style": f"WITH {BOXES} SELECT page, hit_id, span_id, font_size, red, green, blue, font, CAST(COALESCE(origin_y,"
    " y1 - greatest(0.0, (y1 - y0 - font_size) / 2)) AS DOUBLE) AS baseline FROM (SELECT h.page, h.hit_id, h.y0, h.y1, b.span_id, b.origin_y,"
    f" CASE WHEN b.span_id IS NULL THEN {_FALLBACK} ELSE greatest(4.0, least(72.0, COALESCE(NULLIF(CAST(b.size AS DOUBLE), 0), {_FALLBACK}))) END AS font_size,"
    " COALESCE(((b.color >> 16) & 255) / 255.0::DOUBLE, 0) AS red, COALESCE(((b.color >> 8) & 255) / 255.0::DOUBLE, 0) AS green,"
    " COALESCE((b.color & 255) / 255.0::DOUBLE, 0) AS blue, COALESCE(b.font, 'helv') AS font"
    " FROM hits h LEFT JOIN best b ON h.page = b.page AND h.hit_id = b.hit_id AND b.k = 1)",
    "pdf_hits": "SELECT doc, span_id, rule_id, CAST(k - 1 AS INTEGER) AS hit_no, CAST(start AS INTEGER) AS start, put AS \"replace\","
    " CAST(start * 6 AS DOUBLE) AS x0, CAST((start + length(find)) * 6 AS DOUBLE) AS x1 FROM (" + _hits(catalog.HIT_RULES) + ")",
    "pdf_hits_across_spans": "SELECT doc, span_id * 100000 - j AS span_id, rule_id, CAST(k - 1 AS INTEGER) AS hit_no, CAST(j - start // 3 AS INTEGER) AS part,"
    " CAST(greatest(start - 3 * j, 0) AS INTEGER) AS start, CASE WHEN j = start // 3 THEN put ELSE '' END AS \"replace\","
    " CAST(greatest(start, 3 * j) * 6 AS DOUBLE) AS x0, CAST(least(start + length(find), 3 * j + 3) * 6 AS DOUBLE) AS x1"
    " FROM (SELECT *, unnest(range(start::BIGINT // 3, (start::BIGINT + length(find) - 1) // 3 + 1)) AS j FROM (" + _hits(catalog.HIT_RULES) + "))",
    "pdf_totals": _totals(
        "SELECT d.doc_id AS doc, COUNT(h.doc) AS replacements FROM documents d LEFT JOIN ("
        + _hits([("nicht", "n"), ("DANS", "d")]) + ") h ON h.doc = d.doc_id GROUP BY d.doc_id",
        "No replacement values were found in the PDF",
    ),
    "span_colors": "SELECT l_orderkey, l_linenumber, l_partkey, ((l_partkey * 977 >> 16) & 255) / 255.0::DOUBLE AS red,"
    " ((l_partkey * 977 >> 8) & 255) / 255.0::DOUBLE AS green, ((l_partkey * 977) & 255) / 255.0::DOUBLE AS blue FROM lineitem",
    "package_gate": f"WITH {_PARTS} SELECT file_path, COUNT(*) AS members, CAST(SUM(size) AS BIGINT) AS total_size,"
    " CASE WHEN COUNT(*) > 8 THEN 'Workbook contains too many package members' WHEN MAX(flag) = 1 THEN 'Password-protected XLSX packages are not supported'"
    " WHEN SUM(size) > 60000 THEN 'Workbook expands beyond the safe processing limit'"
    " WHEN COUNT(DISTINCT CASE WHEN part IN ('en', 'fr') THEN part END) < 2 THEN 'Input is not a valid XLSX workbook package' END AS error FROM parts GROUP BY file_path",
    "missing_parts": f"WITH {_PARTS} SELECT file_path, part FROM (SELECT DISTINCT file_path FROM parts), (VALUES ('en'), ('fr')) AS w(part)"
    " EXCEPT SELECT file_path, part FROM parts",
    "upload_gate": "SELECT page_id, CASE WHEN length(html) > 10000 THEN 'File exceeds the 25 MiB upload limit' END AS error,"
    " CAST(CASE WHEN length(html) > 12000 THEN 413 ELSE 200 END AS BIGINT) AS status FROM pages",
    "classify_errors": "SELECT event_id, " + _public_message("message", "mode") + " AS shown FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'decrypt'"
    " WHEN 'click' THEN 'replace' ELSE 'encrypt' END AS mode, [" + ", ".join(_text(m) for m in catalog.LOGGED)
    + f"][event_id % {len(catalog.LOGGED)} + 1] AS message FROM events)",
    "output_names": f"WITH {FILE_NAMES}, stems AS (SELECT *, {_SUFFIX} AS own, left(trim(regexp_replace(regexp_replace(base, '^(.+)\\.[^.]+$', '\\1'),"
    " '[^A-Za-z0-9 ._-]+', '_', 'g'), ' .'), 120) AS raw FROM named),"
    " filled AS (SELECT *, CASE WHEN raw <> '' THEN raw WHEN mode = 'replace' THEN 'document' ELSE 'workbook' END AS stem FROM stems)"
    " SELECT page_id, mode, CASE mode WHEN 'encrypt' THEN stem || '.encrypted.xlsx' WHEN 'replace' THEN stem || '.replaced' ||"
    " CASE WHEN own IN ('.xlsx', '.docx', '.pdf') THEN own ELSE '.xlsx' END ELSE"
    " COALESCE(NULLIF(trim(regexp_replace(stem, '\\.encrypted', '', 'gi'), ' .'), ''), 'workbook') || '_restored.xlsx' END AS output FROM filled",
    "format_dispatch": f"WITH {FILE_NAMES} SELECT page_id, mode, CAST(CASE WHEN mode = 'replace' THEN {_SUFFIX} IN ('.xlsx', '.docx', '.pdf')"
    f" ELSE {_SUFFIX} = '.xlsx' END AS INTEGER) AS supported FROM named",
    "expired_jobs": f"SELECT event_id AS token FROM events WHERE ts < TIMESTAMP '{catalog.AS_OF}' - INTERVAL 900 SECONDS",
    "first_redemption": "SELECT user_id AS token, arg_min(event_id, (ts, event_id)) AS redemption_id, COUNT(*) - 1 AS refused FROM events GROUP BY user_id",
    "expired_jobs_stream": "SELECT event_id AS token FROM events"
    " WHERE ts + CASE WHEN event_type = 'view' THEN INTERVAL 10 YEARS ELSE INTERVAL 0 YEARS END < CAST(now() AS TIMESTAMP) - INTERVAL 900 SECONDS",
}
ORACLES["encrypt_line_refs"] = (
    "SELECT l_returnflag, COUNT(*) AS n, COUNT(DISTINCT l_orderkey || '-' || l_partkey || '-' || l_linenumber) AS tokens"
    " FROM lineitem GROUP BY l_returnflag"
)
ORACLES["client_rules_from_json"] = (
    "SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN 0 ELSE 1 END AS BIGINT) AS n_rules,"
    " CASE WHEN c_mktsegment = 'BUILDING' THEN 'Each replacement row needs both a sensitive value and a safe label.' END AS error FROM customer"
)
_BOOK = "'book-' || (c_custkey // 50) || '.xlsx' AS file_path"
ORACLES["package_cells"] = (
    f"SELECT {_BOOK}, 0 AS sheet_index, 'Main' AS sheet_name, c_custkey % 50 + 1 AS \"row\", k.col, k.cell_type,"
    " CASE k.col WHEN 'A' THEN c_name WHEN 'B' THEN c_mktsegment ELSE CAST(c_acctbal AS VARCHAR) END AS value"
    " FROM customer, (VALUES ('A', 's'), ('B', 'inlineStr'), ('C', NULL)) AS k(col, cell_type)"
)
ORACLES["package_members"] = ORACLES["package_cells"]
ORACLES["package_sheets"] = (
    f"SELECT DISTINCT {_BOOK}, 'Main' AS sheet_name, 'xl/worksheets/main.xml' AS part, CAST(NULL AS VARCHAR) AS error FROM customer"
)
ORACLES["package_pivots"] = (
    f"SELECT {_BOOK}, c_custkey % 50 AS \"row\", f.i AS field_index, f.tag, CASE f.i WHEN 0 THEN c_mktsegment ELSE CAST(c_acctbal AS VARCHAR) END AS v"
    " FROM customer, (VALUES (0, 'x'), (1, 'n')) AS f(i, tag)"
)
ORACLES["package_documents"] = (
    "SELECT doc_id || '.docx' AS doc, part, 0 AS para_index, text, replacements FROM (SELECT *, 'word/document.xml' AS part FROM ("
    + _two_passes("SELECT doc_id, string_split(text, chr(10)) AS runs FROM documents", "doc_id", catalog.LINE_RULES, "chr(10)", "replacements")
    + ") UNION ALL SELECT *, 'word/header1.xml' AS part FROM ("
    + _two_passes("SELECT doc_id, ['Document ', CAST(doc_id AS VARCHAR)] AS runs FROM documents", "doc_id", catalog.LINE_RULES, "chr(10)", "replacements")
    + "))"
)
ORACLES["package_pivot_groups"] = (
    f"SELECT {_BOOK}, c_custkey % 50 AS ordinal, 's' AS tag, replace(c_name, 'Customer#', 'CLIENT_') AS v FROM customer"
)
ORACLES["scrub_errors"] = (
    "SELECT 'book-' || b AS file_path, CASE WHEN b % 3 = 0 OR NOT hit THEN n END AS tokens, CASE WHEN b % 3 = 1 AND hit THEN 'Invalid shared-string index in cell A9'"
    " WHEN b % 3 = 2 AND hit THEN 'Input already contains an encrypted value' END AS error FROM (SELECT c_custkey // 50 AS b, COUNT(*) AS n,"
    " bool_or(CASE (c_custkey // 50) % 3 WHEN 1 THEN c_custkey % 50 = 7 WHEN 2 THEN c_custkey % 50 = 9 ELSE false END) AS hit FROM customer GROUP BY 1)"
)
_USES = (
    "WITH made AS (SELECT event_id AS token, ts AS created_at FROM events WHERE event_type = 'signup'),"
    " used AS (SELECT event_id - event_id % 4 AS token, event_id AS redemption_id, ts AS redeemed_at FROM events WHERE event_type <> 'signup'),"
    " met AS (SELECT used.*, made.created_at FROM used LEFT JOIN made ON made.token = used.token"
    " AND redeemed_at BETWEEN created_at AND created_at + INTERVAL 900 SECONDS)"
)
ORACLES["rules_with_repeated_keys"] = (
    "SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'HOUSEHOLD' THEN 0 ELSE 1 END AS BIGINT) AS n_rules,"
    " CASE WHEN c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD') THEN c_name END AS find,"
    " CASE WHEN c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD') THEN 'CLIENT_' || c_custkey END AS put,"
    " CASE WHEN c_mktsegment = 'BUILDING' THEN 'Find and replace rules could not be read' END AS error FROM customer"
)
ORACLES["replace_only_cells"] = (
    f"WITH {PARTY_CELLS} SELECT sheet_index, \"row\", col, {_updated('value', catalog.PARTY_RULES)} AS value,"
    f" CAST(SUM({_matches('value', catalog.PARTY_RULES)}) OVER () AS BIGINT) AS replacements FROM cells"
)
ORACLES["inactive_rules"] = (
    "SELECT doc_id, replace(text, 'a', 'b') AS text, CAST(length(text) - length(replace(text, 'a', '')) AS BIGINT) AS n_some,"
    " CAST(0 AS BIGINT) AS n_none FROM documents"
)
ORACLES["scrub_total"] = f"SELECT CAST(SUM(n) AS BIGINT) AS total FROM ({ORACLES['scrub_counts']})"
ORACLES["workbook_counts"] = (
    f"{DISCOVER}, {_eligible()} SELECT namespace, COUNT(*) AS n FROM rows_ GROUP BY ALL UNION ALL {ORACLES['pivot_counts']}"
)
ORACLES["table_write"] = (
    "SELECT c_custkey, replace(c_name, 'Customer', 'CLIENT') AS c_name, replace(c_mktsegment, 'BUILDING', 'B') AS c_mktsegment FROM customer"
)
ORACLES["first_redemption_stream"] = f"{_USES} SELECT DISTINCT token FROM met WHERE created_at IS NOT NULL"
ORACLES["refused_redemption_stream"] = (
    f"{_USES} SELECT token, redemption_id FROM met WHERE created_at IS NULL AND redeemed_at"
    " < (SELECT least((SELECT max(created_at) FROM made), (SELECT max(redeemed_at) FROM used))) - INTERVAL 900 SECONDS"
)
_KNOWN = ", ".join(
    [f"('{name}', {len(name)}, '{token[:64]}', '{token[-8:]}')" for name, token in NATION_TOKENS.items()]
    + [f"('{name}', {size}, '{head}', '{tail}')" for (name, size), (head, tail) in REGION_TOKENS.items()]
)
ORACLES["token_bytes"] = (
    f"SELECT k.* FROM (VALUES {_KNOWN}) AS k(name, size, head, tail)"
    " WHERE name IN (SELECT n_name FROM nation) OR name IN (SELECT r_name FROM region)"
)
_FAULTS = [
    "Input is not a readable DOCX document", "DOCX document XML could not be read", "Password-protected DOCX packages are not supported",
    "Input is not a valid DOCX document", "No replacement values were found in the document",
]
ORACLES["package_document_errors"] = (
    "SELECT doc_id || '.docx' AS doc, CASE doc_id % 6 WHEN 4 THEN 0 WHEN 5 THEN replacements END AS replacements, CASE "
    + " ".join(f"WHEN doc_id % 6 = {i} THEN '{error}'" for i, error in enumerate(_FAULTS))
    + f" WHEN replacements = 0 THEN '{_FAULTS[4]}' END AS error FROM ("
    + _two_passes("SELECT doc_id, string_split(text, chr(10)) AS runs FROM documents", "doc_id", catalog.LINE_RULES, "chr(10)", "replacements")
    + ")"
)
ORACLES["package_sheet_places"] = (
    "SELECT 's' || s_suppkey || '.xlsx' AS file_path, k.name AS sheet_name, 1 AS \"row\", 'A' AS col,"
    " CASE k.name WHEN 'One' THEN s_name ELSE CAST(s_acctbal AS VARCHAR) END AS value FROM supplier, (VALUES ('One'), ('Two')) AS k(name)"
)
ORACLES["replace_stream"] = ORACLES["replace_documents"]
