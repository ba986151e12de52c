"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"


def _round(n: int) -> str:
    """One more round of :mod:`veilcraft.llm.mixing`: running sums in hash order, kept while within the budget."""
    return f"""
o{n} AS (SELECT source_no, h, size, sum(size) OVER (PARTITION BY source_no ORDER BY h) AS run, budget
  FROM r{n} JOIN b{n} USING (source_no) WHERE picked = 0 AND size > 0 AND size <= budget),
p{n} AS (SELECT DISTINCT source_no, h FROM o{n} WHERE run <= budget),
r{n + 1} AS (SELECT r.* REPLACE (CASE WHEN p.h IS NULL OR r.size > b.budget OR r.size = 0 THEN picked ELSE 1 END AS picked)
  FROM r{n} r JOIN b{n} b USING (source_no) LEFT JOIN p{n} p ON p.source_no = r.source_no AND p.h = r.h),
b{n + 1} AS (SELECT source_no, budget - coalesce((SELECT sum(size) FROM o{n} o WHERE o.source_no = b.source_no AND run <= o.budget), 0) AS budget
  FROM b{n} b)"""


MIX = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORDS})), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM sized GROUP BY source),
w AS (SELECT *, source_no % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER f, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM w WINDOW f AS (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, (cap / weight, source_no)) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_no, source_size, least(cap::DOUBLE, coalesce(final.level * weight, cap::DOUBLE)) AS target FROM l, final),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
b0 AS (SELECT source_no, round(target)::BIGINT - whole * source_size AS budget FROM whole),
r0 AS (SELECT doc_id, h, size, source_no, source_size, target, whole, 0 AS picked FROM sized JOIN whole ON sized.source IS NOT DISTINCT FROM whole.source),
{_round(0)}, {_round(1)}, {_round(2)}
SELECT doc_id, size, source_size, target, (whole + picked) * size AS taken FROM r3
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT x AS vec_id, (SELECT count(*) FROM l WHERE l.x = r.x) AS n_links, min(y) AS component_id, min(y) = x AS kept FROM r GROUP BY x
"""

SEGMENT = r"[^ \t-\r](?:[^\n.!?]|[.!?]+[^ \t-\r.!?])*[.!?]*[ \t-\r]*"

SPANS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SEGMENT}') AS segments FROM documents),
s AS (SELECT doc_id, i, trim(regexp_replace(segments[i], '[ \t-\r]+', ' ', 'g')) AS sentence, segments[i] AS segment
  FROM (SELECT doc_id, segments, unnest(generate_series(1, len(segments))) AS i FROM d)),
w AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (SELECT *, len(string_split(sentence, ' ')) AS words FROM s)),
l AS (SELECT doc_id, list(sentence ORDER BY i) AS list FROM s GROUP BY doc_id),
r AS (SELECT a.doc_id, a.i, b.i - a.i + 1 AS length, b.upto - a.upto + a.words AS words FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 19),
p AS (
  SELECT doc_id, i, length, array_to_string(list[i : i + length - 1], chr(10)) AS span FROM l JOIN (
    SELECT doc_id, i, min(length) AS length FROM r WHERE length >= 3 AND words >= 20 GROUP BY doc_id, i
    UNION ALL SELECT doc_id, i, length FROM r WHERE length < 3 AND words >= 50) USING (doc_id)),
placed AS (SELECT *, row_number() OVER o AS place, count(*) OVER (PARTITION BY span) AS places FROM p WINDOW o AS (PARTITION BY span ORDER BY doc_id, i)),
every AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + length - 1)) AS i FROM placed WHERE places > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + length - 1)) AS i FROM placed WHERE place > 1),
kept AS (SELECT s.doc_id, count(*) AS n_sentences, count(every.i) AS n_repeated, count(gone.i) AS n_removed,
    coalesce(string_agg(CASE WHEN gone.i IS NULL THEN segment END, '' ORDER BY s.i), '') AS rest
  FROM s LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.i = s.i LEFT JOIN every ON every.doc_id = s.doc_id AND every.i = s.i GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_removed, 0) AS n_removed,
  sha256(regexp_extract(d.text, '^[ \t-\r]*') || coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

SEARCH = f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS})) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM words GROUP BY doc_id, word),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
size AS (SELECT doc_id, count(*) AS size FROM words GROUP BY doc_id),
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM words) / (SELECT count(*) FROM documents) AS mean),
hits AS (
  SELECT q.doc_id AS query_id, d.doc_id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
  FROM tf q JOIN df USING (word) JOIN tf d ON d.word = q.word JOIN size ON size.doc_id = d.doc_id, n
  WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, d.doc_id)
SELECT query_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits WHERE score > 0) WHERE rank <= 10
"""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_ITEM_WORDS = rf"coalesce(regexp_extract_all(translate(text, {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

_AHEAD = ", ".join(f"lead(word, {k}) OVER o" for k in range(1, 10))

CONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
iw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dt AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p, len(w) AS n FROM dw),
dg AS (SELECT doc_id, p, n, [word, {_AHEAD}] AS ahead FROM dt WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
met AS (SELECT doc_id, p, dg.k, win.item FROM (SELECT doc_id, p, k, array_to_string(ahead[1:k], ' ') AS gram FROM dg, (SELECT DISTINCT k FROM win) WHERE p + k <= n) dg
  JOIN win ON win.k = dg.k AND win.gram = dg.gram),
hit AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS spot FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN found ON found.doc_id = dw.doc_id
"""

def _moved(n: int) -> str:
    """Nearest entries by the codebooks of one round of :mod:`veilcraft.llm.codes`, and the codebooks of the next."""
    return f"""
a{n} AS (SELECT vec_id, part, any_value(s) AS s, min(struct_pack(d := list_sum([(s[i] - c[i]) * (s[i] - c[i]) for i in range(1, len(s) + 1)]), entry := entry)) AS best
  FROM p JOIN c{n} USING (part) GROUP BY vec_id, part),
m{n} AS (SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY place) AS c
  FROM (SELECT part, best.entry AS entry, place, sum(s[place])::BIGINT AS total, count(*) AS n FROM a{n}, generate_series(1, len(s)) AS t(place) GROUP BY ALL) GROUP BY part, entry),
c{n + 1} AS (SELECT part, entry, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN m{n} m USING (part, entry))"""


CODES = f"""
WITH v AS (SELECT vec_id, label, [floor(x::DOUBLE * 256)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, part, e[part * (len(e) // 16) + 1:(part + 1) * (len(e) // 16)] AS s FROM v, range(16) AS t(part)),
c0 AS (SELECT part, entry, s AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 64) USING (vec_id)),
{_moved(0)}, {_moved(1)}, {_moved(2)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (vec_id), books
"""

VARIANTS = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {LOWER}), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, times,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x[i:i + 1])::BIGINT for i in range(1, length(x), 2)]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, tab),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
inserted AS (SELECT DISTINCT l.word AS longer, l.n AS longer_n, w.word AS shorter, w.n AS shorter_n FROM less l JOIN words w ON w.word = l.rest),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT longer, shorter, shorter_n FROM inserted UNION ALL SELECT shorter, longer, longer_n FROM inserted),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at_word, 0 AS steps FROM told UNION ALL SELECT way.word, told.form, steps + 1 FROM way JOIN told ON told.word = way.at_word WHERE told.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN (SELECT word, arg_max(at_word, steps) AS root FROM way GROUP BY word) USING (word)
"""

ORACLES: dict[str, str] = {
    "op2_near_vectors": VECTORS, "op4_search": SEARCH, "op8_mix_sources": MIX, "op9_sentence_spans": SPANS, "op11_decontaminate": CONTAMINATION,
    "op12_spelling_variants": VARIANTS, "op13_vector_codes": CODES,
}
