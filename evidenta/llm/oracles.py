"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from evidenta.llm.quality import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP4 = "SELECT doc_id, lang, source, n_chars, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents"

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, upper(sha1(html)) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT >> (15 - 5 * j)::INT) & 31) + 1)::INT, 1)), '')), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM m
"""

OP7 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(len(w) - 4)) AS i, w FROM w WHERE len(w) > 4),
k AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] || ' ' || w[i + 5] AS s FROM g),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM k),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop, len(list_filter(range(1, len(w)), lambda i: w[i + 1] = w[i])) AS n_echo,
  len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_shout,
  len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*\\x{{2022}}]\\s'))) AS n_bullet, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|\\x{{2026}})\\s*$'))) AS n_ellipsis
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 2.0 * n_words OR word_chars > 16.0 * n_words OR n_symbols > 0.25 * n_words OR (n_words >= 50 AND n_stop < 0.02 * n_words) OR n_echo > 0.30 * n_words
    OR n_shout > 0.60 * n_words OR n_dup_lines > 0.50 * n_lines OR n_bullet > 0.90 * n_lines OR n_ellipsis > 0.30 * n_lines) AS kept FROM b
"""

OP8 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w),
k AS (SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM t),
u AS (SELECT b, count(*) AS n FROM k GROUP BY b),
s AS (SELECT b, n, round(ln(n / (SELECT sum(n) FROM u)) * 1000000)::BIGINT AS micro FROM u),
p AS (SELECT a, b, count(*) AS n FROM k WHERE a IS NOT NULL GROUP BY a, b),
q AS (SELECT p.a, p.b, CASE WHEN p.n >= 2 THEN round(ln(p.n / c.n) * 1000000) ELSE s.micro + round(ln(0.4) * 1000000) END::BIGINT AS micro, (p.n < 2)::INT AS backed FROM p JOIN u c ON c.b = p.a JOIN s ON s.b = p.b),
x AS (SELECT k.doc_id, sum(coalesce(q.micro, s.micro)) AS micro, sum(coalesce(q.backed, 0)) AS backed FROM k JOIN s ON s.b = k.b LEFT JOIN q ON q.a = k.a AND q.b = k.b GROUP BY k.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(x.backed, 0)::BIGINT AS n_backoffs, coalesce(x.micro, 0)::DOUBLE / 1000000.0 AS log_score FROM w LEFT JOIN x USING (doc_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i + 1 : i + least(len(w), 8)], ' ') AS s FROM (SELECT item, w, unnest(range(greatest(len(w) - 7, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM v),
g AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT g.doc_id, g.i, g.n, v.item FROM g JOIN v ON v.n = g.n AND v.s = g.s),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
e AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(e.n_items, 0)::BIGINT AS n_items, sha256(coalesce(e.items, '')) AS items_sha256, coalesce(e.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id)
"""

ORACLES = {"op4_sharding": OP4, "op6_warc": OP6, "op7_quality_rules": OP7, "op8_lm_scores": OP8, "op9_benchmark_decontamination": OP9}
