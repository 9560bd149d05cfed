"""SQL for those queries of the subpackage that SQL can express."""

from __future__ import annotations

from rowtide.llm import quality_rules as rules
from rowtide.llm.common import WORD
from rowtide.llm.decontaminate import ITEM_WORD, LEAST, SLACK

_FAILS = f"""(length(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0 AND (NOT regexp_matches(x, '{rules.SENTENCE_MARKS}')
 OR (length(x) - length(translate(x, '{rules.MENU_MARKS}', '')) >= 3 AND (length(x) - length(translate(x, '{rules.MENU_MARKS}', ''))) * 24 > length(x))
 OR {' OR '.join(f"contains(lower(x), '{p}')" for p in rules.BOILERPLATE)}))"""

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, string_split(t, chr(10)) AS ls FROM d),
v AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '{WORD}')) AS worded,
  array_to_string(list_filter(ls, lambda x: NOT {_FAILS}), chr(10)) AS clean, len(list_filter(ls, lambda x: {_FAILS})) AS removed FROM w),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
c AS (SELECT v.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(worded) - len(list_distinct(worded)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  removed::BIGINT AS n_removed_lines, (length(t) - length(clean))::BIGINT AS lost_chars, length(t) AS chars
  FROM v LEFT JOIN cov ON cov.doc_id = v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_chars <= chars AS kept, n_removed_lines, lost_chars FROM c
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Items with a start where at least LEAST of a window's terms lie within SLACK words of their places.  By pigeonhole
#: one of the terms found there is among the rarest of the window, so starts are taken from where those stand.
NEAR = f"""
WITH dw AS (SELECT doc_id, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS pos FROM d),
u AS (SELECT k, n, row_number() OVER (ORDER BY n, k) AS wid FROM (SELECT DISTINCT k, n FROM win)),
wt AS (SELECT wid, n, unnest(string_split(k, ' ')) AS term, unnest(range(0, n)) AS x FROM u),
df AS (SELECT term, count(*) AS c FROM dw WHERE term IN (SELECT term FROM wt) GROUP BY term),
ranked AS (SELECT wt.*, row_number() OVER (PARTITION BY wid ORDER BY c, x) AS r, count(*) OVER (PARTITION BY wid) AS found FROM wt JOIN df USING (term)),
start AS (SELECT DISTINCT doc_id, wid, n, pos - x + s AS first FROM ranked JOIN dw USING (term), (SELECT unnest(range({-SLACK}, {SLACK} + 1)) AS s)
  WHERE r <= n - ceil({LEAST} * n - 1e-9) + 1 AND found >= ceil({LEAST} * n - 1e-9)),
place AS (SELECT start.*, x, term, first + x + t AS pos FROM start JOIN wt USING (wid), (SELECT unnest(range({-SLACK}, {SLACK} + 1)) AS t)),
met AS (SELECT doc_id, wid FROM place JOIN dw USING (doc_id, pos, term) GROUP BY doc_id, wid, place.n, first HAVING count(DISTINCT x) >= ceil({LEAST} * place.n - 1e-9))
SELECT DISTINCT met.doc_id, win.item FROM met JOIN u USING (wid) JOIN win ON win.k = u.k AND win.n = u.n
"""

DECONTAMINATE = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '{ITEM_WORD}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{ITEM_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT g.doc_id, g.i, g.n, win.item FROM g JOIN win ON g.n = win.n AND g.k = win.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
near_items AS ({NEAR}),
close AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM near_items GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN close ON close.doc_id = d.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
q AS (SELECT page_id, payload_bytes, sha256(h) AS payload_digest, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM q
"""

ORACLE_SQL = {"op2_quality_rules": QUALITY_RULES, "op9_decontaminate": DECONTAMINATE, "op10_warc": WARC}
