"""The queries of this subpackage and the DuckDB statements that check those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.byte_bpe import op5_byte_bpe
from tessera.llm.jpeg_media import op8_jpeg_media
from tessera.llm.language_id import op1_language_id
from tessera.llm.license_scan import op10_license_scan
from tessera.llm.ngram_join import op3_ngram_join
from tessera.llm.packing import op6_packing
from tessera.llm.positional_index import op12_decontamination
from tessera.llm.spelling import op11_spelling_variants
from tessera.llm.token_counts import op4_token_counts
from tessera.llm.toxicity import op2_toxicity
from tessera.llm.url_filter import op7_url_filter
from tessera.llm.vector_search import op9_vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_counts": op4_token_counts,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_packing": op6_packing,
    "op7_url_filter": op7_url_filter,
    "op8_jpeg_media": op8_jpeg_media,
    "op9_vector_search": op9_vector_search,
    "op10_license_scan": op10_license_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_decontamination": op12_decontamination,
}

#: All pairs that share a shingle, counted and closed into groups: exact, and quick enough for the small tables.
NGRAM_JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 9 * c >= 4 * (nx.n + ny.n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.doc_id),
groups AS (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY doc_id),
links AS (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS copy_id FROM n)
SELECT d.doc_id, g.class_id, coalesce(c.copy_id, d.doc_id) AS copy_id, coalesce(n_links, 0) AS n_links
FROM documents d JOIN groups g USING (doc_id) LEFT JOIN links USING (doc_id) LEFT JOIN copies c USING (doc_id)"""

#: The checksum byte by byte from a table made by its rule; near words by one letter left out; forms followed to the end.
SPELLING_SQL = r"""
WITH RECURSIVE steps AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i,
    list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
raw AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT run, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x, count(*) AS n FROM raw WHERE length(run) >= 5 GROUP BY doc_id, run),
summed AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(1, length(x), 2), lambda i: instr('123456789ABCDEF', x[i]) * 16 + instr('123456789ABCDEF', x[i + 1])),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM own, steps),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS x, b.word AS y FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
    UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.d = v.word UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.d = v.word),
best AS (SELECT x, count(*) AS n_near, min(ROW(-v.n, y)) AS b FROM p JOIN v ON v.word = y GROUP BY x),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n FROM v LEFT JOIN best ON x = word),
way(word, stop, k) AS (SELECT word, word, 0 FROM v UNION ALL SELECT way.word, form, k + 1 FROM way JOIN formed f ON f.word = way.stop WHERE form IS NOT NULL),
ends AS (SELECT word, arg_max(stop, k) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""

#: Every run of words of every text met with the windows of the items; a word is hit by the last window that begins at it or before.
DECONTAMINATION_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda k: array_to_string(ws[k:k + 9], ' '))) AS p FROM i WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT l FROM g),
runs AS (SELECT r, l, k, array_to_string(ws[k:k + l - 1], ' ') AS p FROM (SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS k FROM w, lengths)),
m AS (SELECT r, k, runs.l, item_id FROM runs JOIN g USING (p)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + l)) AS x FROM (SELECT DISTINCT r, k, l FROM m)) GROUP BY r),
own AS (SELECT r, count(x) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN hit USING (r) LEFT JOIN own USING (r)"""

ORACLE_SQL: dict[str, str] = {"op3_ngram_join": NGRAM_JOIN_SQL, "op11_spelling_variants": SPELLING_SQL, "op12_decontamination": DECONTAMINATION_SQL}
