"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLE: dict[str, str] = {
    # every 13-word window (shorter items: one window) of both sides, compared as text
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g
       FROM bl, unnest(range(1, len(w) - l + 2)) AS t(i)),
ls AS (SELECT DISTINCT l FROM bl),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g
       FROM d, ls, unnest(range(1, len(w) - l + 2)) AS t(i) WHERE len(w) >= l),
hit AS (SELECT doc_id, l, i, item_id FROM dw JOIN bw USING (l, g)),
pos AS (SELECT DISTINCT doc_id, p FROM hit, unnest(range(i, i + l)) AS t(p)),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS items_sha256
       FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    # targets: sources by the size they stop at per unit of weight; the share of
    # the first that does not stop holds for all behind it
    "op12_mixture": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    substr(md5('42:' || coalesce('id:' || doc_id::VARCHAR, 'text:' || text, 'none')), 1, 15) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST)) - 1) % 3]::BIGINT AS w FROM s),
o AS (SELECT *, sum(z) OVER () - 3 * coalesce(sum(z) OVER (ORDER BY z::DOUBLE / w, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY z::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
  row_number() OVER (ORDER BY z::DOUBLE / w, source NULLS LAST) AS k FROM r),
f AS (SELECT k AS fk, rest AS frest, ws AS fws FROM o WHERE w * rest <= 3 * z * ws ORDER BY k LIMIT 1),
t AS (SELECT source, z, CASE WHEN k < fk THEN (3 * z)::DOUBLE ELSE (w * frest)::DOUBLE / fws::DOUBLE END AS target,
  CASE WHEN k < fk THEN 3 * z ELSE (w * frest) // fws END::BIGINT AS quota FROM o, f),
c AS (SELECT d.*, z, target, quota // greatest(z, 1) AS q, quota % greatest(z, 1) AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z AS source_size, target, source,
  (q * size + least(size, greatest(rest - before, 0)))::BIGINT AS taken FROM c""",
    # CRC-32 bit by bit; near words share what is left without one letter
    "op13_spelling": """
WITH RECURSIVE bits AS (SELECT b, 0 AS k, b::UBIGINT AS c FROM range(256) AS t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM each),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(range(1, length(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::UBIGINT)),
    lambda a, b: xor(a // 256, t[(xor(a, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM bytes, crc),
cut AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT)
    || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM pairs GROUP BY word),
found AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form,
    CASE WHEN form_n >= 2 * n THEN form_n END::BIGINT AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS stop FROM found WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, f.form FROM chain JOIN found f ON f.word = chain.stop WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, stop AS root FROM chain JOIN found f ON f.word = chain.stop WHERE f.form IS NULL)
SELECT found.word, form, coalesce(root, found.word) AS root, n, n_near, form_n FROM found LEFT JOIN ends USING (word)""",
}
