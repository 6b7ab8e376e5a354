"""SQL of the queries that SQL can say, besides that in ``registry``."""

#: Windows of 400 bytes as 800 hexadecimal digits, by their hash.
OP11 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), n AS (SELECT *, length(x) // 2 AS n FROM d),
  w AS (SELECT doc_id, i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 800)) AS m FROM n, unnest(range(0, n - 399)) AS r(i)),
  again AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
  hit AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN again USING (m)),
  runs AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit) GROUP BY doc_id, run),
  gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM runs UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id),
  kept AS (SELECT doc_id, string_agg(substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, n) - a) AS BIGINT)), '' ORDER BY a) AS x FROM gaps JOIN n USING (doc_id) GROUP BY doc_id),
  gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
  SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, n.x))) AS kept_sha256
  FROM n LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: The crc32 by bytes and a table that is made by rule; neighbours by masked places and deletions.
OP13 = """WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda c: list_reduce([c]::BIGINT[] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
  runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) AS run FROM documents),
  low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM runs GROUP BY 1, 2),
  coded AS (SELECT w, c, hex(encode(doc_id || ':' || w)) AS x FROM low),
  hashed AS (SELECT w, c, xor(list_reduce([4294967295]::BIGINT[] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda a, b: xor(a >> 8, tab[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295) AS h FROM coded, crc),
  spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
  v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelt GROUP BY word HAVING sum(c) >= 5 AND length(word) >= 6),
  cut AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM v, unnest(range(1, length(word) + 1)) AS r(i)),
  masked AS (SELECT word, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS m FROM v, unnest(range(1, length(word) + 1)) AS r(i)),
  near AS (SELECT a.word, b.word AS near FROM masked a JOIN masked b ON a.m = b.m AND a.word <> b.word UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.d = v.word UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.d = v.word),
  best AS (SELECT near.word, near.near, v.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near.near) AS r FROM near JOIN v ON v.word = near.near),
  words AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * v.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * v.n THEN b.near_n END AS form_n FROM v LEFT JOIN best b ON b.word = v.word AND b.r = 1),
  walk AS (SELECT word, word AS root FROM words UNION ALL SELECT walk.word, words.form FROM walk JOIN words ON words.word = walk.root WHERE words.form IS NOT NULL)
  SELECT words.word, words.form, walk.root, words.n, words.n_near, words.form_n FROM words JOIN walk ON walk.word = words.word JOIN words last ON last.word = walk.root WHERE last.form IS NULL"""
