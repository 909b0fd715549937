"""DuckDB SQL for the operators that SQL can express on whole tables."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN text_words IS NULL OR len(text_words) = 0 THEN CAST([] AS UBIGINT[])
    WHEN len(text_words) < 4 THEN [hash(array_to_string(text_words, ' '))]
    ELSE list_transform(range(1, len(text_words) - 2), lambda i: hash(array_to_string(text_words[i:i + 3], ' '))) END) AS sh
  FROM (SELECT doc_id, ws AS text_words FROM w) q
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS h FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n_shingles + y.n_shingles - n_both)),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.doc_id)
SELECT n.doc_id, n.n_shingles, min(c.r) AS component_id, n.doc_id = min(c.r) AS kept
FROM n JOIN c ON c.doc_id = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

# crc32 bit by bit over the bytes of "<doc_id>:<run>"; runs hold ASCII letters and U+00C0 to U+00FF only
_BIT = "xor(c >> 1, 3988292384 * (c & 1))"
SPELLING_VARIANTS = f"""
WITH RECURSIVE step AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda c, i: {_BIT}) AS v FROM range(256) r(b)) q
), r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00c0-\u00ff]+')) AS run FROM documents
), k AS (
  SELECT id, run, count(*) AS n, list_transform(string_split(id || ':' || run, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS p
  FROM r WHERE length(run) >= 6 GROUP BY id, run
), y AS (
  SELECT run, n, flatten(list_transform(p, lambda x: CASE WHEN x < 128 THEN [x] ELSE [195, x - 64] END)) AS b FROM k
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM y, step
), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), d AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v) q
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS n_other FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, v.n, d.word, d.n FROM v JOIN d ON d.rest = v.word
  UNION SELECT d.word, d.n, v.word, v.n FROM v JOIN d ON d.rest = v.word
), best AS (
  SELECT word, n, other, n_other, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n_other DESC, other) = 1
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_other >= 5 * v.n THEN other END AS form, CASE WHEN n_other >= 5 * v.n THEN n_other END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word
), c(word, last) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.last FROM c JOIN f ON f.word = c.last WHERE f.form IS NULL)
SELECT f.word, f.form, e.last AS root, f.n, f.n_near, f.form_n FROM f JOIN e ON e.word = f.word
"""
