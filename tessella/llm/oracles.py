"""SQL twins of the operators that SQL can express, for DuckDB."""

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

PREFERENCES = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), sides AS (
  SELECT conv_id, 'chosen' AS side, i, role, text FROM t
  UNION ALL SELECT conv_id, 'rejected', i, role, text FROM t WHERE i < n
  UNION ALL SELECT c.conv_id, 'rejected', c.n, o.role, o.text
    FROM (SELECT DISTINCT conv_id, n FROM t) AS c JOIN t AS o ON o.conv_id = xor(c.conv_id, 1) AND o.i = o.n
), apart AS (
  SELECT a.conv_id, min(a.i) AS i FROM (SELECT * FROM sides WHERE side = 'chosen') AS a
  LEFT JOIN (SELECT * FROM sides WHERE side = 'rejected') AS b ON a.conv_id = b.conv_id AND a.i = b.i AND a.role = b.role AND a.text = b.text
  WHERE b.i IS NULL GROUP BY a.conv_id
), p AS (
  SELECT s.*, coalesce(a.i, 1000000000) AS first, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r
  FROM sides AS s LEFT JOIN apart AS a ON s.conv_id = a.conv_id
), q AS (
  SELECT *, sum(length(r)) OVER (PARTITION BY conv_id, side ORDER BY i) - length(r) + length(role) + 5 AS begin FROM p WHERE i >= first
), done AS (
  SELECT conv_id, side, sha256(string_agg(r, '' ORDER BY i)) AS sha,
         coalesce(string_agg(begin || ':' || (begin + length(text) + 7), ',' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS learned
  FROM q GROUP BY conv_id, side
), sizes AS (
  SELECT conv_id, count(*) FILTER (WHERE side = 'chosen') AS chosen_turns, count(*) FILTER (WHERE side = 'rejected') AS rejected_turns,
         count(*) FILTER (WHERE side = 'chosen' AND i < first) AS common_turns,
         sha256(coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE side = 'chosen' AND i < first), '')) AS prompt_sha256
  FROM p GROUP BY conv_id
)
SELECT s.conv_id, chosen_turns, rejected_turns, common_turns, prompt_sha256,
       coalesce(c.sha, sha256('')) AS chosen_sha256, coalesce(c.learned, '') AS chosen_learned,
       coalesce(d.sha, sha256('')) AS rejected_sha256, coalesce(d.learned, '') AS rejected_learned
FROM sizes AS s LEFT JOIN done AS c ON c.conv_id = s.conv_id AND c.side = 'chosen'
LEFT JOIN done AS d ON d.conv_id = s.conv_id AND d.side = 'rejected'
"""

_N = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

MIXING = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST({_N} AS BIGINT) AS size, coalesce(md5(text), '') AS tie,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS h FROM documents
), house AS (SELECT CAST(floor(coalesce(sum(size), 0) * 1.5 / 8 + 0.5) AS BIGINT) AS house FROM docs),
s1 AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM docs GROUP BY source
), s2 AS (SELECT *, CASE (src - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s1),
s3 AS (
  SELECT *, (1.5 * sum(source_size) OVER () - sum(cap) OVER w + cap)::DOUBLE / (sum(weight) OVER () - sum(weight) OVER w + weight) AS level
  FROM s2 WINDOW w AS (ORDER BY cap::DOUBLE / weight, src)
), sources AS (SELECT source, src, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM s3),
q1 AS (
  SELECT src, target / (2 * k + 1) AS quotient FROM sources, house, range(0, CAST(house AS BIGINT)) AS r(k)
  WHERE target > 0 AND k <= target / 8 + 2
), seats AS (
  SELECT src, count(*) AS blocks FROM (SELECT src, row_number() OVER (ORDER BY quotient DESC, src) AS p FROM q1), house WHERE p <= house GROUP BY src
), placed AS (
  SELECT d.*, s.src, s.source_size, s.target,
         CAST(('0x' || substr(h, 1, 15)) AS BIGINT) % greatest(1, CAST(ceil(source_size / 262144.0) AS BIGINT)) AS shard
  FROM docs AS d JOIN sources AS s ON d.source IS NOT DISTINCT FROM s.source
), put AS (
  SELECT *, sum(size) OVER (PARTITION BY src, shard ORDER BY h, doc_id NULLS FIRST, size, tie ROWS UNBOUNDED PRECEDING) - size AS before FROM placed
), shards AS (
  SELECT src, shard, shard // 1024 AS bundle, CAST(sum(size) AS BIGINT) AS words FROM placed GROUP BY src, shard HAVING sum(size) > 0
), bundles AS (SELECT src, bundle, sum(words) AS words, any_value(blocks) AS blocks FROM shards JOIN seats USING (src) GROUP BY src, bundle),
q2 AS (
  SELECT src, bundle, row_number() OVER (PARTITION BY src ORDER BY words::DOUBLE / (2 * k + 1) DESC, bundle) AS p, blocks
  FROM bundles, range(0, 10000000) AS r(k) WHERE k <= words // 4 + 4
), won AS (SELECT src, bundle, count(*) AS blocks FROM q2 WHERE p <= blocks GROUP BY src, bundle),
q3 AS (
  SELECT src, bundle, shard, row_number() OVER (PARTITION BY src, bundle ORDER BY s.words::DOUBLE / (2 * k + 1) DESC, shard) AS p, blocks
  FROM shards AS s JOIN won USING (src, bundle), range(0, 10000000) AS r(k) WHERE k <= s.words // 4 + 4
), got AS (SELECT src, shard, count(*) AS seats FROM q3 WHERE p <= blocks GROUP BY src, shard),
runs AS (
  SELECT s.src, s.shard, words, n, least(coalesce(seats, 0), 2 * n) AS seats, CAST(('0x' || substr(md5('mix-1|' || s.src || '|' || s.shard || '|run'), 1, 15)) AS BIGINT) % n AS f
  FROM (SELECT *, greatest(1, CAST(round(words / 8.0) AS BIGINT)) AS n FROM shards) AS s LEFT JOIN got AS g ON s.src = g.src AND s.shard = g.shard
), cuts AS (
  SELECT src, shard, seats // n AS each, f * words // n AS lo, least(f + seats % n, n) * words // n AS hi, greatest(f + seats % n - n, 0) * words // n AS again FROM runs
)
SELECT p.doc_id, p.size, CAST(p.source_size AS BIGINT) AS source_size, p.target,
       CAST(coalesce(each * p.size + greatest(0, least(hi, before + p.size) - greatest(lo, before)) + greatest(0, least(again, before + p.size) - before), 0) AS BIGINT) AS taken
FROM put AS p LEFT JOIN cuts AS c ON c.src = p.src AND c.shard = p.shard
"""

COLLOCATIONS = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k))
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10
), longer AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longest FROM (SELECT lang, a, w, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY 1, 2
), kept AS (
  SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a
), cuts AS (
  SELECT *, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)
), s AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = cuts.first JOIN f AS y ON y.lang = cuts.lang AND y.phrase = cuts.rest
), one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM one JOIN n USING (lang) QUALIFY rank <= 2000
"""

RESAMPLING = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
), x AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), y AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), fx AS (
  SELECT row, feature, count(*) AS n FROM (SELECT row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM x) GROUP BY row, feature
), fy AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM y
), b AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(feature)), lambda k: CAST('0x' || substr(hex(encode(feature)), 2 * k + 1, 2) AS BIGINT))),
    lambda c, o: xor(c >> 8, t[1 + (xor(c, o) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT feature FROM fx UNION SELECT feature FROM fy), crc
), s AS (SELECT bucket, sum(n) AS s FROM fx JOIN b USING (feature) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM fy JOIN b USING (feature) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), sums AS (SELECT row, CAST(sum(n * gain) AS BIGINT) AS total FROM fx JOIN b USING (feature) JOIN gain USING (bucket) GROUP BY row
), d AS (
  SELECT doc_id, len(w) AS words, greatest(2 * len(w) - 1, 0) AS n_features,
    CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % (2 * len(w) - 1)) + (2 * len(w) - 1)) % (2 * len(w) - 1)) // (2 * len(w) - 1) END AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM x LEFT JOIN sums USING (row)
), scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d
), placed AS (
  SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) END AS place FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN place <= 25 * (SELECT count(*) FROM d WHERE words >= 20) // 100 THEN place END AS rank
FROM placed
"""
