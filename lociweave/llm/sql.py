"""DuckDB SQL with the rows of the queries that SQL can express over whole tables."""

HASH60 = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"

MIX_ROWS = f"""
rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         {HASH60.format("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per),
weighted AS (
  SELECT *, CAST((rank - 1) % 3 + 1 AS INTEGER) AS weight, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM ranked),
levels AS (
  SELECT *, (total - coalesce(CAST(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT)::DOUBLE AS level
  FROM weighted),
goals AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM levels WHERE level * weight <= cap) * weight) AS target FROM levels),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS repeats FROM goals),
sums AS (
  SELECT r.*, g.source_size, g.target, g.repeats, g.target - g.repeats * g.source_size AS rest,
         CAST(sum(size) OVER (PARTITION BY r.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS after,
         CAST(sum(size) OVER (PARTITION BY r.source, h) AS BIGINT) AS tied
  FROM rows r JOIN rests g ON r.source IS NOT DISTINCT FROM g.source),
taken AS (
  SELECT *, repeats + CASE WHEN 2 * after - tied < 2 * rest THEN 1 ELSE 0 END AS copies FROM sums)
"""

OP1 = f"WITH {MIX_ROWS} SELECT doc_id, size, source_size, target, size * copies AS taken FROM taken"

_U = "(CAST('0x' || substr(md5(doc_id || ':' || j), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"

OP4 = f"""
WITH bytes AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
crcs AS (
  SELECT doc_id, octet_length(encode(text)) + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT)),
                         lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM bytes, crc_table),
scores AS (
  SELECT doc_id, j, -1.0::DOUBLE / ln({_U}) AS s FROM documents, range(9) r(j)),
best AS (
  SELECT doc_id, CAST(arg_max(j, s) FILTER (j < 8) AS INTEGER) AS shard, CAST(arg_max(j, s) AS INTEGER) AS grown_shard FROM scores GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY {HASH60.format("CAST(doc_id AS VARCHAR)")}, doc_id) - 1 AS slot, grown_shard
FROM crcs JOIN best USING (doc_id)
"""

OP7 = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
item_shingles AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS n, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
doc_shingles AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM item_shingles) WHERE len(w) >= n)),
sizes AS (
  SELECT item_id, CAST(count(*) AS INTEGER) AS n_shingles FROM item_shingles GROUP BY item_id),
shared AS (
  SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared FROM doc_shingles JOIN item_shingles USING (n, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= n_shingles * 0.8::DOUBLE
"""

OP11 = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 256) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (
  SELECT vec_id, label, unnest(q) AS x, unnest(range(len(q))) AS i FROM usable),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS vec_id, b.label AS label, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM cells a JOIN cells b USING (i) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), range(1, 4) r(k) WHERE i + k - 1 <= len(w)),
counts AS MATERIALIZED (
  SELECT lang, k, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM grams GROUP BY ALL),
totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (
  SELECT lang, k, phrase, g, f AS a FROM counts WHERE k > 1 AND f >= 10),
parted AS (
  SELECT lang, phrase, a, t AS cut, array_to_string(g[1 : t], ' ') AS head, array_to_string(g[t + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS t FROM candidates)),
cuts AS (
  SELECT p.lang, p.phrase, p.a, p.cut, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * p.a * p.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM parted p JOIN counts x ON x.lang = p.lang AND x.phrase = p.head JOIN counts y ON y.lang = p.lang AND y.phrase = p.tail),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, array_to_string(g[1 : 2], ' ') AS phrase, a FROM candidates WHERE k = 3 UNION ALL SELECT lang, array_to_string(g[2 : 3], ' '), a FROM candidates WHERE k = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN totals USING (lang) LEFT JOIN longer USING (lang, phrase)
WHERE 100 * coalesce(most, 0) < 50 * a
QUALIFY rank <= 2000
"""
