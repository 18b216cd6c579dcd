"""DuckDB SQL of operators that need more than a few lines of it."""

from __future__ import annotations

# crc32 by its definition: 256 table values from the polynomial (fixed value), then a step a byte.
_CRC = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS v
)"""

_GRAMS = """
  SELECT {key}, unnest([w[i], CASE WHEN i < len(w) THEN w[i] || ' ' || w[i + 1] END, CASE WHEN i + 1 < len(w) THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END]) AS g
  FROM (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS i FROM {words})
"""

RESAMPLING = rf"""
WITH {_CRC}, docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), doc_grams AS MATERIALIZED (
  SELECT r, g FROM ({_GRAMS.format(key="r", words="docs")}) WHERE g IS NOT NULL
), item_grams AS MATERIALIZED (
  SELECT g FROM ({_GRAMS.format(key="r", words="items")}) WHERE g IS NOT NULL
), named AS (
  SELECT g, list_transform(range(octet_length(encode(g))), lambda k: ('0x' || substr(hex(encode(g)), 2 * k + 1, 2))::BIGINT) AS bytes
  FROM (SELECT g FROM doc_grams UNION SELECT g FROM item_grams)
), hashed AS MATERIALIZED (
  SELECT g, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crc.v[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM named, crc
), s AS (SELECT bucket, count(*) AS n FROM doc_grams JOIN hashed USING (g) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM item_grams JOIN hashed USING (g) GROUP BY bucket
), gains AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE) / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t ON s.bucket = t.bucket
), weights AS (
  SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM doc_grams JOIN hashed USING (g) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (n_words >= 20)::INT DESC, score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * able // 100 THEN place END AS rank FROM placed
"""


def clusters(rounds: int = 5, k: int = 40, width: int = 64) -> str:
    """k-means in integers, a few CTEs a round."""
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v AS c FROM kept ORDER BY k LIMIT {k}
)"""]
    nearest = """near{i} AS MATERIALIZED (
  SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT r, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY r
)"""
    for i in range(rounds):
        parts.append(nearest.format(i=i))
        parts.append(f"""sums{i} AS MATERIALIZED (
  SELECT k, d, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT k, unnest(v) AS x, unnest(range({width})) AS d FROM kept JOIN near{i} USING (r)) GROUP BY k, d
), new{i} AS MATERIALIZED (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY d) AS c FROM sums{i} GROUP BY k
), c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(new{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN new{i} USING (k)
)""")
    parts.append(nearest.format(i=rounds))
    return ", ".join(parts) + f"""
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN near{rounds} USING (r) JOIN c{rounds} USING (k)
"""
