"""DuckDB SQL of the queries whose statements are built from a rule."""

from __future__ import annotations

import zlib

_HEX = "'0123456789ABCDEF'"


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, byte by byte over its hex digits."""
    # A table entry is the register's change by one byte: the checksum of that byte from an empty register.
    table = [zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)]
    byte = f"CAST(16 * (strpos({_HEX}, b[1]) - 1) + strpos({_HEX}, b[2]) - 1 AS BIGINT)"
    digits = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda b: {byte})"
    step = f"xor(c >> 8, {table}[(xor(c, v) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, v: {step}))"


SHARDING_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, strlen(coalesce(text, '')) + 8 AS size, coalesce(text, '') AS t FROM documents),
c AS MATERIALIZED (SELECT doc_id, source, size, {crc32_sql("t")} AS crc FROM d),
k AS (SELECT *, md5(concat_ws('|', 'shard', CAST(doc_id AS VARCHAR), CAST(crc AS VARCHAR))) AS key FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key) AS r, count(*) OVER (PARTITION BY source) AS n FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), source NULLS LAST, key) - 1 AS p, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(p * 24 // total AS INTEGER) AS shard,
       p - (p * 24 // total * total + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

IMPORTANCE_SQL = f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, 1 AS own, {_WORDS} AS w FROM documents UNION ALL SELECT NULL, 0, {_WORDS} FROM benchmark),
f AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, own, len(w) AS n_words,
         list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
o AS MATERIALIZED (SELECT r, own, unnest(f) AS x FROM f),
b AS MATERIALIZED (SELECT x, {crc32_sql("x")} % 10000 AS bucket FROM (SELECT DISTINCT x FROM o)),
n AS MATERIALIZED (SELECT r, own, bucket FROM o JOIN b USING (x)),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (st + 10000) / ((s + 1.0::DOUBLE) * (tt + 10000)))) AS BIGINT) AS gain
  FROM (SELECT bucket, CAST(count(*) FILTER (WHERE own = 1) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE own = 0) AS DOUBLE) AS t FROM n GROUP BY bucket),
       (SELECT CAST(count(*) FILTER (WHERE own = 1) AS DOUBLE) AS st, CAST(count(*) FILTER (WHERE own = 0) AS DOUBLE) AS tt FROM n)),
m AS (SELECT r, sum(gain) AS total, count(*) AS k FROM n JOIN g USING (bucket) GROUP BY r),
v AS (
  SELECT doc_id, n_words, len(f) AS n_features, coalesce(CAST((total - ((total % k) + k) % k) // k AS BIGINT), 0) AS weight,
         CAST(('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM f LEFT JOIN m USING (r) WHERE own = 1),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS eligible FROM s)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank
FROM k
"""


def centroids_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Every distance of every round, without bounds."""
    out = [f"""
WITH x AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS j, v AS c FROM x
  ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) LIMIT {k})"""]
    distance = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    for r in range(rounds + 1):
        out.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := d, j := j)) AS b FROM (SELECT vec_id, v, j, CAST({distance} AS BIGINT) AS d FROM x, c{r}) GROUP BY vec_id, v)""")
        if r < rounds:
            means = ", ".join(f"CAST(floor(CAST(sum(v[{i}]) AS BIGINT) / count(*)) AS BIGINT)" for i in range(1, dims + 1))
            out.append(f"""
m{r} AS (SELECT b.j AS j, [{means}] AS c FROM a{r} GROUP BY b.j),
c{r + 1} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON o.j = m.j)""")
    return ",".join(out) + f"""
SELECT vec_id, CAST(b.j AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON b.j = j
"""
