"""Checking SQL of the operators that SQL can express; written for DuckDB over the given tables."""

from __future__ import annotations

_SLOTS, _CHUNK_WORDS = 262144, "greatest(CAST(ceil(all_target / 262144) AS BIGINT), 1)"

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(concat('mix-1', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key, row_number() OVER () AS row
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
listed AS (
  SELECT *, 2 * source_size AS cap, CASE (pos - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, (SELECT sum(source_size) FROM sums) * 1.5 AS total
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM sums) s),
-- A source stops at its cap if its share of what the sources before it (by cap over weight) leave is at least the cap.
shares AS (
  SELECT *, CAST(cap AS DOUBLE) / weight <= CAST(total - coalesce(sum(cap) OVER before, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS stops
  FROM listed WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT pos, source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(total - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0) AS DOUBLE) * weight
    / sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () END AS target
  FROM shares),
ranges AS (
  SELECT *, low / all_target * 4294967296 AS first, (low + target) / all_target * 4294967296 AS last, {_CHUNK_WORDS} AS block_words FROM (
    SELECT *, sum(target) OVER () AS all_target, coalesce(sum(target) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM targets) t WHERE target > 0),
points AS (SELECT k AS slot, (k * 2654435769) % 4294967296 AS point FROM (SELECT unnest(range({_SLOTS})) AS k) r),
ranked AS (
  SELECT pos, block_words, CAST(ceil(CAST(source_size AS DOUBLE) / block_words) AS BIGINT) AS blocks, row_number() OVER (PARTITION BY pos ORDER BY slot) - 1 AS rank
  FROM points JOIN ranges ON point >= first AND point < last WHERE slot < ceil(all_target / block_words)),
used AS (SELECT pos, block_words, rank % blocks AS block, count(*) AS times FROM ranked WHERE rank < 2 * blocks GROUP BY ALL),
placed AS (
  SELECT d.*, t.pos, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY t.pos ORDER BY key, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT row, sum(times * (least(start + size, (block + 1) * block_words) - greatest(start, block * block_words))) AS taken
  FROM placed p JOIN used u ON p.pos = u.pos AND block * block_words < start + size AND (block + 1) * block_words > start GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN taken USING (row)"""

QUALITY = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
grams AS (SELECT row, i, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 2) x),
places AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM grams) x WHERE n > 1),
repeats AS (SELECT row, sum(step) AS n FROM (SELECT row, least(coalesce(lead(i) OVER (PARTITION BY row ORDER BY i) - i, 3), 3) AS step FROM places) x GROUP BY row),
base AS (
  SELECT row, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (row)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
tall AS (
  SELECT *, CASE WHEN v < 64 THEN v ELSE 64 + (p - 6) * 32 + CAST(floor(v / pow(2, p - 5)) AS BIGINT) - 32 END AS bucket FROM (
    SELECT *, length(bin(v)) - 1 AS p FROM (
      SELECT row, lang, source, base_failed, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS measure,
        unnest([n_symbols * 1000 // greatest(n_words, 1), n_dup_lines * 1000 // greatest(n_words, 1), n_repeat_words * 1000 // greatest(n_words, 1), word_chars * 100 // greatest(n_words, 1)]) AS v FROM judged) a) b),
hist AS (
  SELECT 'own' AS level, lang, source, measure, bucket, count(*) AS n FROM tall WHERE NOT base_failed GROUP BY ALL
  UNION ALL SELECT 'lang', lang, NULL, measure, bucket, count(*) FROM tall WHERE NOT base_failed GROUP BY ALL
  UNION ALL SELECT 'source', NULL, source, measure, bucket, count(*) FROM tall WHERE NOT base_failed GROUP BY ALL
  UNION ALL SELECT 'all', NULL, NULL, measure, bucket, count(*) FROM tall WHERE NOT base_failed GROUP BY ALL),
upto AS (
  SELECT *, CASE WHEN bucket < 64 THEN bucket ELSE CAST((32 + (bucket - 64) % 32) * pow(2, (bucket - 64) // 32 + 1) AS BIGINT) END AS low,
    sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY level, lang, source, measure) AS size FROM hist),
marks AS (
  SELECT level, lang, source, measure, size, min(low) FILTER (WHERE c >= size * CAST(0.25 AS DOUBLE)) AS low,
    [min(low) FILTER (WHERE c >= size * CAST(0.5 AS DOUBLE)), min(low) FILTER (WHERE c >= size * CAST(0.75 AS DOUBLE)), min(low) FILTER (WHERE c >= size * CAST(0.875 AS DOUBLE)), min(low) FILTER (WHERE c >= size * CAST(0.9375 AS DOUBLE)), min(low) FILTER (WHERE c >= size * CAST(0.96875 AS DOUBLE)), min(low) FILTER (WHERE c >= size * CAST(0.984375 AS DOUBLE)), min(low) FILTER (WHERE c >= size * CAST(0.9921875 AS DOUBLE)), min(low) FILTER (WHERE c >= size * CAST(0.99609375 AS DOUBLE)), min(low) FILTER (WHERE c >= size * CAST(0.998046875 AS DOUBLE)), min(low) FILTER (WHERE c >= size * CAST(0.9990234375 AS DOUBLE))] AS steps FROM upto GROUP BY ALL),
-- The body of a measure ends before the first step of the ladder that is over four times the one before.
factors AS (
  SELECT level, lang, source, measure, size, middle, CASE WHEN low > 0 AND low < middle THEN least(pow(CAST(middle + 16 AS DOUBLE) / (low + 16), 12) + CAST(0.03125 AS DOUBLE), ladder) ELSE ladder END AS factor
  FROM (SELECT *, steps[1] AS middle, CAST(4 AS DOUBLE) * (list_reduce(steps, lambda t, v: CASE WHEN v + 16 <= 4 * (t + 16) THEN v ELSE t END) + 16) / (steps[1] + 16) AS ladder FROM marks) m),
shrunk AS (
  SELECT o.lang, o.source, o.measure, CASE WHEN o.size >= 50 THEN o.middle WHEN l.size >= 50 THEN l.middle ELSE a.middle END AS middle,
    CASE WHEN o.size >= 50 THEN (o.size * o.factor + 50 * (l.factor + s.factor + a.factor) / 3) / (o.size + 50)
      WHEN l.size >= 50 THEN (l.size * l.factor + 50 * a.factor) / (l.size + 50) ELSE a.factor END AS factor
  FROM factors o JOIN factors l ON l.level = 'lang' AND l.measure = o.measure AND l.lang IS NOT DISTINCT FROM o.lang
  JOIN factors s ON s.level = 'source' AND s.measure = o.measure AND s.source IS NOT DISTINCT FROM o.source JOIN factors a ON a.level = 'all' AND a.measure = o.measure
  WHERE o.level = 'own'),
limits AS (SELECT *, CAST(floor((middle + 16) * factor * (1 + CAST(1e-9 AS DOUBLE))) AS BIGINT) - 16 AS most FROM shrunk),
over_limit AS (
  SELECT t.row, t.measure FROM tall t JOIN limits o ON o.measure = t.measure AND o.lang IS NOT DISTINCT FROM t.lang AND o.source IS NOT DISTINCT FROM t.source
  WHERE NOT t.base_failed AND t.v > o.most),
reasons AS (SELECT row, string_agg(measure, ',' ORDER BY list_position(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length'], measure)) AS failed FROM over_limit GROUP BY row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed FROM judged LEFT JOIN reasons USING (row)"""

# crc32 of the id's digits by its bitwise rule; runs as islands of equal words some `q` words apart.
PERIODIC_RUNS = r"""
WITH base AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k + 1, 1)) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: CAST(0 AS BIGINT))), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS h
  FROM documents),
sized AS (SELECT row, doc_id, w, CAST(len(w) AS BIGINT) AS n, coalesce(h % 10 = 0 AND len(w) > 0, false) AS planted, h // 10 AS g FROM base),
places AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM sized),
steps AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS p FROM places),
tokens AS (
  SELECT row, n, i, CASE WHEN planted AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x FROM (SELECT row, n, w, planted, a, p, unnest(range(n)) AS i FROM steps WHERE n > 0) t),
pairs AS (SELECT l.row, l.i, r.i - l.i AS q FROM tokens l JOIN tokens r ON l.row = r.row AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
islands AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs) t GROUP BY row, q, island),
runs AS (SELECT row, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY row, start, length),
dropped AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
listed AS (SELECT row, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY row),
-- length/period as a whole number of 1/2^40 plus the rest: no two ratios of these sizes fall together.
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY row ORDER BY CAST(length AS HUGEINT) * 1099511627776 // period DESC, start, period) = 1),
joined AS (SELECT row, string_agg(x, ' ' ORDER BY i) AS kept FROM tokens ANTI JOIN dropped USING (row, i) GROUP BY row)
SELECT s.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM steps s LEFT JOIN listed USING (row) LEFT JOIN best USING (row) LEFT JOIN joined USING (row)"""


def centroids_sql(clusters: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Lloyd rounds over whole components, one table per round."""
    apart = "list_sum(list_transform(range(1, {d} + 1), lambda k: CAST((v.x[k] - c.x[k]) * (v.x[k] - c.x[k]) AS BIGINT)))".format(d=dims)
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key, x) - 1 AS cluster, x FROM (SELECT x, sha256(concat('2:', vec_id)) AS key FROM v ORDER BY key, x LIMIT {clusters}) t)"""]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT row, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT v.row, c.cluster, {apart} AS d FROM v, c{r} c) t GROUP BY row)")
        if r < rounds:
            parts.append(f"""m{r} AS (
  SELECT cluster, list(CAST(floor(CAST(s - (s % n + n) % n AS DOUBLE) / n) AS BIGINT) ORDER BY k) AS x FROM (
    SELECT a.cluster, k, CAST(sum(v.x[k]) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN v USING (row), range(1, {dims} + 1) t(k) GROUP BY a.cluster, k) s GROUP BY cluster)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c ON a.cluster = c.cluster"""


# Five hexadecimal digits are four letters of base 32.
WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT *, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST(concat('0x', substr(hex, CAST(k // 4 AS INTEGER) * 5 + 1, 5)) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest FROM p),
g AS (SELECT hex AS of_hex, max(page_id) AS last FROM p GROUP BY hex)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d JOIN g ON hex = of_hex"""

SQL = {"op6_mixing": MIXING, "op10_quality": QUALITY, "op11_periodic_runs": PERIODIC_RUNS, "op12_centroids": centroids_sql(), "op13_warc": WARC}
