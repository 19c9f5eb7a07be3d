"""SQL counterparts (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

HOST_RULES = rf"""WITH d AS (SELECT doc_id, source, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), {_WORD}) AS w FROM documents),
    grams AS (SELECT doc_id, k, list_slice(w, k, k + 4) AS g FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5) x),
    often AS (SELECT doc_id, k FROM (SELECT doc_id, k, COUNT(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) x WHERE n > 1),
    covered AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, UNNEST(range(k, k + 5)) AS p FROM often) x GROUP BY doc_id),
    lines AS (SELECT doc_id, UNNEST(string_split(t, chr(10))) AS line FROM d),
    dups AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id),
    stats AS (
      SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, COALESCE(u.n, 0) AS n_dup_lines, COALESCE(c.n, 0) AS n_repeat_words
      FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN dups u ON u.doc_id = d.doc_id),
    failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats),
    hosts AS (SELECT source, COUNT(*) AS n, COUNT(*) FILTER (base_failed) AS f FROM failed GROUP BY source),
    moments AS (SELECT AVG(f / n) AS m, VAR_POP(f / n) AS v FROM hosts),
    prior AS (SELECT m, CASE WHEN v > 0 THEN LEAST(1000, GREATEST(1, m * (1 - m) / v - 1)) ELSE 1000 END AS k FROM moments)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR (h.f + m * k) / (h.n + k) > 0.5) AS kept
    FROM failed JOIN hosts h ON h.source IS NOT DISTINCT FROM failed.source, prior"""

DECONTAMINATION = r"""WITH parts AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS re, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
    d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), up, low), re) AS w FROM documents, parts),
    items AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), up, low), re) AS w FROM benchmark, parts),
    windows AS (SELECT DISTINCT item_id, LEAST(10, len(w)) AS n, list_slice(w, k, k + LEAST(10, len(w)) - 1) AS g
      FROM (SELECT *, UNNEST(range(1, GREATEST(2, len(w) - 8))) AS k FROM items WHERE len(w) > 0) x),
    lengths AS (SELECT DISTINCT n FROM windows),
    grams AS (SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS g FROM (SELECT doc_id, n, w, UNNEST(range(1, len(w) - n + 2)) AS k FROM d JOIN lengths ON len(w) >= n) x),
    hits AS (SELECT doc_id, k, grams.n, item_id FROM grams JOIN windows ON windows.n = grams.n AND windows.g = grams.g),
    covered AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, UNNEST(range(k, k + n)) AS p FROM hits) x GROUP BY doc_id),
    found AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) x GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""

LINE_CHUNKS = """WITH lines AS (SELECT doc_id, k, line FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, UNNEST(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL) x),
    hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines),
    rolled AS (SELECT *, (h + 31 * COALESCE(lag(h, 1) OVER w, 0) + 961 * COALESCE(lag(h, 2) OVER w, 0)) % 3 = 0 AS closes FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    cut AS (SELECT *, COALESCE(SUM(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM rolled),
    chunks AS (SELECT doc_id, chunk, COUNT(*) AS n, string_agg(line, chr(10) ORDER BY k) AS body FROM cut GROUP BY doc_id, chunk),
    judged AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1 AS gone FROM chunks),
    kept AS (SELECT doc_id, SUM(n) AS n_lines, COALESCE(SUM(n) FILTER (gone), 0) AS n_removed, string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone) AS t FROM judged GROUP BY doc_id)
    SELECT d.doc_id, CAST(COALESCE(n_lines, 0) AS BIGINT) AS n_lines, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256
    FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

MIXING = rf"""WITH sized AS (SELECT doc_id, source, md5(COALESCE(CAST(doc_id AS VARCHAR), '')) AS draw, CAST(COALESCE(len(regexp_extract_all(text, {_WORD})), 0) AS BIGINT) AS size FROM documents),
    sources AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sources),
    weighed AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM ranked),
    leveled AS (SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / SUM(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
    fill AS (SELECT level FROM leveled WHERE most / weight >= level ORDER BY most / weight, place LIMIT 1),
    targets AS (SELECT source, source_size, LEAST(CAST(most AS DOUBLE), fill.level * weight) AS target, CASE (place - 1) % 3 WHEN 0 THEN 6e-1 WHEN 1 THEN 0e0 ELSE -6e-1 END AS slope FROM leveled, fill),
    run AS (SELECT sized.*, source_size, target, slope, CAST(round(target) AS BIGINT) AS wanted,
      CAST(COALESCE(SUM(size) OVER (PARTITION BY sized.source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM sized JOIN targets ON targets.source IS NOT DISTINCT FROM sized.source)
    SELECT doc_id, size, source_size, target, {' + '.join(f'GREATEST(0, LEAST(size, wanted - before - {k} * source_size))' for k in range(3))} AS taken,
      CAST({' + '.join(f'CASE WHEN LEAST(size, wanted - before - {k} * source_size) > 0 THEN 1 ELSE 0 END' for k in range(3))} AS BIGINT) AS n_uses,
      CASE WHEN LEAST(size, wanted - before) > 0 THEN CASE WHEN slope = 0 THEN before / CAST(wanted AS DOUBLE)
        ELSE (-(1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (before / CAST(wanted AS DOUBLE)))) / (2 * slope) END END AS first_position FROM run"""

RECOMPRESSION = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), {_WORD}) AS w FROM documents),
    windows AS (SELECT doc_id, k, md5(array_to_string(list_slice(w, k, k + 34), ' ')) AS g FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35) x),
    often AS (SELECT doc_id, k FROM (SELECT doc_id, k, COUNT(*) OVER (PARTITION BY g) AS n FROM windows) x WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, UNNEST(range(k, k + 35)) AS p FROM often),
    placed AS (SELECT doc_id, UNNEST(w) AS word, UNNEST(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT doc_id, COUNT(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - COALESCE(n, 0) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

HARD_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id AS other_id, c.label AS other, CAST(list_inner_product(a.vec, c.vec) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE own = other QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
    n AS (SELECT p.*, other_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND own <> other AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
