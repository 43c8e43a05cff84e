"""What the operators' queries must return, as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from trellis.llm.quality import WRITTEN_STOP_WORDS


def _lloyd(clusters: int, rounds: int) -> str:
    """The rounds of Lloyd's algorithm, one after the other, over (vector, dimension) rows."""
    assign = """
a{r} AS MATERIALIZED (
    SELECT vec_id, cluster, distance FROM (
        SELECT k.vec_id AS vec_id, c.cluster AS cluster, CAST(sum((k.x - c.x) * (k.x - c.x)) AS BIGINT) AS distance
        FROM kept k JOIN c{r} c ON c.d = k.d GROUP BY k.vec_id, c.cluster) t
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""
    update = """
c{n} AS MATERIALIZED (
    SELECT c.cluster AS cluster, c.d AS d, CAST(coalesce((m.s - (m.s % m.n + m.n) % m.n) // m.n, c.x) AS BIGINT) AS x
    FROM c{r} c LEFT JOIN (
        SELECT a.cluster AS cluster, k.d AS d, CAST(sum(k.x) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN kept k ON k.vec_id = a.vec_id GROUP BY a.cluster, k.d) m
    ON m.cluster = c.cluster AND m.d = c.d)"""
    steps = [assign.format(r=r) + "," + update.format(r=r, n=r + 1) for r in range(rounds)] + [assign.format(r=rounds)]
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, unnest(range(1, 65)) AS d, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
first AS (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster FROM (SELECT DISTINCT vec_id FROM kept) t
    QUALIFY cluster < {clusters}),
c0 AS MATERIALIZED (SELECT f.cluster AS cluster, k.d AS d, k.x AS x FROM first f JOIN kept k ON k.vec_id = f.vec_id),
{",".join(steps)}
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY cluster) h ON h.cluster = a.cluster"""


ORACLES: dict[str, str] = {
    "op4_line_dedup": r"""
WITH split AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
    FROM documents),
keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM split),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.*, coalesce(o.owner < k.doc_id, false) AS gone FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op5_decontamination": r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS low),
dw AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), upper, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents, fold),
iw AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(translate(coalesce(text, ''), upper, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark, fold),
starts AS (SELECT item, least(10, len(w)) AS n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM starts),
places AS (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s
    FROM dw, (SELECT DISTINCT n FROM windows) AS lengths WHERE len(w) >= n),
grams AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k FROM places),
met AS (SELECT doc_id, g.n AS n, s, item FROM grams g JOIN windows x ON g.n = x.n AND g.k = x.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM met) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
       text_sha256
FROM d""",
    "op8_near_duplicates": r"""
WITH RECURSIVE dw AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, list_sort(list_distinct(list_transform(
               range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i : i + least(5, len(w)) - 1], ' ')))) AS s
    FROM dw WHERE len(w) > 0),
reps AS (SELECT md5(array_to_string(s, '|')) AS digest, min(doc_id) AS rep, count(*) AS n_copies, any_value(s) AS s FROM sets GROUP BY 1),
grams AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM reps),
common AS (
    SELECT x.rep AS a, y.rep AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c
    FROM grams x JOIN grams y ON x.g = y.g AND x.rep <> y.rep GROUP BY x.rep, y.rep),
links AS (SELECT a, b FROM common WHERE c * 5 >= (n + m - c) * 4),
reach AS (SELECT DISTINCT a AS rep, a AS other FROM links UNION SELECT r.rep, l.b FROM reach r JOIN links l ON r.other = l.a),
classes AS (SELECT rep, min(other) AS class_id FROM reach GROUP BY rep),
counts AS (SELECT a AS rep, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(r.rep, d.doc_id) AS copy_of, coalesce(r.n_copies, 1) AS n_copies,
       coalesce(c.class_id, r.rep, d.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN reps r ON r.digest = md5(array_to_string(s.s, '|'))
LEFT JOIN classes c ON c.rep = r.rep LEFT JOIN counts k ON k.rep = r.rep""",
    "op10_warc": r"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS owner
    FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM o""",
    "op11_hard_negatives": r"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id AS anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 3""",
    "op12_centroid_clusters": _lloyd(8, 10),
    "op13_quality_rules": r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS rows
    FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
twins AS (SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twins) x GROUP BY doc_id),
m AS (
    SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(rows) - len(list_distinct(rows)) AS BIGINT) AS n_dup_lines,
           coalesce(r.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: x IN STOPS)) AS n_stop, len(rows) AS n_lines,
           len(list_filter(rows, lambda x: left(ltrim(x), 1) IN ('-', '*', '•'))) AS n_bullets,
           len(list_filter(rows, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_cut
    FROM d LEFT JOIN repeats r ON r.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 300 * n_words AND 1000 * n_words AND 100 * n_symbols <= 10 * n_words AND 100 * n_stop >= 2 * n_words
       AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_bullets <= 90 * n_lines AND 100 * n_cut <= 30 * n_lines AS kept
FROM b""".replace("STOPS", str(tuple(WRITTEN_STOP_WORDS))),
}
