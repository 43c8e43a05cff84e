"""Expected results of the queries in plain SQL over the same tables.

Requirement trees are built here from the numeric shape of each course, never by parsing text.
"""

from __future__ import annotations

from trellis.functions import text as T
from trellis.operators.requirements import WARN_CONNECTOR, WARN_GROUPING
from trellis.plans import fixtures
from trellis.plans.queries import BROKEN, RAW_CODES, REFERRING, TITLES, YEAR_OF
from trellis.plans.workspace import COURSES, PROGRAM_VIEWS, YEAR

_WS = "[" + T.SPACE_CHARS.replace(r"\x0B", r"\v") + "]"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(translate(coalesce({c}, ''), '{T.DASHES}', '{'-' * len(T.DASHES)}'), '{_WS}+', ' ', 'g'))"


def _decoded(c: str) -> str:
    out = c
    for pattern, char in T.ENTITIES:
        out = f"regexp_replace({out}, '{pattern}', '{char.replace(chr(39), chr(39) * 2)}', 'g')"
    return out


VIEWS = {
    **PROGRAM_VIEWS,
    "ox_courses": COURSES,
    # Node templates per shape; pick names the referenced course.
    "ox_shape_nodes": """
SELECT * FROM (VALUES
 (1, '0', NULL, 'course', 'a', NULL, true),
 (2, '0', NULL, 'any', NULL, NULL, true), (2, '0.0', '0', 'course', 'a', NULL, false), (2, '0.1', '0', 'course', 'b', NULL, false),
 (3, '0', NULL, 'all', NULL, NULL, true), (3, '0.0', '0', 'course', 'a', NULL, true), (3, '0.1', '0', 'course', 'b', NULL, true),
 (4, '0', NULL, 'all', NULL, NULL, true), (4, '0.0', '0', 'course', 'a', NULL, true), (4, '0.1', '0', 'any', NULL, NULL, true),
 (4, '0.1.0', '0.1', 'course', 'b', NULL, false), (4, '0.1.1', '0.1', 'course', 'c', NULL, false),
 (5, '0', NULL, 'any', NULL, NULL, true), (5, '0.0', '0', 'course', 'a', 'Grade A or above', false), (5, '0.1', '0', 'course', 'b', NULL, false),
 (6, '0', NULL, 'coursePattern', NULL, NULL, true),
 (7, '0', NULL, 'all', NULL, NULL, true), (7, '0.0', '0', 'course', 'a', NULL, true), (7, '0.1', '0', 'condition', NULL, NULL, true),
 (8, '0', NULL, 'any', NULL, NULL, true), (8, '0.0', '0', 'course', 'z', NULL, false), (8, '0.1', '0', 'course', 'a', NULL, false)
) AS v(shape, path, parent_path, kind, pick, qualifier, mandatory)""",
    "ox_nodes": """
SELECT s.owner AS owner, 'prerequisite' AS relation, n.path AS path, n.parent_path AS parent_path, n.kind AS kind,
       CASE n.pick WHEN 'a' THEN s.a WHEN 'b' THEN s.b WHEN 'c' THEN s.c WHEN 'z' THEN 'ZZZZ 9999' END AS code, n.qualifier AS qualifier,
       CASE WHEN n.kind = 'coursePattern' THEN s.a_subject END AS pat_subject,
       CASE WHEN n.kind = 'coursePattern' THEN CAST(3 AS BIGINT) END AS pat_min_level,
       CASE n.kind WHEN 'coursePattern' THEN 'Any ' || s.a_subject || ' courses of 3000-level or above' WHEN 'condition' THEN 'Approval of instructor' END AS text,
       n.mandatory AS mandatory
FROM fx_shape_codes s JOIN ox_shape_nodes n ON n.shape = s.shape
UNION ALL
SELECT owner, relation, '0', NULL, 'course', substr(raw, 1, 9), CASE WHEN relation = 'exclusion' THEN 'prior to 2022-23' END, NULL, NULL, NULL, true FROM fx_other_req""",
    "ox_refs": "SELECT DISTINCT owner, relation, code AS ref FROM ox_nodes WHERE kind = 'course'",
    "ox_ids": """
SELECT owner, relation, kind, code, pat_subject, qualifier, path,
       CASE WHEN kind = 'course' THEN 'course:' || code WHEN kind IN ('any', 'all') THEN 'bool:' || owner || ':' || relation || ':' || path
            ELSE kind || ':' || owner || ':' || relation || ':' || path END AS id,
       CASE WHEN parent_path IS NULL THEN 'course:' || owner ELSE 'bool:' || owner || ':' || relation || ':' || parent_path END AS upper_id
FROM ox_nodes""",
    "ox_edges": """
SELECT owner, CASE WHEN relation = 'exclusion' THEN upper_id ELSE id END AS source, CASE WHEN relation = 'exclusion' THEN id ELSE upper_id END AS target,
       relation, coalesce(qualifier, '') AS qualifier, relation <> 'prerequisite' AS mutual FROM ox_ids""",
    "ox_back2": """
SELECT root, code, min(distance) AS distance FROM (
  SELECT code AS root, code, 0 AS distance FROM fx_courses
  UNION ALL SELECT r.owner, r.ref, 1 FROM ox_refs r JOIN fx_courses c ON c.code = r.ref
  UNION ALL SELECT r.owner, q.ref, 2 FROM ox_refs r JOIN ox_refs q ON q.owner = r.ref JOIN fx_courses c ON c.code = q.ref) t
GROUP BY root, code""",
    "ox_pre": "SELECT owner, ref FROM ox_refs WHERE relation = 'prerequisite'",
    # Graph of depth 2: what the root and its direct references require.
    "ox_graph2": "SELECT b.root AS root, i.* FROM ox_back2 b JOIN ox_ids i ON i.owner = b.code WHERE b.distance < 2",
    # Longest paths between components (a course k % 10 = 0 and its corequisite k - 1 form one);
    # the planted cycle 7-8 is never followed, because only ANY arms lead into it.
    "ox_comp": """
SELECT k, CASE WHEN k >= 30 AND k % 10 = 9 AND k + 1 < (SELECT count(*) FROM fx_courses) THEN k + 1 ELSE k END AS comp FROM fx_courses""",
    "ox_step": """
SELECT DISTINCT a.comp AS comp, b.comp AS dep FROM ox_pre p JOIN fx_courses x ON x.code = p.owner JOIN fx_courses y ON y.code = p.ref
JOIN ox_comp a ON a.k = x.k JOIN ox_comp b ON b.k = y.k WHERE y.k NOT IN (7, 8) AND x.k NOT IN (7, 8)""",
    "ox_walk": """
WITH RECURSIVE walk AS (
  SELECT DISTINCT comp, comp AS at, 1 AS len FROM ox_comp
  UNION SELECT w.comp, s.dep, w.len + 1 FROM walk w JOIN ox_step s ON s.comp = w.at)
SELECT comp, len FROM walk""",
    "ox_levels": """
SELECT c.code AS code, CASE WHEN c.k IN (7, 8) THEN NULL ELSE CAST(l.level AS BIGINT) END AS level
FROM fx_courses c JOIN (SELECT comp, max(len) AS level FROM ox_walk GROUP BY comp) l ON l.comp = CASE WHEN c.k >= 30 AND c.k % 10 = 9 AND c.k + 1 < (SELECT count(*) FROM fx_courses) THEN c.k + 1 ELSE c.k END""",
    "ox_has": """
SELECT t.student AS student, t.code AS code, s.shape AS shape, s.a AS a, s.b AS b, s.c AS c,
       ha.code IS NOT NULL AS has_a, hb.code IS NOT NULL AS has_b, hc.code IS NOT NULL AS has_c, p.student IS NOT NULL AS has_p, me.code IS NOT NULL AS done
FROM fx_targets t
LEFT JOIN fx_shape_codes s ON s.owner = t.code
LEFT JOIN fx_completed ha ON ha.student = t.student AND ha.code = s.a
LEFT JOIN fx_completed hb ON hb.student = t.student AND hb.code = s.b
LEFT JOIN fx_completed hc ON hc.student = t.student AND hc.code = s.c
LEFT JOIN (SELECT DISTINCT student, substr(code, 1, 4) AS subject FROM fx_completed WHERE substr(code, 6, 1) >= '3') p ON p.student = t.student AND p.subject = s.a_subject
LEFT JOIN fx_completed me ON me.student = t.student AND me.code = t.code""",
    "ox_status": """
SELECT student, code, CASE
  WHEN done THEN 'completed' WHEN shape IS NULL THEN 'met'
  WHEN shape = 7 THEN CASE WHEN has_a THEN 'unknown' ELSE 'unmet' END
  WHEN CASE shape WHEN 1 THEN has_a WHEN 2 THEN has_a OR has_b WHEN 3 THEN has_a AND has_b WHEN 4 THEN has_a AND (has_b OR has_c)
       WHEN 5 THEN has_a OR has_b WHEN 6 THEN has_p ELSE has_a END THEN 'met' ELSE 'unmet' END AS status
FROM ox_has""",
    "ox_program": "SELECT p.*, CAST(3 + k % 2 AS STRING) AS credits FROM fx_owned p",
    "ox_rel": """
SELECT p.program AS program, n.code AS source, n.owner AS target, n.relation AS relation, r.raw AS raw, n.path AS path,
       CASE WHEN s.shape IN (3, 7) AND n.relation = 'prerequisite' THEN 1 + CAST(substr(n.path, 3, 1) AS BIGINT)
            WHEN s.shape = 4 AND n.relation = 'prerequisite' THEN CASE WHEN n.path = '0.0' THEN 1 ELSE 2 END ELSE 1 END AS grp
FROM ox_program p JOIN ox_nodes n ON n.owner = p.code AND n.kind = 'course'
JOIN fx_requirements r ON r.owner = n.owner AND r.relation = n.relation
LEFT JOIN fx_shape_codes s ON s.owner = p.code""",
    "ox_totals": """
SELECT program, sum(credits::INT) AS low, sum(credits::INT) + 1 AS high FROM (
  SELECT program, credits FROM ox_program UNION ALL SELECT program, '3' FROM ox_program WHERE rn = 2) t GROUP BY program""",
}

ORACLES: dict[str, str] = {}


def _add(name: str, body: str) -> None:
    nested = f"SELECT * FROM ({body.strip()}) q" if body.lstrip().startswith("WITH") else body
    ORACLES[name] = fixtures.sql(nested, VIEWS)


# ---- text functions -------------------------------------------------------------------------
_add("b_clean_text", f"SELECT doc_id, CAST(length(t) AS BIGINT) AS n, sha256(t) AS clean FROM (SELECT doc_id, {_clean('text')} AS t FROM documents)")
_add("b_course_refs", f"""
WITH d AS ({REFERRING})
SELECT id, CAST(i - 1 AS BIGINT) AS position, upper(regexp_replace(hits[i], '^([A-Za-z]{{4}})(?:{_WS}|[-_])*([0-9]{{4}}[A-Za-z]?)$', '\\1 \\2')) AS ref
FROM (SELECT id, hits, unnest(range(1, len(hits) + 1)) AS i FROM (
  SELECT id, regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9])', '\\1\\1', 'g'),
    '(?:^|[^A-Za-z0-9])([A-Za-z]{{4}}{_WS}*(?:--|__)?{_WS}*[0-9]{{4}}[A-Za-z]?)(?:$|[^A-Za-z0-9])', 1) AS hits FROM d) a) b""")
_KIND = "CASE k % 6 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} ELSE {5} END"
_LOOSE = _KIND.format("code", "replace(code, ' ', '-')", "code", "code || 'H'", "substr(code, 2)", "'NOT ' || code")
_VALID = _KIND.format("code", "NULL", "code", "code || 'H'", "substr(code, 2)", "NULL")
_add("b_codes", f"""
SELECT k, {_KIND.format("code", "code", "code", "code || 'H'", "NULL", "NULL")} AS strict, {_LOOSE} AS loose, {_VALID} AS valid,
       CASE k % 6 WHEN 1 THEN NULL WHEN 4 THEN CAST(substr(code, 6, 1) AS BIGINT) WHEN 5 THEN NULL ELSE CAST(substr(code, 6, 1) AS BIGINT) END AS level FROM fx_courses""")
_add("b_code_lists", f"""
SELECT k, array_to_string(list_sort(list_distinct(list_filter([code, {_VALID}, 'ZZ 0000'], lambda x: x IS NOT NULL))), ',') AS codes FROM fx_courses""")
_add("b_labels", f"""
WITH t AS ({TITLES})
SELECT k, regexp_replace(replace(lower(title), '(s)', 's'), '[^a-z0-9]+', '', 'g') AS label_key,
       trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
       trim(regexp_replace(lower(replace(title, '(s)', 's')), '[^a-z0-9]+', '-', 'g'), '-') AS section_slug,
       replace(title, '(s)', 's') AS human, CAST(k % 4 AS BIGINT) AS choices,
       CASE WHEN k % 4 > 1 THEN 'Choose ' || CAST(k % 4 AS STRING) ELSE 'Choose one' END || ' | OR' AS or_label, 'Complete all | AND' AS and_label,
       CASE k % 9 WHEN 0 THEN 'option' WHEN 1 THEN 'track' WHEN 2 THEN 'stream' WHEN 3 THEN 'specialization' WHEN 4 THEN 'concentration' WHEN 5 THEN 'area' WHEN 6 THEN 'courses' WHEN 7 THEN 'option' ELSE 'other' END AS branch_kind
FROM t""")
_add("b_credits", """
SELECT k, CASE k % 4 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.5::DOUBLE END AS low, CASE k % 4 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 6.0::DOUBLE WHEN 2 THEN 4.0::DOUBLE END AS high,
       CASE k % 4 WHEN 0 THEN '3' WHEN 1 THEN '3-6' WHEN 2 THEN '1.5-4' ELSE '' END AS shown FROM fx_courses""")
_add("b_page_text", f"""
SELECT page_id, sha256({_clean(_decoded("regexp_replace(html, '<[^>]*>', ' ', 'g')"))}) AS plain,
       sha256(trim(regexp_replace(html, '{_WS}+', ' ', 'g'))) AS hash FROM pages""")
_reduced = "regexp_replace(raw, '[^()\\[\\]]', '', 'g')"
for _ in range(4):
    _reduced = f"replace(replace({_reduced}, '()', ''), '[]', '')"
_add("b_grouping", f"WITH t AS ({BROKEN}) SELECT owner, {_reduced} = '' AS balanced FROM t")
_add("b_unique_ids", """
WITH r AS (SELECT k % 25 AS program, k AS pos, replace(title, ' ', '-') AS base, row_number() OVER (PARTITION BY k % 25, title ORDER BY k) AS n FROM fx_courses)
SELECT program, pos, CASE WHEN base LIKE '%ring%' THEN base || '-' || CAST(n + 1 AS STRING) WHEN n = 1 THEN base ELSE base || '-' || CAST(n AS STRING) END AS id FROM r""")

# ---- sources --------------------------------------------------------------------------------
_add("a_subjects", f"SELECT DISTINCT '{YEAR}' AS year, subject AS code, 'Study & use of ' || subject AS name, 'https://catalog.example.org/ugcourse/{YEAR}/' || subject || '/' AS source_url FROM fx_courses")
_add("a_rejected_pages", "SELECT 'not the subject index of the year' AS reason, count(*) AS n FROM pages")
_add("a_course_pages", "SELECT code, subject, number, title, credits, 'About ' || title AS description, source_url FROM ox_courses")
_add("a_page_requirements", "SELECT owner, relation, raw FROM fx_requirements")
_add("a_programs", "SELECT DISTINCT subject AS program_code FROM fx_courses")
_add("a_sources", """
SELECT code AS program_code, CASE WHEN k % 5 <> 0 THEN 'Study of ' || title || ' & more' END AS title, CASE WHEN k % 5 <> 0 THEN '2025-26' END AS intake,
       CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'https://docs.example.org/ug/first.pdf' ELSE 'https://docs.example.org/ug/' || number || '.pdf' END AS document_url,
       CASE WHEN k % 5 = 0 THEN 'no requirement document linked' END AS reason FROM fx_courses""")
_add("a_lines", """
SELECT doc_id AS program, CAST(len(string_split(t, chr(10))) AS BIGINT) AS lines, CAST(length(replace(t, chr(10), '')) AS BIGINT) AS chars
FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)""")
_add("a_catalog_trees", "SELECT owner, relation, path, parent_path, kind, code, qualifier, pat_subject, pat_min_level, text, mandatory FROM ox_nodes")
_add("a_catalog_files", """
SELECT c.code AS code, c.title AS title, c.credits AS credits, coalesce(r.n, 0) AS stated, coalesce(m.n, 0) AS nodes FROM ox_courses c
LEFT JOIN (SELECT owner, count(*) AS n FROM fx_requirements GROUP BY owner) r ON r.owner = c.code LEFT JOIN (SELECT owner, count(*) AS n FROM ox_nodes GROUP BY owner) m ON m.owner = c.code""")
_add("a_catalog_fallback", f"""
SELECT {YEAR_OF} AS year, c.code AS code, CASE k % 5 WHEN 0 THEN c.title || ' (revised)' WHEN 3 THEN NULL ELSE c.title END AS title,
       CASE WHEN k % 5 = 3 THEN CAST(0 AS BIGINT) ELSE coalesce(m.n, 0) END AS nodes, CAST(v.version AS BIGINT) AS version, v.state AS state, v.second AS second, v.third AS third
FROM ox_courses c LEFT JOIN (SELECT owner, count(*) AS n FROM ox_nodes GROUP BY owner) m ON m.owner = c.code
JOIN (VALUES (0, 2, 'current', 'changed', 'unchanged'), (1, 1, 'fallback', 'changed', 'changed'), (2, 1, 'fallback', 'changed', 'changed'),
 (3, NULL, 'unreadable', 'changed', 'changed'), (4, 1, 'current', 'unchanged', 'unchanged')) AS v(m, version, state, second, third) ON v.m = c.k % 5""")
_add("a_snapshots", f"SELECT student, '{YEAR}' AS year, 'completed' AS kind, code FROM fx_completed UNION ALL SELECT student, '{YEAR}', 'targets', code FROM fx_targets")
_add("a_snapshot_checks", """
SELECT c_custkey AS student, v.outcome AS outcome FROM customer JOIN (VALUES (0, 'not valid JSON'), (1, 'not a snapshot'), (2, 'exported by another application'), (3, 'no usable data'),
 (5, '2025-26|targets|COMP 2211'), (5, '2025-26|completed|COMP 1023'), (6, '2026-27|targets|COMP 2211'), (6, '2026-27|focus|COMP 1023'), (6, 'program CPEG'), (7, 'theme dark')) AS v(m, outcome) ON v.m = c_custkey % 8""")

# ---- requirement text -----------------------------------------------------------------------
_add("c_req_nodes", "SELECT owner, relation, path, parent_path, kind, code, qualifier, pat_subject, pat_min_level, text, mandatory FROM ox_nodes")
_broken = f"WITH t AS ({BROKEN}) SELECT b.owner AS owner, raw, s.shape AS shape, {_reduced} = '' AS fine FROM t b JOIN fx_shape_codes s ON s.owner = b.owner"
_add("c_status", f"""
SELECT owner, CASE WHEN fine THEN 'parsed' ELSE 'partial' END AS status, CASE WHEN fine THEN '' ELSE '{WARN_GROUPING}; {WARN_CONNECTOR}' END AS warnings FROM ({_broken}) q""")
_add("c_course_refs", "SELECT owner, relation, code AS ref, CAST(row_number() OVER (PARTITION BY owner, relation ORDER BY path) - 1 AS BIGINT) AS position FROM ox_nodes WHERE kind = 'course'")
_add("c_mandatory_refs", "SELECT owner, relation, code AS ref FROM ox_nodes WHERE kind = 'course' AND mandatory")
_add("c_subject_refs", "SELECT DISTINCT owner, relation, coalesce(pat_subject, substr(code, 1, 4)) AS subject FROM ox_nodes WHERE kind IN ('course', 'coursePattern')")
_add("c_notes", """
SELECT s.k AS k, v.path AS path, v.parent_path AS parent_path, v.kind AS kind, CASE v.pick WHEN 'a' THEN s.a WHEN 'b' THEN s.b WHEN 'c' THEN s.c END AS code
FROM fx_shape_codes s JOIN (VALUES (1, '0', NULL, 'course', 'a'),
 (2, '0', NULL, 'or', NULL), (2, '0.0', '0', 'course', 'a'), (2, '0.1', '0', 'course', 'b'),
 (3, '0', NULL, 'and', NULL), (3, '0.0', '0', 'course', 'a'), (3, '0.1', '0', 'course', 'b'),
 (4, '0', NULL, 'and', NULL), (4, '0.0', '0', 'course', 'a'), (4, '0.1', '0', 'or', NULL), (4, '0.1.0', '0.1', 'course', 'b'), (4, '0.1.1', '0.1', 'course', 'c'),
 (6, '0', NULL, 'or', NULL), (6, '0.0', '0', 'and', NULL), (6, '0.0.0', '0.0', 'or', NULL), (6, '0.0.0.0', '0.0.0', 'course', 'a'), (6, '0.0.0.1', '0.0.0', 'course', 'b'),
 (6, '0.0.1', '0.0', 'course', 'c'), (6, '0.1', '0', 'course', 'a')) AS v(shape, path, parent_path, kind, pick) ON v.shape = s.shape""")

# ---- catalog --------------------------------------------------------------------------------
_add("d_search", """
WITH q AS (SELECT DISTINCT lower(subject) AS query, subject AS q FROM fx_courses UNION SELECT split_part(title, ' ', 2), upper(split_part(title, ' ', 2)) FROM fx_courses UNION SELECT replace(lower(code), ' ', ''), code FROM fx_courses),
hits AS (SELECT query, code, CASE WHEN code = q THEN 0 WHEN starts_with(code, q) THEN 1 ELSE 2 END AS rank FROM q JOIN fx_courses ON contains(code, q) OR contains(upper(title), q))
SELECT query, code, CAST(rank AS BIGINT) AS rank, position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, code) AS position FROM hits) t WHERE position <= 30""")
_add("d_search_index", """
WITH q AS (SELECT DISTINCT lower(subject) AS query, subject AS q FROM fx_courses UNION SELECT split_part(title, ' ', 2), upper(split_part(title, ' ', 2)) FROM fx_courses
  UNION SELECT replace(lower(code), ' ', ''), code FROM fx_courses UNION SELECT v.query, upper(v.query) FROM (VALUES ('renewed'), (''), ('a'), ('no such thing')) AS v(query)),
c AS (SELECT code, CASE WHEN k % 3 = 1 THEN title || ' renewed' ELSE title END AS title FROM fx_courses WHERE k % 7 <> 5),
hits AS (SELECT query, code, title, CASE WHEN code = q THEN 0 WHEN starts_with(code, q) THEN 1 ELSE 2 END AS rank FROM q JOIN c ON contains(code, q) OR contains(upper(title), q))
SELECT query, code, title, CAST(rank AS BIGINT) AS rank, position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, code) AS position FROM hits) t WHERE position <= 30""")
_add("d_lookup", f"""
SELECT c.code AS code, c.title AS title, max(CASE WHEN r.relation = 'prerequisite' THEN raw END) AS prerequisite, max(CASE WHEN r.relation = 'corequisite' THEN raw END) AS corequisite,
       max(CASE WHEN r.relation = 'exclusion' THEN raw END) AS exclusion
FROM fx_courses c LEFT JOIN fx_requirements r ON r.owner = c.code WHERE c.k % 6 IN (0, 1, 2) GROUP BY c.code, c.title""")
_add("d_metadata", f"SELECT '{YEAR}' AS year, count(*) AS course_count, count(DISTINCT CASE WHEN subject NOT LIKE '%B' THEN subject END) AS subject_count, 'ready' AS status FROM fx_courses")
_add("d_warnings", f"SELECT owner, '{WARN_GROUPING}; {WARN_CONNECTOR}; Prerequisite was only partially parsed.' AS warnings FROM ({_broken}) q WHERE NOT fine")
_add("d_dependents", "SELECT ref AS reference, owner AS dependent FROM ox_pre")
_add("d_reference_edges", "SELECT owner, relation, ref FROM ox_refs")
_add("d_subject_closure", """
WITH RECURSIVE m AS (SELECT DISTINCT substr(owner, 1, 4) AS subject, coalesce(pat_subject, substr(code, 1, 4)) AS ref FROM ox_nodes WHERE kind IN ('course', 'coursePattern')),
known AS (SELECT DISTINCT subject FROM fx_courses),
r AS (SELECT subject FROM known WHERE subject IN ('ABCA', 'ACBA') UNION SELECT m.ref FROM r JOIN m ON m.subject = r.subject JOIN known k ON k.subject = m.ref)
SELECT k.subject AS subject, r.subject IS NOT NULL AS fetched FROM known k LEFT JOIN r ON r.subject = k.subject""")

# ---- graphs ---------------------------------------------------------------------------------
_add("e_backward_d2", "SELECT root, code, CAST(distance AS BIGINT) AS distance FROM ox_back2")
_walk_all = """
WITH RECURSIVE r AS (SELECT code AS root, code, 0 AS distance FROM fx_courses
  UNION SELECT r.root, p.ref, r.distance + 1 FROM r JOIN ox_known p ON p.owner = r.code WHERE r.distance < 20)
SELECT root, code, CAST(min(distance) AS BIGINT) AS distance FROM r GROUP BY root, code"""
VIEWS["ox_known"] = "SELECT p.owner AS owner, p.ref AS ref FROM ox_pre p JOIN fx_courses c ON c.code = p.ref"
_add("e_backward_all", _walk_all)
_add("e_forward_d2", """
SELECT root, code, CAST(min(distance) AS BIGINT) AS distance FROM (
  SELECT code AS root, code, 0 AS distance FROM fx_courses UNION ALL SELECT p.ref, p.owner, 1 FROM ox_pre p JOIN fx_courses c ON c.code = p.ref
  UNION ALL SELECT p.ref, q.owner, 2 FROM ox_pre p JOIN ox_pre q ON q.ref = p.owner JOIN fx_courses c ON c.code = p.ref) t GROUP BY root, code""")
_add("e_nodes", """
WITH n AS (SELECT root, id, kind AS type, CASE WHEN kind = 'course' THEN code END AS code, owner FROM ox_graph2 UNION ALL SELECT root, 'course:' || code, 'course', code, code FROM ox_back2)
SELECT DISTINCT n.root AS root, n.id AS id, n.type AS type, n.type = 'course' AND c.code IS NULL AS placeholder, l.level AS level
FROM n LEFT JOIN fx_courses c ON c.code = n.code LEFT JOIN ox_levels l ON l.code = CASE WHEN n.type = 'course' THEN n.code ELSE n.owner END""")
_add("e_edges", """
SELECT root, source, target, relation, qualifier, mutual FROM (
  SELECT b.root AS root, e.*, row_number() OVER (PARTITION BY b.root, e.relation,
    CASE WHEN e.mutual THEN least(e.source, e.target) ELSE e.source END, CASE WHEN e.mutual THEN greatest(e.source, e.target) ELSE e.target END,
    CASE WHEN e.mutual THEN '' ELSE e.qualifier END ORDER BY b.distance, e.owner) AS rn
  FROM ox_back2 b JOIN ox_edges e ON e.owner = b.code WHERE b.distance < 2) t WHERE rn = 1""")
_add("e_forward_graph", """
SELECT DISTINCT p.ref AS root, i.id AS id, i.kind AS type FROM ox_pre p JOIN fx_courses c ON c.code = p.ref JOIN ox_ids i ON i.owner = p.owner AND i.relation = 'prerequisite'
UNION SELECT p.ref, 'course:' || p.owner, 'course' FROM ox_pre p JOIN fx_courses c ON c.code = p.ref UNION SELECT code, 'course:' || code, 'course' FROM fx_courses""")
_add("e_both", """
SELECT DISTINCT root, source, target, relation, qualifier FROM (
  SELECT owner AS root, * FROM ox_edges WHERE relation = 'prerequisite'
  UNION ALL SELECT p.ref, e.* FROM ox_pre p JOIN fx_courses c ON c.code = p.ref JOIN ox_edges e ON e.owner = p.owner AND e.relation = 'prerequisite') t""")
_add("e_truncated", """
WITH n AS (SELECT owner AS root, id FROM ox_ids UNION SELECT code, 'course:' || code FROM fx_courses)
SELECT root, least(count(*), 3) AS nodes, count(*) > 3 AS truncated FROM n GROUP BY root""")
def _capped(walk: str, owners: str) -> str:
    return f"""
WITH w AS ({walk}),
n AS (SELECT root, 'course:' || code AS id, distance - 1 AS far, '' AS owner, '' AS path FROM w
  UNION ALL SELECT o.root, i.id, o.far, i.owner, i.path FROM ({owners}) o JOIN ox_ids i ON i.owner = o.code AND i.relation = 'prerequisite'),
f AS (SELECT *, row_number() OVER (PARTITION BY root, id ORDER BY far, owner, path) AS rn FROM n)
SELECT root, id, place FROM (SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY far, owner, path, id) AS place FROM f WHERE rn = 1) t WHERE place <= 7"""


_add("e_capped", _capped(_walk_all, "SELECT root, code, distance AS far FROM w"))
_add("e_capped_forward", _capped("""
WITH RECURSIVE r AS (SELECT code AS root, code, 0 AS distance FROM fx_courses
  UNION SELECT r.root, p.owner, r.distance + 1 FROM r JOIN ox_pre p ON p.ref = r.code WHERE r.distance < 20)
SELECT root, code, CAST(min(distance) AS BIGINT) AS distance FROM r GROUP BY root, code""", "SELECT root, code, distance - 1 AS far FROM w WHERE distance > 0"))
_add("e_diagnostics", """
SELECT DISTINCT root, 'unresolved' AS type, 'Some referenced courses are not present in the cached catalog' AS message, 'ZZZZ 9999' AS courses FROM ox_graph2 WHERE code = 'ZZZZ 9999'
UNION ALL
SELECT DISTINCT n.root, 'cycle', 'Prerequisite cycle prevents authoritative level calculation', (SELECT min(code) || ',' || max(code) FROM fx_courses WHERE k IN (7, 8))
FROM (SELECT root, code FROM ox_graph2 WHERE kind = 'course' UNION SELECT root, code FROM ox_back2) n JOIN fx_courses c ON c.code = n.code WHERE c.k IN (7, 8)""")
_add("e_root_check", f"""
WITH asked AS (SELECT raw AS requested, {_KIND.format("code", "code", "code", "code || 'H'", "NULL", "NULL")} AS code FROM ({RAW_CODES}) x
  UNION ALL SELECT substr(code, 1, 4) || ' 0' || substr(code, 7, 3), substr(code, 1, 4) || ' 0' || substr(code, 7, 3) FROM fx_courses)
SELECT DISTINCT a.code AS root, NULL AS error FROM asked a JOIN fx_courses c ON c.code = a.code
UNION ALL SELECT requested, CASE WHEN a.code IS NULL THEN 'invalid_course_code' ELSE 'course_not_found' END FROM asked a LEFT JOIN fx_courses c ON c.code = a.code WHERE c.code IS NULL""")
_add("e_load_report", """
WITH a AS (SELECT DISTINCT k % 50 AS grp, CASE WHEN k % 7 = 0 THEN 'ZZZZ 0' || substr(code, 7, 3) WHEN k % 7 = 1 THEN 'bad ' || code ELSE code END AS root, k % 7 > 1 AS fine FROM fx_courses)
SELECT grp, CAST(count(*) FILTER (WHERE fine) AS BIGINT) AS loaded, count(*) AS asked, coalesce(string_agg(CASE WHEN NOT fine THEN root END, ',' ORDER BY root), '') AS failed FROM a GROUP BY grp""")
_PROJECTED = """
SELECT owner AS root, CASE WHEN relation = 'exclusion' THEN 'course:' || owner ELSE id END AS source, CASE WHEN relation = 'exclusion' THEN id ELSE 'course:' || owner END AS target,
       relation, coalesce(qualifier, '') AS qualifier, relation <> 'prerequisite' AS mutual FROM ox_ids WHERE kind NOT IN ('any', 'all')"""
_add("e_projection", _PROJECTED)
_add("e_leaf_projection", f"SELECT DISTINCT source, target, relation, qualifier, mutual FROM ({_PROJECTED} AND kind = 'course') t")
_add("e_visible", "SELECT DISTINCT owner AS root, id FROM ox_ids WHERE relation <> 'exclusion' AND kind NOT IN ('any', 'all') UNION SELECT code, 'course:' || code FROM fx_courses")
_add("e_visible_diagnostics", """
SELECT DISTINCT owner AS root, 'unresolved' AS type, 'ZZZZ 9999' AS courses FROM ox_ids WHERE code = 'ZZZZ 9999'
UNION ALL
SELECT DISTINCT n.root, 'cycle', (SELECT min(code) || ',' || max(code) FROM fx_courses WHERE k IN (7, 8))
FROM (SELECT owner AS root, code FROM ox_ids WHERE kind = 'course' AND relation <> 'exclusion' UNION SELECT code, code FROM fx_courses) n JOIN fx_courses c ON c.code = n.code WHERE c.k IN (7, 8)""")
_add("e_direct_dependents", "SELECT p.ref AS root, 'course:' || p.owner AS id FROM ox_pre p JOIN fx_courses c ON c.code = p.ref")
_add("e_groups", """
SELECT DISTINCT i.owner AS root, CASE WHEN s.shape IN (3, 7) THEN i.id WHEN s.shape = 4 THEN CASE WHEN i.path = '0.0' THEN i.id ELSE 'bool:' || i.owner || ':prerequisite:0.1' END ELSE '' END AS arm, i.id AS id
FROM ox_ids i JOIN fx_shape_codes s ON s.owner = i.owner WHERE i.relation = 'prerequisite' AND i.kind = 'course'""")
_add("e_groups_d2", """
SELECT DISTINCT owner AS root, 'course:' || ref AS id FROM ox_pre
UNION SELECT p.owner, 'course:' || q.ref FROM ox_pre p JOIN ox_pre q ON q.owner = p.ref""")
_add("e_relation", """
WITH ranked AS (SELECT owner, id, relation, CASE relation WHEN 'prerequisite' THEN 0 WHEN 'corequisite' THEN 1 ELSE 2 END AS o, kind FROM ox_ids),
touch AS (SELECT owner AS root, id, min(o) AS o FROM ranked WHERE kind = 'course' GROUP BY owner, id UNION ALL SELECT owner, 'course:' || owner, min(o) FROM ranked GROUP BY owner)
SELECT owner AS root, id, relation AS shown_relation FROM ranked WHERE kind <> 'course'
UNION ALL SELECT root, id, CASE min(o) WHEN 0 THEN 'prerequisite' WHEN 1 THEN 'corequisite' ELSE 'exclusion' END FROM touch GROUP BY root, id
UNION ALL SELECT code, 'course:' || code, '' FROM fx_courses WHERE code NOT IN (SELECT owner FROM ox_ids)""")
_add("e_outline", """
WITH ranked AS (SELECT owner AS root, code, min(CASE relation WHEN 'prerequisite' THEN 0 WHEN 'corequisite' THEN 1 ELSE 2 END) AS o FROM ox_ids WHERE kind = 'course' GROUP BY owner, code),
listed AS (SELECT root, code, CASE o WHEN 0 THEN 'Prerequisite' WHEN 1 THEN 'Corequisite' ELSE 'Exclusion' END AS kind FROM ranked UNION ALL SELECT code, code, 'Selected' FROM fx_courses)
SELECT t.root AS root, l.level AS level, t.code AS code, t.kind AS kind, row_number() OVER (PARTITION BY t.root, l.level ORDER BY t.code) AS position FROM listed t LEFT JOIN ox_levels l ON l.code = t.code""")
_add("e_components", """
SELECT c.code AS code, CASE WHEN p.code IS NOT NULL THEN least(p.code, c.code) WHEN n.code IS NOT NULL THEN least(n.code, c.code) ELSE c.code END AS component
FROM fx_courses c LEFT JOIN fx_courses p ON c.k >= 30 AND c.k % 10 = 0 AND p.k = c.k - 1 LEFT JOIN fx_courses n ON n.k >= 30 AND n.k % 10 = 0 AND n.k = c.k + 1""")
_add("e_levels", "SELECT code, level FROM ox_levels")
_add("e_cycles", "SELECT 'cycle' AS type, 'prerequisite' AS relation, min(code) || ',' || max(code) AS courses FROM fx_courses WHERE k IN (7, 8)")
_add("e_merge", """
SELECT DISTINCT t.student AS student, i.id AS id, i.kind AS type FROM fx_targets t JOIN ox_ids i ON i.owner = t.code UNION SELECT student, 'course:' || code, 'course' FROM fx_targets""")
_add("e_merge_edges", """
SELECT student, relation, count(*) AS edges FROM (SELECT DISTINCT t.student AS student, e.relation AS relation,
  CASE WHEN e.mutual THEN least(e.source, e.target) ELSE e.source END AS x, CASE WHEN e.mutual THEN greatest(e.source, e.target) ELSE e.target END AS y, e.qualifier AS q
  FROM fx_targets t JOIN ox_edges e ON e.owner = t.code) d GROUP BY student, relation""")

# ---- verdicts -------------------------------------------------------------------------------
_add("f_status", "SELECT student, code, status FROM ox_status")
_add("f_completions", f"SELECT DISTINCT k % 100 AS student, {_VALID} AS code FROM fx_courses WHERE {_VALID} IS NOT NULL")
_add("f_verdicts", """
SELECT t.student AS student, t.code AS owner, r.relation AS relation, CASE WHEN c.code IS NOT NULL THEN 'met' ELSE 'unmet' END AS status
FROM fx_targets t JOIN ox_refs r ON r.owner = t.code AND r.relation <> 'prerequisite' LEFT JOIN fx_completed c ON c.student = t.student AND c.code = r.ref""")
_add("f_pattern", "SELECT student, code AS owner, has_p AS verdict FROM ox_has WHERE shape = 6")
_add("f_junction", """
WITH v AS (SELECT h.*, CASE WHEN ta.code IS NULL THEN has_a END AS va, CASE WHEN tb.code IS NULL THEN has_b END AS vb, CASE WHEN tc.code IS NULL THEN has_c END AS vc
  FROM ox_has h LEFT JOIN fx_targets ta ON ta.student = h.student AND ta.code = h.a LEFT JOIN fx_targets tb ON tb.student = h.student AND tb.code = h.b LEFT JOIN fx_targets tc ON tc.student = h.student AND tc.code = h.c)
SELECT student, code AS owner, CASE shape WHEN 2 THEN coalesce(va, false) OR coalesce(vb, false) WHEN 5 THEN coalesce(va, false) OR coalesce(vb, false)
  WHEN 3 THEN CASE WHEN va IS NULL AND vb IS NULL THEN false ELSE coalesce(va, true) AND coalesce(vb, true) END
  WHEN 4 THEN coalesce(va, true) AND (coalesce(vb, false) OR coalesce(vc, false)) WHEN 7 THEN false ELSE coalesce(va, false) END AS satisfied
FROM v WHERE shape IN (2, 3, 4, 5, 7, 8)""")

_PRUNED = """
WITH RECURSIVE vals AS (
  SELECT DISTINCT t.student AS student, i.id AS id, i.kind AS kind,
    CASE i.kind WHEN 'course' THEN d.code IS NOT NULL WHEN 'coursePattern' THEN h.has_p WHEN 'condition' THEN false
      ELSE CASE WHEN i.path = '0.1' THEN h.has_b OR h.has_c WHEN h.shape IN (2, 5) THEN h.has_a OR h.has_b WHEN h.shape = 3 THEN h.has_a AND h.has_b
        WHEN h.shape = 4 THEN h.has_a AND (h.has_b OR h.has_c) WHEN h.shape = 8 THEN h.has_a ELSE false END END AS met,
    CASE i.kind WHEN 'course' THEN d.code IS NOT NULL WHEN 'coursePattern' THEN false WHEN 'condition' THEN false
      ELSE CASE WHEN i.path = '0.1' THEN h.has_b OR h.has_c WHEN h.shape IN (2, 3, 5) THEN h.has_a OR h.has_b WHEN h.shape = 4 THEN h.has_a OR h.has_b OR h.has_c ELSE h.has_a END END AS done
  FROM fx_targets t JOIN ox_ids i ON i.owner = t.code LEFT JOIN ox_has h ON h.student = t.student AND h.code = t.code
  LEFT JOIN fx_completed d ON d.student = t.student AND d.code = i.code
  UNION SELECT t.student, 'course:' || t.code, 'course', d.code IS NOT NULL, d.code IS NOT NULL FROM fx_targets t LEFT JOIN fx_completed d ON d.student = t.student AND d.code = t.code),
links AS (
  SELECT DISTINCT t.student AS student, e.target AS parent, e.source AS child, e.relation AS relation FROM fx_targets t JOIN ox_edges e ON e.owner = t.code AND e.relation <> 'exclusion'),
wide AS (
  SELECT l.*, p.kind AS p_kind, p.met AS p_met, p.done AS p_done, c.kind AS c_kind, c.met AS met, c.done AS done, bool_or(c.met) OVER (PARTITION BY l.student, l.parent, l.relation) AS some_met
  FROM links l JOIN vals p ON p.student = l.student AND p.id = l.parent JOIN vals c ON c.student = l.student AND c.id = l.child),
moves AS (
  SELECT student, parent, child, c_kind, met, done, 'consider' AS mark, CASE WHEN met THEN 'sat' WHEN some_met THEN 'drop' ELSE 'need' END AS raw FROM wide WHERE p_kind = 'course'
  UNION ALL SELECT student, parent, child, c_kind, met, done, 'sat', CASE WHEN met THEN 'sat' WHEN p_kind = 'all' THEN 'need' ELSE 'drop' END FROM wide WHERE p_kind IN ('all', 'any')
  UNION ALL SELECT student, parent, child, c_kind, met, done, 'need', 'need' FROM wide WHERE p_kind IN ('all', 'any') AND NOT p_met
  UNION ALL SELECT student, parent, child, c_kind, met, done, 'paths', CASE WHEN done THEN 'paths' ELSE 'drop' END FROM wide WHERE p_kind IN ('all', 'any')
  UNION ALL SELECT student, parent, child, c_kind, met, done, 'drop', 'drop' FROM wide WHERE NOT p_done),
entered AS (
  SELECT student, parent, mark, child, CASE WHEN c_kind = 'course' AND (raw IN ('need', 'sat', 'paths') OR (raw = 'drop' AND done)) THEN 'consider'
    WHEN raw = 'need' AND met AND c_kind IN ('all', 'any') THEN 'sat' WHEN raw = 'drop' AND done THEN 'paths' ELSE raw END AS to_mark FROM moves),
marks AS (
  SELECT DISTINCT student, 'course:' || code AS id, 'consider' AS mark FROM fx_targets
  UNION SELECT m.student, e.child, e.to_mark FROM marks m JOIN entered e ON e.student = m.student AND e.parent = m.id AND e.mark = m.mark),
hidden AS (
  SELECT m.student AS student, m.id AS id FROM marks m JOIN vals v ON v.student = m.student AND v.id = m.id GROUP BY m.student, m.id
  HAVING bool_and(m.mark = 'drop') AND NOT bool_or(v.kind = 'course' AND v.done))
"""
_add("f_prune", _PRUNED + "SELECT student, id FROM hidden")
# With dependents: from every target also up through junctions and courses; each course on the way is considered.
_CLIMBED = _PRUNED.replace("),\nmarks AS (", """
  UNION ALL SELECT DISTINCT student, child, 'climb', parent, 'climb' FROM wide
  UNION ALL SELECT DISTINCT student, child, 'climb', parent, 'consider' FROM wide WHERE p_kind = 'course'),
marks AS (""").replace("'consider' AS mark FROM fx_targets", "m.mark AS mark FROM fx_targets CROSS JOIN (VALUES ('consider'), ('climb')) AS m(mark)").replace(
    "v.id = m.id GROUP BY", "v.id = m.id WHERE m.mark <> 'climb' GROUP BY")
_add("f_prune_dependents", _CLIMBED + "SELECT student, id FROM hidden")
_add("f_active", _PRUNED + """, all_links AS (SELECT DISTINCT t.student AS student, e.source AS source, e.target AS target, e.relation AS relation FROM fx_targets t JOIN ox_edges e ON e.owner = t.code),
kept AS (SELECT v.student AS student, count(*) AS nodes FROM vals v LEFT JOIN hidden h ON h.student = v.student AND h.id = v.id WHERE h.id IS NULL GROUP BY v.student),
tied AS (SELECT l.student AS student, count(*) AS edges FROM all_links l LEFT JOIN hidden a ON a.student = l.student AND a.id = l.source LEFT JOIN hidden b ON b.student = l.student AND b.id = l.target
  WHERE a.id IS NULL AND b.id IS NULL GROUP BY l.student)
SELECT k.student AS student, k.nodes AS nodes, coalesce(t.edges, 0) AS edges FROM kept k LEFT JOIN tied t ON t.student = k.student""")

# ---- programs -------------------------------------------------------------------------------
_add("g_bounds", "SELECT DISTINCT program, CAST(1 AS BIGINT) AS start, CAST(800 AS BIGINT) AS stop, CAST(900 AS BIGINT) AS finish FROM fx_owned")
_NOTE = "'Note: ' || p.code || ' OR ' || q.code"
_add("g_rows", f"""
SELECT program, CAST(100 + rn AS BIGINT) AS line_no, false AS child, subject, number, false AS note, title AS text, credits FROM ox_program
UNION ALL SELECT program, CAST(50 + rn AS BIGINT), true, subject, number, false, title, credits FROM ox_program WHERE rn IN (1, 2)
UNION ALL SELECT p.program, 50, false, p.subject, NULL, true, {_NOTE}, '3-4' FROM fx_owned p JOIN fx_owned q ON p.program = q.program AND p.rn = 1 AND q.rn = 2""")
_add("g_sections", "SELECT program, 'Required Course(s)' AS title, CAST(low AS STRING) || '-' || CAST(high AS STRING) AS credits FROM ox_totals")
_add("g_tree", f"""
SELECT program, '0.' || CAST(rn - 2 AS STRING) AS path, '0' AS parent_path, 'course' AS kind, code, NULL AS note FROM ox_program WHERE rn > 2
UNION ALL SELECT program, '0.0.' || CAST(rn - 1 AS STRING), '0.0', 'course', code, NULL FROM ox_program WHERE rn <= 2
UNION ALL SELECT p.program, '0.0', '0', 'or', NULL, {_NOTE} FROM fx_owned p JOIN fx_owned q ON p.program = q.program AND p.rn = 1 AND q.rn = 2""")
_add("g_courses", "SELECT program, code, CASE WHEN rn <= 2 THEN title ELSE '' END AS title, CASE WHEN rn <= 2 THEN credits ELSE '' END AS credits FROM ox_program")
_BRANCHES = """(VALUES (1, 'branch:01:track', 'track', 'Embedded Systems Track', NULL), (2, 'branch:02:area', 'area', 'Networking Area', 'branch:01:track'), (3, 'branch:03:option', 'option', 'Robotics Option', NULL)) AS v(number, id, kind, title, parent)"""
_add("g_branches", f"SELECT DISTINCT program, CAST(v.number AS BIGINT) AS number, v.id AS id, v.kind AS kind, v.title AS title, v.parent AS parent, 'Track Study' AS grp, '' AS rule, NULL AS credits FROM fx_owned CROSS JOIN {_BRANCHES}")
_add("g_branch_courses", "SELECT program, CASE rn WHEN 3 THEN 'branch:01:track' WHEN 5 THEN 'branch:03:option' ELSE 'branch:02:area' END AS id, code, title, credits FROM ox_program WHERE rn BETWEEN 3 AND 6")
_add("g_relation_groups", """
SELECT n.owner AS owner, n.relation AS relation, n.code AS ref,
       CASE WHEN n.relation = 'prerequisite' AND s.shape IN (3, 7) THEN 1 + CAST(substr(n.path, 3, 1) AS BIGINT) WHEN n.relation = 'prerequisite' AND s.shape = 4 THEN CASE WHEN n.path = '0.0' THEN 1 ELSE 2 END ELSE 1 END AS grp,
       row_number() OVER (PARTITION BY n.owner, n.relation ORDER BY n.path) - 1 AS position
FROM ox_nodes n LEFT JOIN fx_shape_codes s ON s.owner = n.owner WHERE n.kind = 'course'""")
_add("g_relations", "SELECT program, source, target, relation, grp, raw FROM ox_rel")
_add("g_reconcile_sections", """
WITH t AS (SELECT program, CAST(low AS STRING) || '-' || CAST(high AS STRING) || ' credits' AS credits FROM ox_totals)
SELECT program, CASE WHEN program % 2 = 0 THEN 'core-' || CAST(program AS STRING) ELSE 'required-courses' END AS id, CASE WHEN program % 2 = 0 THEN 'Core' ELSE 'Required Courses' END AS eyebrow,
       CASE WHEN program % 2 = 0 THEN 'The core' ELSE 'Required Courses' END AS title, CASE WHEN program % 2 = 0 THEN 'group:core' ELSE 'group:required-courses' END AS root_group,
       CASE WHEN program % 2 = 0 THEN 'text' END AS copy, credits, NULL AS change FROM t
UNION ALL SELECT program, NULL, NULL, NULL, NULL, NULL, NULL, 'section core-' || CAST(program AS STRING) || ' credits 1 credits -> ' || credits FROM t WHERE program % 4 = 0""")
_add("g_reconcile_courses", """
WITH o AS (SELECT program, code, substr(code, 9, 1) AS n FROM ox_program)
SELECT program, 'course ' || code || ' added to required-courses' AS change FROM o WHERE n IN ('1', '2')
UNION ALL SELECT program, 'course ' || code || ' moved to required-courses' FROM o WHERE n = '3'
UNION ALL SELECT program, 'course ' || code || ' title updated from catalog' FROM o WHERE n = '4'
UNION ALL SELECT program, 'course OLDX ' || substr(code, 6, 4) || ' removed (no longer required)' FROM o WHERE n = '2'""")
_add("g_groups", """
SELECT DISTINCT program, 'group:required-courses' AS id, 'Required Courses | AND' AS label, 'and' AS kind, NULL AS parent FROM fx_owned
UNION ALL SELECT DISTINCT program, 'group:required-courses:or-1', 'Choose one | OR', 'or', 'group:required-courses' FROM fx_owned""")
_add("g_members", "SELECT program, code, CASE WHEN rn <= 2 THEN 'group:required-courses:or-1' ELSE 'group:required-courses' END AS parent FROM ox_program")
_CONTEXT = "SELECT DISTINCT r.program AS program, r.source AS code, coalesce(c.title, r.source) AS title FROM ox_rel r LEFT JOIN ox_program p ON p.program = r.program AND p.code = r.source LEFT JOIN fx_courses c ON c.code = r.source WHERE p.code IS NULL"
_add("g_context", _CONTEXT)
_add("g_context_changes", f"SELECT program, 'context course ' || code || ' added' AS change FROM ({_CONTEXT}) x WHERE code LIKE '%1' UNION ALL SELECT DISTINCT program, 'context course GONE 1000 removed' FROM fx_owned")
_TOTAL = "CAST(low AS STRING) || '-' || CAST(high AS STRING)"
_add("g_totals", f"SELECT program, {_TOTAL} AS total_credits, 'total credits 40 -> ' || {_TOTAL} AS change FROM ox_totals")
_add("g_headers", f"""
SELECT program, CASE WHEN program % 3 = 0 THEN 'Q' || lpad(CAST(program AS STRING), 8, '0') || '-2024-25' ELSE 'P' || lpad(CAST(program AS STRING), 8, '0') || '-2025-26' END AS id,
       CASE WHEN program % 3 = 0 THEN 'Q' ELSE 'P' END || lpad(CAST(program AS STRING), 8, '0') AS program_code, 'Program ' || CAST(program AS STRING) AS title,
       CASE WHEN program % 3 = 0 THEN '2024-25' ELSE '2025-26' END AS intake, '{YEAR}' AS catalog_year, {_TOTAL} AS total_credits, '/doc' AS source_url, 'h' AS source_hash FROM ox_totals""")
_add("g_summary", """
SELECT t.program AS program, CASE WHEN t.program % 3 = 0 THEN 'Q' || lpad(CAST(t.program AS STRING), 8, '0') || '-2024-25' ELSE 'P' || lpad(CAST(t.program AS STRING), 8, '0') || '-2025-26' END AS id,
       CAST(1 AS BIGINT) AS sections, CAST(3 AS BIGINT) AS branches, c.n AS courses, coalesce(r.n, 0) AS relations
FROM ox_totals t JOIN (SELECT program, count(*) AS n FROM ox_program GROUP BY program) c ON c.program = t.program LEFT JOIN (SELECT program, count(*) AS n FROM ox_rel GROUP BY program) r ON r.program = t.program""")
_add("g_filter", f"""
SELECT p.program AS program, p.n AS visible_courses, coalesce(x.n, 0) AS visible_context FROM (SELECT program, count(*) AS n FROM ox_program GROUP BY program) p
LEFT JOIN (SELECT c.program AS program, count(DISTINCT c.code) AS n FROM ({_CONTEXT}) c JOIN ox_rel r ON r.program = c.program AND r.source = c.code AND r.relation = 'prerequisite' GROUP BY c.program) x ON x.program = p.program""")
_add("g_edges", """
SELECT r.program AS program, r.relation AS relation, p.code IS NULL AS context_edge, r.relation = 'prerequisite' AS enabled, count(*) AS n
FROM ox_rel r LEFT JOIN ox_program p ON p.program = r.program AND p.code = r.source GROUP BY ALL""")
_add("g_outline", f"""
SELECT p.program AS program, 'Required Courses' AS section_title, {_TOTAL} || ' credits' AS section_credits, p.code AS code, p.credits AS credits FROM ox_program p JOIN ox_totals t ON t.program = p.program""")
_add("g_branch_depth", f"SELECT DISTINCT program, v.id AS id, CASE WHEN v.parent IS NULL THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS depth FROM fx_owned CROSS JOIN {_BRANCHES}")
_add("g_ancestors", """
SELECT program, code AS id, 'group:required-courses' AS ancestor FROM ox_program UNION ALL SELECT program, code, 'group:required-courses:or-1' FROM ox_program WHERE rn <= 2
UNION ALL SELECT DISTINCT program, 'group:required-courses:or-1', 'group:required-courses' FROM fx_owned""")
_add("g_requirements", """
SELECT p.program AS program, p.code AS code, v.relation AS relation, coalesce(r.raw, '') AS raw FROM ox_program p CROSS JOIN (VALUES ('prerequisite'), ('corequisite'), ('exclusion')) AS v(relation)
LEFT JOIN (SELECT DISTINCT program, target, relation, raw FROM ox_rel) r ON r.program = p.program AND r.target = p.code AND r.relation = v.relation""")
_add("g_neighborhood", """
WITH near AS (SELECT program, code AS start, code AS id FROM ox_program
  UNION SELECT r.program, r.target, r.source FROM ox_rel r WHERE relation <> 'exclusion'
  UNION SELECT r.program, r.source, r.target FROM ox_rel r JOIN ox_program p ON p.program = r.program AND p.code = r.source WHERE relation <> 'exclusion')
SELECT program, start, id FROM near
UNION SELECT n.program, n.start, 'group:required-courses' FROM near n JOIN ox_program p ON p.program = n.program AND p.code = n.id
UNION SELECT n.program, n.start, 'group:required-courses:or-1' FROM near n JOIN ox_program p ON p.program = n.program AND p.code = n.id AND p.rn <= 2""")
_add("g_relation_diff", """
SELECT DISTINCT program, target, relation, relation = 'exclusion' AS undeclared FROM ox_rel
WHERE (relation = 'exclusion' AND target LIKE '%3') OR raw LIKE '% AND %'""")
_add("g_progress", """
WITH s AS (SELECT c_custkey AS student, c_custkey % n AS program FROM customer, (SELECT count(DISTINCT program) AS n FROM ox_program) x),
held AS (SELECT s.student AS student, s.program AS program, CASE WHEN p.rn <= 2 THEN 0 ELSE p.rn - 2 END AS item, bool_or(d.code IS NOT NULL) AS ok
  FROM s JOIN ox_program p ON p.program = s.program LEFT JOIN fx_completed d ON d.student = s.student AND d.code = p.code GROUP BY 1, 2, 3)
SELECT student, CAST(program AS INT) AS program, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS met, count(*) AS items, CASE WHEN bool_and(ok) THEN 'met' ELSE 'unmet' END AS status FROM held GROUP BY student, program""")

_add("a_program_files", f"""
WITH h AS (SELECT t.program AS program, {_TOTAL} AS total_credits,
    CASE WHEN t.program % 3 = 0 THEN 'Q' || lpad(CAST(t.program AS STRING), 8, '0') || '-2024-25' ELSE 'P' || lpad(CAST(t.program AS STRING), 8, '0') || '-2025-26' END AS id FROM ox_totals t),
c AS (SELECT program, count(*) AS n FROM ox_program GROUP BY program), r AS (SELECT program, count(*) AS n FROM ox_rel GROUP BY program),
x AS (SELECT program, count(*) AS n FROM ({_CONTEXT}) y GROUP BY program),
k AS (SELECT h.*, CASE WHEN h.program % 7 = 5 THEN 'removed' WHEN h.program % 3 = 1 THEN 'changed' ELSE 'unchanged' END AS state FROM h)
SELECT k.id AS id, state, CASE state WHEN 'changed' THEN CAST(2 AS BIGINT) WHEN 'unchanged' THEN CAST(1 AS BIGINT) END AS version,
       CASE WHEN state <> 'removed' THEN c.n END AS courses, CASE WHEN state <> 'removed' THEN coalesce(r.n, 0) END AS relations,
       CASE WHEN state <> 'removed' THEN 'Program ' || CAST(k.program AS STRING) || CASE WHEN state = 'changed' THEN ' (revised)' ELSE '' END END AS title,
       CASE WHEN state <> 'removed' THEN total_credits END AS total_credits,
       CAST(CASE WHEN state <> 'removed' THEN 1 ELSE 0 END AS BIGINT) AS read_sections, CASE WHEN state <> 'removed' THEN c.n + 1 ELSE 0 END AS read_tree,
       CAST(CASE WHEN state <> 'removed' THEN 2 ELSE 0 END AS BIGINT) AS read_groups, CASE WHEN state <> 'removed' THEN c.n ELSE 0 END AS read_courses,
       CASE WHEN state <> 'removed' THEN coalesce(x.n, 0) ELSE 0 END AS read_context, CAST(CASE WHEN state <> 'removed' THEN 3 ELSE 0 END AS BIGINT) AS read_branches,
       CAST(CASE WHEN state <> 'removed' THEN 4 ELSE 0 END AS BIGINT) AS read_branch_courses, CASE WHEN state <> 'removed' THEN coalesce(r.n, 0) ELSE 0 END AS read_relations
FROM k JOIN c ON c.program = k.program LEFT JOIN r ON r.program = k.program LEFT JOIN x ON x.program = k.program""")

# ---- refresh --------------------------------------------------------------------------------
_add("h_diff", """
SELECT code, CASE WHEN k % 11 = 3 THEN 'added' WHEN k % 13 = 5 THEN 'removed' WHEN k % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM fx_courses WHERE NOT (k % 11 = 3 AND k % 13 = 5)""")
_add("h_fingerprint", "SELECT subject, bool_or(k % 97 = 0) AS moved FROM fx_courses GROUP BY subject")
_add("h_requirement_fingerprint", "SELECT DISTINCT program, program % 2 = 0 AS moved FROM fx_owned")
_add("h_stamp_changed", """
SELECT user_id AS program, event_id AS at_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type, false) AS changed FROM events""")
_SUBJ = "SELECT DISTINCT subject AS code FROM fx_courses"
_add("h_manifest", f"SELECT code AS program_code, CASE WHEN regexp_matches(code, '[ACEG]A$') THEN CAST(9 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS courses FROM ({_SUBJ}) s")
_add("h_scope", f"SELECT code AS program_code FROM ({_SUBJ}) s WHERE regexp_matches(code, '[A-J]A$')")
_add("h_keep_last_good", f"""
SELECT code AS program_code, CASE WHEN regexp_matches(code, 'A.?A|N$') THEN CAST(1 AS BIGINT) ELSE CAST(9 AS BIGINT) END AS courses, NULL::BOOLEAN AS kept FROM ({_SUBJ}) s
UNION ALL SELECT code, NULL, true FROM ({_SUBJ}) s WHERE regexp_matches(code, 'A.?A|N$') UNION ALL SELECT code || 'N', NULL, false FROM ({_SUBJ}) s""")
_add("h_summary", f"""
SELECT count(*) AS programs, count(*) AS courses, 2 * count(*) AS relations, 3 * count(*) AS branches, count(*) FILTER (WHERE code LIKE 'AB%') AS skipped FROM ({_SUBJ}) s""")
_add("h_violations", f"""
SELECT 'group kind' AS rule, program, CAST(2 AS BIGINT) AS n FROM ox_totals WHERE program % 5 = 0
UNION ALL SELECT 'course section', program, count(*) FROM ox_program WHERE program % 7 = 0 GROUP BY program
UNION ALL SELECT 'relation source', program, CAST(1 AS BIGINT) FROM (SELECT DISTINCT program FROM ox_rel WHERE source = 'ZZZZ 9999') z""")
_add("h_relation_drift", """
SELECT program, v.side AS side, count(*) AS n FROM ox_rel CROSS JOIN (VALUES ('stored'), ('derived')) AS v(side) WHERE program % 6 = 0 GROUP BY program, v.side""")
_add("h_round_trip", "SELECT 'unchanged' AS state, count(*) AS n FROM ox_program")

# ---- students -------------------------------------------------------------------------------
_MERGED = "SELECT coalesce(t.student, c.student) AS student, t.code IS NOT NULL AS incoming, c.code IS NOT NULL AS existing FROM fx_targets t FULL JOIN fx_completed c ON c.student = t.student AND c.code = t.code"
_add("i_merge", f"SELECT student, count(*) AS total, CAST(count(*) FILTER (WHERE NOT existing) AS BIGINT) AS added FROM ({_MERGED}) m GROUP BY student HAVING bool_or(incoming)")
_add("i_merge_skips", f"""
WITH m AS ({_MERGED})
SELECT student, CASE WHEN count(*) FILTER (WHERE existing OR student % 2 = 1) = 0 THEN NULL ELSE count(*) FILTER (WHERE existing OR student % 2 = 1) END AS codes,
       student % 2 = 0 AND bool_or(incoming) AS skipped FROM m GROUP BY student""")
_add("i_targets", """
SELECT student, code FROM fx_targets WHERE code NOT LIKE '%1'
UNION SELECT c.student, c.code FROM fx_completed c LEFT JOIN fx_targets t ON t.student = c.student AND t.code = c.code AND t.code LIKE '%1' WHERE t.code IS NULL""")
_LATEST = "SELECT student, code, done, event_id FROM (SELECT *, row_number() OVER (PARTITION BY student, code ORDER BY ts DESC, event_id DESC) AS rn FROM fx_toggles) t WHERE rn = 1"
_add("i_latest_toggle", _LATEST)
_add("i_completions", f"SELECT student, code FROM ({_LATEST}) x WHERE done")
_STATE = """SELECT user_id AS student, CASE event_type WHEN 'click' THEN 'targets' WHEN 'view' THEN 'legacy' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'focus' END AS kind,
 '20' || CAST(10 + event_id % 60 AS STRING) AS year, 'COMP ' || CAST(1000 + event_id % 500 AS STRING) AS code, event_type IN ('click', 'purchase') AND event_id % 4 = 0 AS blank FROM events"""
_add("i_buckets", f"SELECT student, kind, year, count(*) AS n FROM ({_STATE}) s WHERE kind IS NOT NULL GROUP BY student, kind, year")
_add("i_load_targets", f"""
WITH s AS ({_STATE})
SELECT DISTINCT student, year, code FROM s WHERE kind = 'targets' AND NOT blank
UNION SELECT l.student, l.year, l.code FROM s l LEFT JOIN (SELECT DISTINCT student, year FROM s WHERE kind = 'targets') m ON m.student = l.student AND m.year = l.year WHERE l.kind = 'legacy' AND m.student IS NULL""")
_add("i_export_targets", f"""
WITH s AS ({_STATE})
SELECT DISTINCT student, year, code FROM s WHERE kind = 'targets' AND NOT blank
UNION SELECT l.student, l.year, l.code FROM s l LEFT JOIN (SELECT DISTINCT student, year FROM s WHERE kind = 'targets' AND NOT blank) m ON m.student = l.student AND m.year = l.year WHERE l.kind = 'legacy' AND m.student IS NULL""")
_add("i_preferences", """
SELECT c_custkey AS student, 'focus' AS key, coalesce(t.code, 'old') AS value FROM customer LEFT JOIN (SELECT student, min(code) AS code FROM fx_targets GROUP BY student) t ON t.student = c_custkey""")
_add("i_program_choice", "SELECT c_custkey AS student, CASE c_custkey % 4 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' END AS id FROM customer")

# ---- streaming ------------------------------------------------------------------------------
_add("j_toggle_stream", f"""
WITH done AS (SELECT student, code FROM ({_LATEST}) x WHERE done),
h AS (SELECT t.student AS student, t.code AS code, s.shape AS shape, ha.code IS NOT NULL AS has_a, hb.code IS NOT NULL AS has_b, hc.code IS NOT NULL AS has_c, p.student IS NOT NULL AS has_p, me.code IS NOT NULL AS is_done
  FROM fx_targets t JOIN (SELECT DISTINCT student FROM fx_toggles) u ON u.student = t.student
  LEFT JOIN fx_shape_codes s ON s.owner = t.code
  LEFT JOIN done ha ON ha.student = t.student AND ha.code = s.a LEFT JOIN done hb ON hb.student = t.student AND hb.code = s.b LEFT JOIN done hc ON hc.student = t.student AND hc.code = s.c
  LEFT JOIN (SELECT DISTINCT student, substr(code, 1, 4) AS subject FROM done WHERE substr(code, 6, 1) >= '3') p ON p.student = t.student AND p.subject = s.a_subject
  LEFT JOIN done me ON me.student = t.student AND me.code = t.code)
SELECT student, code, CASE WHEN is_done THEN 'completed' WHEN shape IS NULL THEN 'met' WHEN shape = 7 THEN CASE WHEN has_a THEN 'unknown' ELSE 'unmet' END
  WHEN CASE shape WHEN 1 THEN has_a WHEN 2 THEN has_a OR has_b WHEN 3 THEN has_a AND has_b WHEN 4 THEN has_a AND (has_b OR has_c) WHEN 5 THEN has_a OR has_b WHEN 6 THEN has_p ELSE has_a END THEN 'met' ELSE 'unmet' END AS status FROM h""")
