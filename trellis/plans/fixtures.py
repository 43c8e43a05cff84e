"""Catalog-like tables derived from the generic test tables, as SQL that Spark and DuckDB both run.

Courses come from ``part``, requirement texts from a numeric shape per course, students from
``customer`` keys, completed and wanted courses from the order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_LETTERS = "translate(lpad(regexp_extract(p_brand, '([0-9]+)', 1), 3, '0'), '0123456789', 'ABCDEFGHIJ')"
_SUBJECT = f"{_LETTERS} || chr(CAST(65 + floor(p_partkey / 9000.0) AS INT))"
_NUMBER = "CAST(1000 + (p_partkey * 4001) % 9000 AS STRING)"

# Every view may use the ones before it.
VIEWS: dict[str, str] = {
    "fx_courses": f"""
SELECT p_partkey AS k, {_SUBJECT} AS subject, {_NUMBER} AS number,
       {_SUBJECT} || ' ' || {_NUMBER} AS code, p_name AS title
FROM part""",
    "fx_shape": """
SELECT k,
       CASE WHEN k IN (7, 8) THEN 1 WHEN k % 101 = 0 THEN 8 ELSE CAST(k % 8 AS INT) END AS shape,
       CASE WHEN k = 7 THEN 8 WHEN k = 8 THEN 7 ELSE CAST(floor(k / 2.0) AS BIGINT) END AS a,
       CAST(floor(k / 3.0) AS BIGINT) AS b,
       CAST(floor(k / 5.0) AS BIGINT) AS c
FROM fx_courses
WHERE k IN (7, 8) OR (k >= 30 AND (k % 8 <> 0 OR k % 101 = 0))""",
    "fx_shape_codes": """
SELECT s.k AS k, s.shape AS shape, o.code AS owner, a.code AS a, b.code AS b, c.code AS c, a.subject AS a_subject
FROM fx_shape s
JOIN fx_courses o ON o.k = s.k
JOIN fx_courses a ON a.k = s.a
JOIN fx_courses b ON b.k = s.b
JOIN fx_courses c ON c.k = s.c""",
    "fx_req_text": """
SELECT owner, 'prerequisite' AS relation, shape,
       CASE shape
         WHEN 1 THEN a
         WHEN 2 THEN a || ' OR ' || b
         WHEN 3 THEN a || ' AND ' || b
         WHEN 4 THEN a || ' AND (' || b || ' OR ' || c || ')'
         WHEN 5 THEN '(Grade A or above in ' || a || ') OR ' || b
         WHEN 6 THEN 'Any ' || a_subject || ' courses of 3000-level or above'
         WHEN 7 THEN a || ' AND Approval of instructor'
         WHEN 8 THEN 'ZZZZ 9999 OR ' || a
       END AS raw
FROM fx_shape_codes""",
    "fx_other_req": """
SELECT o.code AS owner, 'corequisite' AS relation, r.code AS raw
FROM fx_courses o JOIN fx_courses r ON r.k = o.k - 1
WHERE o.k >= 30 AND o.k % 10 = 0
UNION ALL
SELECT o.code AS owner, 'exclusion' AS relation, r.code || ' (prior to 2022-23)' AS raw
FROM fx_courses o JOIN fx_courses r ON r.k = CAST(floor(o.k / 5.0) AS BIGINT)
WHERE o.k >= 30 AND o.k % 10 = 1""",
    "fx_requirements": """
SELECT owner, relation, raw FROM fx_req_text
UNION ALL
SELECT owner, relation, raw FROM fx_other_req""",
    "fx_completed": """
SELECT DISTINCT o.o_custkey AS student, c.code AS code
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN fx_courses c ON c.k = l.l_partkey
WHERE l.l_returnflag <> 'R'""",
    "fx_targets": """
SELECT DISTINCT o.o_custkey AS student, c.code AS code
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN fx_courses c ON c.k = l.l_partkey
WHERE l.l_returnflag = 'R'""",
    "fx_toggles": """
SELECT e.user_id AS student, c.code AS code, e.event_type = 'purchase' AS done, e.ts AS ts, e.event_id AS event_id
FROM events e JOIN fx_courses c ON c.k = e.event_id % 50
WHERE e.event_type IN ('purchase', 'error')""",
    "fx_program_lines": """
SELECT CAST(floor(k / 12.0) AS INT) AS program, CAST(101 + k % 12 AS INT) AS line_no,
       ' ' || subject || '          ' || number || '            ' || title || '      ' || CAST(3 + k % 2 AS STRING) AS line
FROM fx_courses
UNION ALL
SELECT DISTINCT CAST(floor(k / 12.0) AS INT), 1, ' Major Requirements' FROM fx_courses
UNION ALL
SELECT DISTINCT CAST(floor(k / 12.0) AS INT), 2, ' Required Course(s)' FROM fx_courses
UNION ALL
SELECT DISTINCT CAST(floor(k / 12.0) AS INT), 900, ' Remarks on course(s)' FROM fx_courses""",
}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` as one statement with the views it needs (directly or through other views)."""
    views = {**VIEWS, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in views:
            if name not in needed and name in text:
                needed.add(name)
                visit(views[name])

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({views[name]})" for name in views if name in needed)
    recursive = "RECURSIVE " if any("RECURSIVE" in views[n] for n in needed) else ""
    return f"WITH {recursive}{ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, body: str, extra: dict[str, str] | None = None) -> DataFrame:
    """Run ``body`` (a view name or a SELECT) over the tables in ``sf_dir``."""
    statement = sql(body if " " in body.strip() else f"SELECT * FROM {body}", extra)
    for name in sorted(BASE_TABLES, key=len, reverse=True):
        if f"FROM {name}" in statement or f"JOIN {name}" in statement:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(statement)
