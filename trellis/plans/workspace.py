"""Derived tables several queries share, written once per session and input folder."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import graph, levels, program_text, requirements
from trellis.plans.fixtures import fixture, table
from trellis.session import stage

YEAR = "2026-27"
COURSES = f"""SELECT k, '{YEAR}' AS year, code, subject, number, title, CAST(3 + k % 2 AS STRING) AS credits,
'' AS description, '/ugcourse/{YEAR}/' || subject || '/' AS source_url FROM fx_courses"""

# Program text: the plain rows plus a choice with child rows, an elective block and branch tables.
PROGRAM_VIEWS = {
    "fx_owned": """
SELECT CAST(floor(k / 12.0) AS INT) AS program, k, subject, number, code, title, CAST(k % 12 + 1 AS INT) AS rn FROM fx_courses""",
    "fx_program_text": """
SELECT program, line_no, line FROM fx_program_lines
UNION ALL
SELECT p.program, 50, ' ' || p.subject || '          Note: ' || p.code || ' OR ' || q.code || '      3-4'
FROM fx_owned p JOIN fx_owned q ON p.program = q.program AND p.rn = 1 AND q.rn = 2
UNION ALL
SELECT program, CAST(50 + rn AS INT), '    ' || subject || '       ' || number || '            ' || title || '      ' || CAST(3 + k % 2 AS STRING)
FROM fx_owned WHERE rn IN (1, 2)
UNION ALL
SELECT DISTINCT program, v.line_no, v.line FROM fx_owned
CROSS JOIN (VALUES (800, ' Track Study'), (801, ' Embedded Systems Track'), (810, ' Networking Area'), (820, ' Robotics Option')) AS v(line_no, line)
UNION ALL
SELECT program, CAST(CASE rn WHEN 3 THEN 802 WHEN 4 THEN 811 WHEN 5 THEN 821 ELSE 812 END AS INT),
       ' ' || subject || '          ' || number || '            ' || title || '      ' || CAST(3 + k % 2 AS STRING)
FROM fx_owned WHERE rn IN (3, 4, 5, 6)""",
}


class Workspace:
    """Lazily staged tables over one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def sql(self, body: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, body, PROGRAM_VIEWS)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @functools.cached_property
    def courses(self) -> DataFrame:
        return stage(self.sql(COURSES))

    @functools.cached_property
    def requirements(self) -> DataFrame:
        return stage(self.sql("fx_requirements"))

    @functools.cached_property
    def _parsed(self):
        return requirements.parse_requirements(self.requirements)

    @functools.cached_property
    def nodes(self) -> DataFrame:
        return stage(self._parsed[0])

    @functools.cached_property
    def parsed(self) -> DataFrame:
        return stage(self._parsed[1])

    @property
    def texts(self) -> DataFrame:
        """The cleaned texts as ``parsed`` has them, for queries that show no status."""
        return requirements.cleaned_texts(self.requirements)

    @functools.cached_property
    def _levels(self):
        level, cycles = levels.dependency_levels(self.courses.select("code"), self.nodes)
        return level, stage(cycles)

    @functools.cached_property
    def cycles_alone(self) -> DataFrame:
        """The cycles, for queries that show no levels."""
        return self.cycles if "_levels" in self.__dict__ else stage(levels.dependency_cycles(self.courses.select("code"), self.nodes))

    @property
    def levels(self) -> DataFrame:
        return self._levels[0]

    @property
    def cycles(self) -> DataFrame:
        return self._levels[1]

    @functools.cached_property
    def roots(self) -> DataFrame:
        return self.courses.select(F.col("code").alias("root"))

    def graph(self, direction="backward", depth=1, max_nodes=None, relations=None, bare=False):
        """``bare``: for queries that show neither levels nor cycles, which then need not be found."""
        levels, cycles = (None, None) if bare else (self.levels, self.cycles)
        return graph.build_graph(
            self.roots, self.courses, self.nodes, levels, cycles, relations, direction, depth, max_nodes
        )

    @functools.cached_property
    def one_hop(self):
        """Backward graphs of depth 1 of every course."""
        return self.graph()

    @functools.cached_property
    def bare_hop(self):
        """The same graphs, maybe without levels and cycles."""
        return self.__dict__.get("one_hop") or self.graph(bare=True)

    @functools.cached_property
    def completed(self) -> DataFrame:
        return stage(self.sql("fx_completed"))

    @functools.cached_property
    def targets(self) -> DataFrame:
        return stage(self.sql("fx_targets"))

    @functools.cached_property
    def programs(self):
        return program_text.parse_programs(self.sql("fx_program_text"))


@functools.lru_cache(maxsize=None)
def _open(app: str, sf_dir: str) -> list:
    return []


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    held = _open(spark.sparkContext.applicationId, sf_dir)
    if not held:
        held.append(Workspace(spark, sf_dir))
    return held[0]
