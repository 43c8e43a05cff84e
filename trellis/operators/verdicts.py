"""Is a requirement met?  Three-valued verdicts of students against requirement trees.

TRUE / FALSE / NULL stand for met / unmet / unknown inside; the edge names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators.trees import fold, leaf_rows, tree_depth

COMPLETED, MET, UNMET, UNKNOWN = "completed", "met", "unmet", "unknown"


def any_verdict(value: str) -> Column:
    """Met if any is met, unmet if all are unmet, else unknown (SQL's bool_or would skip unknowns)."""
    v = F.col(value)
    return F.when(F.bool_or(v), True).when(F.count(v) == F.count(F.lit(1)), False)


def all_verdict(value: str) -> Column:
    """Unmet if any is unmet, met if all are met, else unknown."""
    v = F.col(value)
    return F.when(~F.bool_and(v), False).when(F.count(v) == F.count(F.lit(1)), True)


def normalize_completions(completions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Raw completion rows -> distinct well-formed codes per student."""
    keys = keys or ["student"]
    return completions.select(*keys, T.valid_code("code").alias("code")).where(F.col("code").isNotNull()).distinct()


def items(held: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., item, level)``: every held code (valid ones only), and its subject with the level completed in it."""
    level = F.substring(F.substring_index("code", " ", -1), 1, 1).try_cast("int")
    both = F.array(
        F.struct(F.col("code").alias("item"), F.lit(0).alias("level")),
        F.struct(F.substring_index("code", " ", 1).alias("item"), level.alias("level")),
    )
    return held.select(*keys, F.inline(both))


def facts(completions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What each student holds, as ``(keys..., item, top_level)``.

    An item is a completed code or a subject with the highest level completed in it, which turns
    the pattern test "any course of the subject at or above a level" into an equi join.  One scan,
    one shuffle; repeated and hot rows collapse before it.
    """
    keys = keys or ["student"]
    held = completions.select(*keys, T.valid_code("code").alias("code")).where(F.col("code").isNotNull())
    return items(held, keys).groupBy(*keys, "item").agg(F.max("level").alias("top_level"))


def judge_leaves(leaves: DataFrame, held: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds ``verdict`` to the leaf rows of students; qualifiers never matter.

    Course leaf: held or not.  Pattern leaf: the subject is held at or above the level.  Prose and
    malformed patterns: unknown.
    """
    keys = keys or ["student"]
    sound = (F.col("kind") == "coursePattern") & F.col("pat_subject").rlike("^[A-Z]{4}$") & F.col("pat_min_level").isNotNull()
    item = F.when(F.col("kind") == "course", F.col("code")).when(sound, F.col("pat_subject"))
    joined = leaves.withColumn("item", item).join(held, [*keys, "item"], "left")
    verdict = F.when(F.col("kind") == "course", F.col("top_level").isNotNull()).when(
        sound, F.coalesce(F.col("top_level") >= F.col("pat_min_level"), F.lit(False))
    )
    return joined.withColumn("verdict", verdict).drop("item", "top_level")


LEAF_COLUMNS = ["kind", "code", "pat_subject", "pat_min_level"]


def evaluate(wanted: DataFrame, req_nodes: DataFrame, completions: DataFrame, keys: list[str], student: list[str] | None = None) -> DataFrame:
    """Verdict of the requirement trees of every wanted row: ``(keys..., verdict)``.

    ``wanted(keys...)`` names the student and the owner of the tree; ``req_nodes`` shares the owner
    columns.  Wanted rows without a tree give no row.
    """
    student = student or ["student"]
    owner = [k for k in keys if k in req_nodes.columns]
    asked = wanted.select(*keys).join(leaf_rows(req_nodes, *owner, *LEAF_COLUMNS), owner)
    judged = judge_leaves(asked, facts(completions, student), student)
    folded = fold(judged, keys, "verdict", any_verdict("verdict"), all_verdict("verdict"), tree_depth(req_nodes))
    return folded.drop("path")


def requirement_status(targets: DataFrame, courses: DataFrame, req_nodes: DataFrame, completions: DataFrame) -> DataFrame:
    """``(student, code, status)`` for every wanted course that the catalog has.

    completed if the course itself is held; met if it has no prerequisite; else the verdict of its
    prerequisite tree.  Each course asks for its own code (path "self") besides its leaves, so one
    join of targets with the catalog and one lookup of what students hold answer everything.
    """
    prerequisites = req_nodes.where(F.col("relation") == "prerequisite")
    leaves = leaf_rows(prerequisites, F.col("owner").alias("target"), *LEAF_COLUMNS)
    itself = courses.select(
        F.col("code").alias("target"),
        F.lit("course").alias("kind"),
        F.col("code"),
        F.lit(None).cast("string").alias("pat_subject"),
        F.lit(None).cast("int").alias("pat_min_level"),
        F.lit("self").alias("path"),
        F.lit("").alias("above"),
    )
    asks = itself.unionByName(leaves)
    wanted = targets.select("student", T.valid_code("code").alias("target"))
    judged = judge_leaves(wanted.join(asks, "target"), facts(completions))
    folded = fold(judged, ["student", "target"], "verdict", any_verdict("verdict"), all_verdict("verdict"), tree_depth(prerequisites))
    is_self = F.col("path") == "self"
    answers = folded.groupBy("student", "target").agg(
        F.bool_or(is_self & F.col("verdict")).alias("finished"),
        F.bool_or(~is_self).alias("has_tree"),
        F.bool_or(F.when(~is_self, F.col("verdict"))).alias("verdict"),
    )
    status = F.when(F.col("finished"), COMPLETED).when(~F.col("has_tree"), MET).otherwise(verdict_name("verdict"))
    return answers.select("student", F.col("target").alias("code"), status.alias("status"))


def verdict_name(verdict: str) -> Column:
    v = F.col(verdict)
    return F.when(v, MET).when(~v, UNMET).otherwise(UNKNOWN)


def junction_satisfied(leaves: DataFrame, roots: DataFrame, completions: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """Two-valued check of a junction as the detail view shows it.

    Unlike :func:`evaluate`, prose counts as not satisfied, and courses that are roots of the view
    are left out of their junctions; a junction with nothing left is not satisfied.  ``leaves`` has
    ``keys + student, path, above, kind, code``; ``roots(student, code)``.
    """
    done = completions.select("student", "code").withColumn("_done", F.lit(True))
    viewed = roots.select("student", "code").withColumn("_root", F.lit(True))
    judged = leaves.join(viewed, ["student", "code"], "left").join(done, ["student", "code"], "left")
    held = F.coalesce((F.col("kind") == "course") & F.col("_done"), F.lit(False))
    judged = judged.withColumn("satisfied", F.when(F.col("_root").isNull(), held))
    # NULL marks a leaf that is left out; a junction of such leaves only is not satisfied.
    some = F.coalesce(F.bool_or("satisfied"), F.lit(False))
    every = F.coalesce(F.bool_and("satisfied"), F.lit(False))
    folded = fold(judged, keys, "satisfied", some, every, depth)
    return folded.select(*keys, F.coalesce("satisfied", F.lit(False)).alias("satisfied"))
