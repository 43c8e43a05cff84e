"""Which alternatives no longer matter: pruning of requirement branches that are already fulfilled.

The rules are one reachability problem over (node, mark) pairs.  A mark says how a branch was
reached: ``consider`` (a course whose own requirements count), ``need`` (everything below is still
needed), ``sat`` (fulfilled: only what fulfils it counts), ``paths`` (redundant but holds finished
courses) and ``drop`` (redundant).  An edge turns the mark of a node into the mark of its child;
the result is what was dropped and never kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators.verdicts import all_verdict, any_verdict, facts, items
from trellis.session import Bucketed, countdown, grow, stage

REQUIRES = ["prerequisite", "corequisite"]


def _asked(nodes: DataFrame) -> DataFrame:
    """Adds what finished courses must hold for a leaf (``item``) and whether its pattern can be tested (``sound``)."""
    sound = (F.col("type") == "coursePattern") & F.col("pat_subject").rlike("^[A-Z]{4}$") & F.col("pat_min_level").isNotNull()
    item = F.when(F.col("type") == "course", T.loose_code("code")).when(sound, F.col("pat_subject"))
    return nodes.withColumns({"item": item, "sound": sound})


def _leaf_met() -> Column:
    """Verdict of a leaf that has met what is held; NULL for what is neither a course nor a sound pattern."""
    return F.when(F.col("type") == "course", F.col("top_level").isNotNull()).when(
        F.col("sound"), F.coalesce(F.col("top_level") >= F.col("pat_min_level"), F.lit(False))
    )


def touched_graphs(members: DataFrame, nodes: DataFrame, credited: DataFrame, key: str = "graph", part: str = "root") -> DataFrame:
    """``(key)`` of the graphs in which some leaf is met.

    A graph is the union of its ``members(key, part)``, whose ``nodes(part, type, code, pat_subject, pat_min_level)`` are
    shared by all graphs.  A junction is met through a met leaf below it, and a branch is only redundant beside a met one,
    so in every other graph nothing is hidden and it need not be built to be pruned.
    """
    leaves = _asked(nodes).where(F.col("item").isNotNull()).select(part, "type", "item", "pat_min_level").distinct()
    held = items(credited.select(key, T.valid_code("code").alias("code")).where(F.col("code").isNotNull()), [key])
    # What is held is not reduced to one row an item before it: nearly all rows differ, and one hit is enough.
    enough = (F.col("a.type") == "course") | (F.col("h.level") >= F.col("a.pat_min_level"))
    met = (F.col(f"a.{key}") == F.col(f"h.{key}")) & (F.col("a.item") == F.col("h.item")) & enough
    return members.join(leaves, part).alias("a").join(held.alias("h"), met, "left_semi").select(key).distinct()


def judge_nodes(nodes: DataFrame, edges: DataFrame, credited: DataFrame, key: str) -> DataFrame:
    """``(key, id, type, met, done)``: verdict of each branch, and whether it holds a finished course.

    Courses are leaves here.  A junction counts down its children and is judged once, when all of them are.
    """
    looked = _asked(nodes.select(key, "id", "type", "code", "pat_subject", "pat_min_level")).join(facts(credited, [key]), [key, "item"], "left")
    met = _leaf_met()
    done = (F.col("type") == "course") & F.col("top_level").isNotNull()
    junction = F.col("type").isin("all", "any")
    leaves = looked.where(~junction).select(key, "id", "type", met.alias("met"), done.alias("done"))
    junctions = nodes.where(junction).select(key, F.col("id").alias("parent"), F.col("type").alias("kind"))
    # A child that is no node of the graph counts as unknown.
    ids = nodes.select(key, F.col("id").alias("child"), F.lit(True).alias("exists"))
    below = junctions.join(edges.select(key, "parent", "child"), [key, "parent"]).join(ids, [key, "child"], "left")
    below = stage(below.join(below.groupBy(key, "parent").agg(F.count(F.lit(1)).alias("of")), [key, "parent"]))
    ends = [F.col(key).alias(f"t_{key}"), F.col("parent").alias("t_id"), "of", "kind"]
    links = below.where("exists").select(F.col(key).alias(f"f_{key}"), F.col("child").alias("f_id"), *ends)
    unknown = F.lit(None).cast("boolean").alias("met"), F.lit(False).alias("done")
    arrived = below.where("exists IS NULL").select(*ends, F.lit(None).cast("string").alias("type"), *unknown)
    childless = junctions.join(below.select(key, "parent").distinct(), [key, "parent"], "left_anti").select(key, F.col("parent").alias("id"), F.col("kind").alias("type"), *unknown)

    def settle(rows: DataFrame) -> DataFrame:
        verdict = F.when(F.first("kind") == "any", any_verdict("met")).otherwise(all_verdict("met"))
        return rows.groupBy(key, "id").agg(F.first("kind").alias("type"), verdict.alias("met"), F.bool_or("done").alias("done"))

    judged = stage(countdown(links, [key, "id"], arrived, leaves.unionByName(childless), settle))
    # Junctions that wait on each other stay unknown.
    rest = junctions.select(key, F.col("parent").alias("id"), F.col("kind").alias("type")).join(judged.select(key, "id"), [key, "id"], "left_anti")
    return stage(judged.unionByName(rest.select("*", *unknown)))


def _enter(mark: Column, kind: Column, met: Column, done: Column) -> Column:
    """Mark a node really gets when it is reached with ``mark``."""
    junction = kind.isin("all", "any")
    return (
        F.when((kind == "course") & mark.isin("need", "sat"), "consider")
        .when((mark == "need") & junction & met, "sat")
        .when((mark == "drop") & done & (kind == "course"), "consider")
        .when((mark == "drop") & done, "paths")
        .when((mark == "paths") & (kind == "course"), "consider")
        .otherwise(mark)
    )


def _transitions(edges: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """``(key, id, mark, to, to_mark)``: what each edge passes down; rows may repeat."""
    upper = judged.select(key, F.col("id").alias("parent"), F.col("type").alias("p_type"), F.col("met").alias("p_met"), F.col("done").alias("p_done"))
    lower = judged.select(key, F.col("id").alias("child"), F.col("type").alias("c_type"), "met", "done")
    links = edges.join(lower, [key, "child"], "left").join(upper, [key, "parent"], "left")
    met = F.coalesce("met", F.lit(False))
    done = F.coalesce("done", F.lit(False))
    # Tops of one relation of a course are alternatives: once one is met the unmet ones are redundant.
    tops = links.where(F.col("p_type") == "course").groupBy(key, "parent", "relation").agg(F.bool_or(met).alias("some_met"))
    links = links.join(tops, [key, "parent", "relation"], "left")
    some_met = F.coalesce("some_met", F.lit(False))
    p_type, p_met = F.coalesce("p_type", F.lit("")), F.coalesce("p_met", F.lit(False))
    p_done = F.coalesce("p_done", F.lit(False))

    def passes(mark: str, applies: Column, child_mark: Column) -> Column:
        return F.when(applies, F.struct(F.lit(mark).alias("mark"), child_mark.alias("to_mark")))

    junction = p_type.isin("all", "any")
    sat = F.when(met, "sat")
    options = F.array_compact(F.array(
        passes("consider", p_type == "course", sat.when(some_met, "drop").otherwise("need")),
        passes("sat", p_type == "all", sat.otherwise("need")),
        passes("sat", p_type == "any", sat.otherwise("drop")),
        passes("need", (p_type != "course") & (p_type != "") & ~(junction & p_met), F.lit("need")),
        passes("paths", junction, F.when(done, "paths").otherwise("drop")),
        passes("drop", ~p_done, F.lit("drop")),
    ))
    c_type = F.coalesce("c_type", F.lit(""))
    moves = links.select(key, F.col("parent").alias("id"), F.col("child").alias("to"), c_type.alias("c_type"), met.alias("met"), done.alias("done"), F.inline(options))
    entered = _enter(F.col("to_mark"), F.col("c_type"), F.col("met"), F.col("done"))
    return moves.select(key, "id", "mark", "to", entered.alias("to_mark"))


def _climbs(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Moves up from the roots through junctions and courses; every course on the way is considered."""
    kinds = nodes.select(key, F.col("id").alias("parent"), "type")
    up = edges.select(key, "child", "parent").distinct().join(kinds, [key, "parent"], "left")
    onward = up.select(key, F.col("child").alias("id"), F.lit("climb").alias("mark"), F.col("parent").alias("to"), F.lit("climb").alias("to_mark"))
    courses = up.where(F.col("type") == "course").select(
        key, F.col("child").alias("id"), F.lit("climb").alias("mark"), F.col("parent").alias("to"), F.lit("consider").alias("to_mark")
    )
    return onward.unionByName(courses)


def hidden_nodes(nodes: DataFrame, edges: DataFrame, credited: DataFrame, roots: DataFrame, backward_only: bool = False, key: str = "graph") -> DataFrame:
    """``(key, id)`` of the nodes that finished or planned courses make redundant.

    ``nodes(key, id, type, code, pat_subject, pat_min_level)``, ``edges(key, source, target,
    relation)``, ``credited(key, code)`` (finished and planned courses alike), ``roots(key, code)``.
    Unless ``backward_only``, courses that depend on a root are considered too.
    """
    links = stage(edges.where(F.col("relation").isin(REQUIRES)).select(
        key, F.col("target").alias("parent"), F.col("source").alias("child"), "relation"
    ).distinct())
    judged = judge_nodes(nodes, links, credited, key)
    moves = _transitions(links, judged, key)
    if not backward_only:
        moves = moves.unionByName(_climbs(links, nodes, key))
    # The moves stay dealt out like the marks that meet them, so no round shuffles them.
    roads = Bucketed(nodes.sparkSession, [key, "id", "mark"])
    roads.append(roads.dealt(moves).distinct())
    moves = roads.all()
    wanted = roots.select(key, F.concat(F.lit("course:"), T.valid_code("code")).alias("id"))
    seeds = nodes.select(key, "id").join(wanted, [key, "id"], "left_semi")
    start = seeds.distinct().withColumn("mark", F.lit("consider"))
    if not backward_only:
        start = start.unionByName(start.withColumn("mark", F.lit("climb")))

    def step(front, _):
        return front.hint("shuffle_hash").join(moves, [key, "id", "mark"]).select(key, F.col("to").alias("id"), F.col("to_mark").alias("mark"))

    marks = grow(start, [key, "id", "mark"], step)
    roads.close()
    marks = marks.where(F.col("mark") != "climb")
    dropped = marks.groupBy(key, "id").agg(F.bool_and(F.col("mark") == "drop").alias("redundant")).where("redundant")
    finished = judged.where((F.col("type") == "course") & F.col("done")).select(key, "id")
    return dropped.select(key, "id").join(finished, [key, "id"], "left_anti")


def active_graph(nodes: DataFrame, edges: DataFrame, hidden: DataFrame, key: str = "graph") -> tuple[DataFrame, DataFrame]:
    """The graph without hidden nodes and without every edge that touches one."""
    kept = edges.join(hidden.withColumnRenamed("id", "source"), [key, "source"], "left_anti")
    kept = kept.join(hidden.withColumnRenamed("id", "target"), [key, "target"], "left_anti")
    return nodes.join(hidden, [key, "id"], "left_anti"), kept
