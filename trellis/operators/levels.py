"""Dependency levels of courses, with corequisite components and cycles."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.requirements import mandatory_references
from trellis.operators.trees import fold, leaf_rows, tree_depth
from trellis.session import Bucketed, Staged, countdown, grow, stage

# ---- fixed values ---------------------------------------------------------------------------
CYCLE_MESSAGE = "Prerequisite cycle prevents authoritative level calculation"
# ---------------------------------------------------------------------------------------------


def connected_components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """``(code, component)`` with the smallest code of each component as its name.

    ``links(a, b)`` is undirected.  Alternates the large-star and small-star steps of the published
    two-phase algorithm until the edges are stars around their minimum: a logarithmic number of
    rounds even on long chains, and each step only takes minima, so a hub never gathers in one task.
    """
    spark = links.sparkSession
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = links.where(F.col("a") != F.col("b")).select(high.alias("u"), low.alias("v")).distinct()
    store = Staged(spark)
    fingerprint = [F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("print")]
    before, now = None, store.append(edges, *fingerprint)
    while now["rows"] and now != before:
        e = store.last()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        before, now = now, store.append(small, *fingerprint)
    heads = store.last().groupBy(F.col("u").alias("code")).agg(F.min("v").alias("component"))
    joined = vertices.select("code").distinct().join(heads, "code", "left")
    return joined.select("code", F.coalesce("component", "code").alias("component"))


def corequisite_components(courses: DataFrame, req_nodes: DataFrame) -> DataFrame:
    """Courses tied together by mandatory corequisites that the catalog has."""
    ties = mandatory_references(req_nodes.where(F.col("relation") == "corequisite"))
    ties = ties.join(courses.select(F.col("code").alias("ref")), "ref", "left_semi")
    ties = ties.join(courses.select(F.col("code").alias("owner")), "owner", "left_semi")
    return connected_components(courses, ties.select(F.col("owner").alias("a"), F.col("ref").alias("b")))


def strong_components(edges: DataFrame) -> DataFrame:
    """``(vertex, scc)`` for the vertices on some cycle of ``edges(src, dst)``; ``scc`` names the component.

    Rake and compress first: vertices that nothing enters or leaves go, and vertices with one edge in and one out are
    taken out of their chains, many at a time, so trees and chains of any length end in a logarithmic number of
    rounds.  What is left is coloured: the largest vertex name that reaches a vertex is its colour; the vertices of
    one colour that reach the colour's own vertex form a component.  Peel and repeat.  A vertex that was taken out of
    a chain lies on a cycle exactly if both its neighbours of that time lie in one component.
    """
    spark = edges.sparkSession
    found, chains = Staged(spark), []
    named = lambda rows: rows.select(F.col("src").alias("vertex"), F.col("src").alias("scc")).distinct()
    left = stage(edges.select("src", "dst").distinct())
    while True:
        left, loops, taken = _kernel(left)
        chains += taken
        found.append(named(loops))
        if left.isEmpty():
            break
        members, left = _peel(left)
        found.append(members)
    named, before, now = _one_name(found.all()), None, {}
    while chains and now != before:  # back into the chains: names come from the ends' names of the round before
        ends = {e: named.select(F.col("vertex").alias(e), F.col("scc").alias(f"of_{e}")) for e in ("before", "after")}
        inside = functools.reduce(DataFrame.unionByName, chains).join(ends["before"], "before").join(ends["after"], "after")
        inside = inside.where(F.col("of_before") == F.col("of_after")).select("vertex", F.col("of_before").alias("scc"))
        store = Staged(spark)
        before, now = now, store.append(inside, F.coalesce(F.bit_xor(F.xxhash64("vertex", "scc")), F.lit(0)).alias("print"))
        named = _one_name(found.all().unionByName(store.last()))
    return named


def _one_name(found: DataFrame) -> DataFrame:
    """A vertex with a loop inside a larger component keeps the larger one."""
    proper = F.max(F.when(F.col("scc") != F.col("vertex"), F.col("scc")))
    return stage(found.groupBy("vertex").agg(F.coalesce(proper, F.max("scc")).alias("scc")))


def _kernel(edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``(edges, loops, chains)``: what rake and compress leave, loops met on the way, and the vertices taken out."""
    spark = edges.sparkSession
    loops, chains, rounds = Staged(spark), [], 0
    loops.append(edges.where(F.col("src") == F.col("dst")))
    edges = stage(edges.where(F.col("src") != F.col("dst")))
    count = edges.count()
    while count:
        rounds += 1
        ends = edges.select(F.col("src").alias("vertex"), F.lit(None).cast("string").alias("i"), F.col("dst").alias("o")).unionByName(
            edges.select(F.col("dst").alias("vertex"), F.col("src").alias("i"), F.lit(None).cast("string").alias("o"))
        )
        degrees = ends.groupBy("vertex").agg(F.count("i").alias("n_in"), F.count("o").alias("n_out"), F.min("i").alias("before"), F.min("o").alias("after"))
        # Of neighbours the one with the least random number goes, so no two of them do.
        draw = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(rounds)), F.col(c))  # noqa: E731, B023
        lone = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (draw("vertex") < draw("before")) & (draw("vertex") < draw("after"))
        degrees = degrees.withColumn("lone", lone)
        at_src = degrees.select(F.col("vertex").alias("src"), (F.col("n_in") > 0).alias("entered"), F.col("lone").alias("src_lone"))
        at_dst = degrees.select(F.col("vertex").alias("dst"), (F.col("n_out") > 0).alias("left"), F.col("lone").alias("dst_lone"))
        kept = edges.join(at_src, "src").join(at_dst, "dst").where("entered AND left AND NOT src_lone AND NOT dst_lone")
        taken = degrees.where("lone").select(F.col("before").alias("src"), F.col("after").alias("dst"), F.col("vertex").alias("via"))
        store = Staged(spark)
        was, found = count, store.append(
            kept.select("src", "dst", F.lit(None).cast("string").alias("via")).unionByName(taken),
            F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count("via").alias("taken"),
        )
        if found["taken"]:
            chains.append(store.last().where("via IS NOT NULL").select(F.col("via").alias("vertex"), F.col("src").alias("before"), F.col("dst").alias("after")))
        if found["loops"]:
            loops.append(store.last().where(F.col("src") == F.col("dst")).select("src", "dst"))
        edges = store.last().where(F.col("src") != F.col("dst")).select("src", "dst")
        if found["taken"]:  # an edge that takes a chain's place may be there already
            edges = edges.distinct()
        count = found["rows"] - found["loops"]
        if count == was and not found["taken"]:
            break
    return stage(edges), loops.all(), chains


def _peel(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members(vertex, scc), rest)``: the components of the vertices that are the largest to reach themselves."""
    colour = _colour(left)
    inside = left.join(colour.select(F.col("vertex").alias("src"), F.col("colour").alias("c")), "src").join(
        colour.select(F.col("vertex").alias("dst"), F.col("colour").alias("d")), "dst"
    ).where(F.col("c") == F.col("d")).select("src", "dst", F.col("c").alias("scc"))
    inside = stage(inside)
    heads = inside.where(F.col("scc") == F.col("dst")).select(F.col("dst").alias("vertex"), "scc").distinct()
    members = grow(
        heads, ["vertex", "scc"],
        lambda front, _: front.select(F.col("vertex").alias("dst"), "scc").join(inside, ["dst", "scc"]).select(F.col("src").alias("vertex"), "scc"),
    )
    gone = members.select("vertex").unionByName(colour.where(F.col("vertex") == F.col("colour")).select("vertex")).distinct()
    rest = left.join(gone.select(F.col("vertex").alias("src")), "src", "left_anti")
    return members, stage(rest.join(gone.select(F.col("vertex").alias("dst")), "dst", "left_anti").select("src", "dst"))


def _colour(edges: DataFrame) -> DataFrame:
    """``(vertex, colour)``.  A round offers the colours that rose in the round before, and writes those that rise."""
    names = edges.select(F.col("src").alias("vertex")).union(edges.select("dst")).distinct()
    store = Bucketed(edges.sparkSession, ["vertex"])
    risen = store.start(names.select("vertex", F.col("vertex").alias("colour")))
    top = lambda rows: rows.groupBy("vertex").agg(F.max("colour").alias("colour"))
    while risen:
        offered = store.last().withColumnRenamed("vertex", "src").join(edges, "src").groupBy(F.col("dst").alias("vertex")).agg(F.max("colour").alias("offer"))
        now = top(store.all().join(store.dealt(offered).select("vertex").hint("merge"), "vertex", "left_semi"))
        risen = store.append(store.dealt(offered).join(now.hint("merge"), "vertex").where(F.col("offer") > F.col("colour")).select("vertex", F.col("offer").alias("colour")))["rows"]
    return stage(top(store.close()))


def dependency_levels(courses: DataFrame, req_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(levels(code, level), cycles(relation, message, courses))``.

    A component's level is 1 without prerequisites, else the highest of its members' (1 + level of
    the prerequisite tree).  In a tree: an absent course is NULL; ALL is NULL if any arm is; ANY is
    the highest known arm; prose and patterns are 0.  Components on a cycle have no level.  A
    component counts down its open references and is evaluated once, when none is left.
    """
    spark = courses.sparkSession
    components = stage(corequisite_components(courses, req_nodes))
    trees = req_nodes.where(F.col("relation") == "prerequisite").join(
        components.withColumnRenamed("code", "owner"), "owner"
    )
    depth = tree_depth(trees)
    target = components.select(F.col("code"), F.col("component").alias("needs"))
    leaves = leaf_rows(trees, "owner", "component", "kind", "code").join(target, "code", "left")
    # A member without prerequisites counts like one with a lone prose leaf: level 1.
    none = F.lit(None).cast("string")
    bare = components.join(trees.select(F.col("owner").alias("code")).distinct(), "code", "left_anti").select(
        none.alias("code"), F.col("code").alias("owner"), "component", F.lit("condition").alias("kind"),
        F.lit("0").alias("path"), F.lit("").alias("above"), none.alias("needs"),
    )
    leaves = stage(leaves.unionByName(bare))
    total = leaves.groupBy("component").agg(F.count(F.lit(1)).alias("of"))
    counted = leaves.join(total, "component").withColumnRenamed("component", "t_component")
    links = counted.where(F.col("needs").isNotNull()).select(F.col("needs").alias("f_component"), "t_component", "of", "owner", "path", "above")
    # An absent course has no level; prose and patterns are 0.
    fixed = F.when(F.col("kind") != "course", F.lit(0)).cast("int")
    arrived = counted.where(F.col("needs").isNull()).select("t_component", "of", "owner", "path", "above", fixed.alias("level"))
    found = {}

    def settle(rows: DataFrame) -> DataFrame:
        every = F.when(F.count("level") == F.count(F.lit(1)), F.max("level"))
        trees = fold(rows, ["component", "owner"], "level", F.max("level"), every, depth, [])
        level = F.when(F.count("level") == F.count(F.lit(1)), 1 + F.max("level"))
        return trees.groupBy("component").agg(level.cast("int").alias("level"))

    def unblock(waiting: DataFrame) -> DataFrame | None:
        """What waits for itself has no level."""
        if found:
            return None
        found["cyclic"] = strong_components(waiting.select(F.col("t_component").alias("src"), F.col("f_component").alias("dst")))
        return found["cyclic"].select(F.col("vertex").alias("component"), F.lit(None).cast("int").alias("level"))

    nothing = spark.createDataFrame([], "component string, level int")
    settled = countdown(links, ["component"], arrived, nothing, settle, unblock)
    levels = components.join(settled, "component", "left").select("code", "level")
    return stage(levels), _cycle_rows(found["cyclic"], leaves)


def dependency_cycles(courses: DataFrame, req_nodes: DataFrame) -> DataFrame:
    """The cycles of :func:`dependency_levels` without the levels: the strong components of all references."""
    components = stage(corequisite_components(courses, req_nodes))
    trees = req_nodes.where(F.col("relation") == "prerequisite").join(components.withColumnRenamed("code", "owner"), "owner")
    needs = components.select("code", F.col("component").alias("needs"))
    leaves = stage(leaf_rows(trees, "owner", "component", "code").join(needs, "code"))
    cyclic = strong_components(leaves.select(F.col("component").alias("src"), F.col("needs").alias("dst")))
    return _cycle_rows(cyclic, leaves)


def _cycle_rows(cyclic: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row per cycle: the courses whose references stay inside it, and those references."""
    inside = leaves.join(cyclic.select(F.col("vertex").alias("component"), "scc"), "component").join(
        cyclic.select(F.col("vertex").alias("needs"), F.col("scc").alias("scc_to")), "needs"
    ).where(F.col("scc") == F.col("scc_to"))
    named = inside.select("scc", F.explode(F.array("owner", "code")).alias("code")).distinct()
    listed = named.groupBy("scc").agg(F.array_sort(F.collect_list("code")).alias("courses"))
    return listed.select(F.lit("cycle").alias("type"), F.lit("prerequisite").alias("relation"), F.lit(CYCLE_MESSAGE).alias("message"), "courses")
