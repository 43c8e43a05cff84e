"""Requirement graphs: what leads to a course, what depends on it, and views on the result.

All operators answer for many roots at once; every table is keyed by ``root`` first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators.catalog import dependents, reference_edges
from trellis.operators.requirements import RELATIONS
from trellis.session import Bucketed, Staged, fresh_rows, grow, stage

# ---- fixed values ---------------------------------------------------------------------------
ALIASES = {
    "prerequisites": "prerequisite",
    "prereqs": "prerequisite",
    "corequisites": "corequisite",
    "coreqs": "corequisite",
    "exclusions": "exclusion",
}
DIRECTIONS = ["backward", "forward", "both"]
DEFAULT_NODES, MAX_NODES = 250, 2000
NO_DETAILS = "Course details unavailable"
NO_TEXT = "Requirement condition"
UNRESOLVED_MESSAGE = "Some referenced courses are not present in the cached catalog"
TRUNCATED_MESSAGE = "Graph reached the {}-node safety limit"
# ---------------------------------------------------------------------------------------------


class RequestError(ValueError):
    def __init__(self, message: str, code: str):
        super().__init__(message)
        self.code = code


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    summary: DataFrame


def pick_relations(relations=None) -> list[str]:
    if relations is None:
        return list(RELATIONS)
    names = relations.split(",") if isinstance(relations, str) else list(relations)
    picked = [ALIASES.get(str(n).strip().lower(), str(n).strip().lower()) for n in names]
    if not picked or any(p not in RELATIONS for p in picked):
        raise RequestError("Relations must be prerequisite, corequisite or exclusion", "invalid_relations")
    return list(dict.fromkeys(picked))


def check_roots(roots: DataFrame, courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good(root), bad(requested, error))``: malformed or unknown roots become error rows."""
    asked = roots.select(F.col("root").alias("requested"), T.strict_code("root").alias("root"))
    known = courses.select(F.col("code").alias("root"), F.lit(True).alias("_known"))
    joined = asked.join(known, "root", "left")
    error = F.when(F.col("root").isNull(), "invalid_course_code").when(F.col("_known").isNull(), "course_not_found")
    judged = joined.withColumn("error", error)
    return judged.where(F.col("error").isNull()).select("root").distinct(), judged.where(F.col("error").isNotNull()).select("requested", "error")


def _spread(roots: DataFrame, hops: DataFrame, depth: int | None, budget: int | None = None) -> DataFrame:
    """Shortest-hop reach ``(root, code, distance)`` over ``hops(code, to)``, depth 0 = the root only.

    With a ``budget`` only the first courses of each root in (distance, code) order, as many as that.
    """
    seed = roots.select("root", F.col("root").alias("code"), F.lit(0).alias("distance"))
    if budget is not None:
        return _spread_within(seed, hops, depth, budget)

    def step(front, hop):
        return front.join(hops, "code").select("root", F.col("to").alias("code"), F.lit(hop).alias("distance")).distinct()

    return grow(seed, ["root", "code"], step, depth)


def _spread_within(seed: DataFrame, hops: DataFrame, depth: int | None, budget: int) -> DataFrame:
    """Expansion that stops for a root as soon as it has ``budget`` courses.

    Every row carries how many courses its root has (``total``), so a round knows what is left of the budget.  Of the
    targets of one course only the first ``2 * budget`` can matter: fewer than ``budget`` of them are known already.
    """
    first = F.row_number().over(Window.partitionBy("code").orderBy("to"))
    near = stage(hops.distinct().withColumn("_n", first).where(F.col("_n") <= 2 * budget).drop("_n"))
    store = Bucketed(seed.sparkSession, ["root", "code"])
    found = store.start(seed.withColumn("total", F.lit(1)))
    by_root, rounds = Window.partitionBy("root"), 0
    while found and (depth is None or rounds < depth):
        rounds += 1
        front = store.last().where(F.col("total") < budget)
        candidates = front.join(near, "code").select("root", F.col("to").alias("code"), F.lit(rounds).alias("distance"), "total")
        placed = fresh_rows(store, candidates).withColumn("_place", F.row_number().over(by_root.orderBy("code")))
        kept = placed.where((F.col("_place") <= budget) & (F.col("_place") + F.col("total") <= budget))
        counted = kept.withColumn("total", (F.col("total") + F.max("_place").over(by_root)).cast("int")).drop("_place")
        found = store.append(store.dealt(counted))["rows"]
    return store.close().drop("total")


def reach_backward(roots: DataFrame, courses: DataFrame, req_nodes: DataFrame, relations=None, depth: int | None = None, budget: int | None = None) -> DataFrame:
    """Catalog courses a root's requirements lead to, within ``depth`` hops; see :func:`_spread` for ``budget``."""
    picked = req_nodes.where(F.col("relation").isin(pick_relations(relations)))
    hops = reference_edges(picked).select(F.col("owner").alias("code"), F.col("ref").alias("to")).distinct()
    known = courses.select(F.col("code").alias("to"))
    return _spread(roots, stage(hops.join(known, "to", "left_semi").select("code", "to")), depth, budget)


def reach_forward(roots: DataFrame, req_nodes: DataFrame, depth: int | None = None, budget: int | None = None) -> DataFrame:
    """Courses that depend on a root through prerequisites, within ``depth`` hops; see :func:`_spread` for ``budget``."""
    hops = dependents(req_nodes).select(F.col("reference").alias("code"), F.col("dependent").alias("to"))
    return _spread(roots, stage(hops), depth, budget)


def _course_id(code) -> Column:
    return F.concat(F.lit("course:"), code)


def _rule_id(prefix, path: str) -> Column:
    return F.concat_ws(":", prefix, "owner", "relation", path)


def _tree_id(path: str = "path") -> Column:
    prefix = F.when(F.col("kind").isin("all", "any"), "bool").otherwise(F.col("kind"))
    return F.when(F.col("kind") == "course", _course_id(F.col("code"))).otherwise(_rule_id(prefix, path))


def tree_nodes(req_nodes: DataFrame) -> DataFrame:
    """Junction and detail nodes of requirement trees, with their ids; course leaves keep their code."""
    rows = req_nodes.where((F.col("kind") != "course") | F.col("code").isNotNull())
    text = F.coalesce(F.nullif("text", F.lit("")), F.lit(NO_TEXT))
    junction = F.col("kind").isin("all", "any")
    return rows.select(
        "owner", "relation", "path", "steps", "kind", "code", "qualifier", _tree_id().alias("id"),
        F.when(F.col("parent_path").isNull(), _course_id(F.col("owner"))).otherwise(_rule_id(F.lit("bool"), "parent_path")).alias("upper"),
        F.when(junction, F.upper("kind")).alias("label"),
        F.when(~junction & (F.col("kind") != "course"), text).alias("text"),
        "pat_subject", "pat_min_level",
    )


def tree_edges(trees: DataFrame, *keys: str) -> DataFrame:
    """Edges requirement -> dependent; exclusions run from the owner to what it excludes."""
    out = F.col("relation") == "exclusion"
    return trees.select(
        *keys,
        F.when(out, F.col("upper")).otherwise(F.col("id")).alias("source"),
        F.when(out, F.col("id")).otherwise(F.col("upper")).alias("target"),
        "relation",
        F.when(F.col("kind") == "course", F.col("qualifier")).alias("qualifier"),
        F.col("relation").isin("corequisite", "exclusion").alias("symmetric"),
        "order",
    )


def _between_courses() -> Column:
    return F.col("symmetric") & F.col("source").startswith("course:") & F.col("target").startswith("course:")


def dedupe_edges(edges: DataFrame, *keys: str, keep_qualifier: bool = False) -> DataFrame:
    """First edge per identity.  Symmetric course pairs match in either direction; their qualifier
    only counts with ``keep_qualifier`` (merging graphs), not inside one graph."""
    pair = _between_courses()
    qualifier = F.coalesce("qualifier", F.lit(""))
    a = F.when(pair, F.least("source", "target")).otherwise(F.col("source"))
    b = F.when(pair, F.greatest("source", "target")).otherwise(F.col("target"))
    q = qualifier if keep_qualifier else F.when(pair, "").otherwise(qualifier)
    identity = [a.alias("_a"), b.alias("_b"), q.alias("_q")]
    first = F.min(F.struct("order", "source", "target", "qualifier", "symmetric"))
    extra = ["symmetric"] if keep_qualifier else []
    grouped = edges.select("*", *identity).groupBy(*keys, "relation", "_a", "_b", "_q", *[F.col(e).alias("_s") for e in extra]).agg(first.alias("e"))
    return grouped.select(*keys, "e.source", "e.target", "relation", "e.qualifier", "e.symmetric", "e.order")


def build_graph(
    roots: DataFrame,
    courses: DataFrame,
    req_nodes: DataFrame,
    levels: DataFrame | None,
    cycles: DataFrame | None,
    relations=None,
    direction: str = "backward",
    depth: int | None = None,
    max_nodes: int | None = DEFAULT_NODES,
) -> Graph:
    """Graph of every valid root: the whole requirement expression of each expanded course.

    Backward expands what a course needs, over the picked relations; forward lists what uses it,
    with that course's whole prerequisite expression whose other leaves stay unexpanded.
    ``max_nodes`` keeps the first nodes per root in (distance, owner, place) order and reports
    the cut; None keeps all.  A root stops to expand at one course more than that: courses come
    before everything found later, so nothing beyond can be kept.  (In both directions at once a
    course that is kept as a dependent may still need its place among the requirements, so there
    the whole reach is taken and then cut.)
    Views that show no levels or no cycles pass None for them: the nodes' level is null then, or the
    diagnostics name no cycles.
    """
    picked = pick_relations(relations)
    if direction not in DIRECTIONS:
        raise RequestError(f"Unsupported graph direction: {direction}", "invalid_direction")
    if max_nodes is not None:
        max_nodes = max(1, min(int(max_nodes), MAX_NODES))
    depth = None if depth is None else max(0, int(depth))

    budget = None if max_nodes is None or direction == "both" else max_nodes + 1
    reached, expanded = [], []
    if direction in ("backward", "both"):
        back = reach_backward(roots, courses, req_nodes, picked, depth, budget)
        reached.append(back)
        inner = back if depth is None else back.where(F.col("distance") < depth)
        every = F.explode(F.array(*map(F.lit, picked))).alias("relation")
        expanded.append(inner.select("root", F.col("code").alias("owner"), every, F.col("distance").alias("far")))
    if direction in ("forward", "both"):
        ahead = reach_forward(roots, req_nodes, depth, budget) if "prerequisite" in picked else _spread_none(roots)
        reached.append(ahead)
        outer = ahead.where(F.col("distance") > 0)
        expanded.append(outer.select("root", F.col("code").alias("owner"), F.lit("prerequisite").alias("relation"), (F.col("distance") - 1).alias("far")))
    owners = expanded[0] if len(expanded) == 1 else expanded[0].unionByName(expanded[1])
    owners = owners.groupBy("root", "owner", "relation").agg(F.min("far").alias("far"))

    rank = F.array_position(F.array(*map(F.lit, picked)), F.col("relation")).cast("int")
    order = F.struct(F.col("far"), F.col("owner"), rank.alias("rank"), F.col("steps"))
    trees = stage(owners.join(tree_nodes(req_nodes), ["owner", "relation"]).withColumn("order", order))

    first = F.struct(
        (F.col("distance") - 1).alias("far"), F.lit("").alias("owner"), F.lit(0).alias("rank"), F.array().cast("array<int>").alias("steps")
    )
    seen = reached[0] if len(reached) == 1 else reached[0].unionByName(reached[1])
    course_hits = seen.select("root", "code", first.alias("order")).unionByName(
        trees.where(F.col("kind") == "course").select("root", "code", "order")
    )
    course_nodes = course_hits.groupBy("root", "code").agg(F.min("order").alias("order"))
    course_nodes = _describe_courses(course_nodes, courses, levels)
    rules = _levelled(trees.where(F.col("kind") != "course"), levels, "owner")
    rules = rules.select(
        "root", "id", F.col("kind").alias("type"), "order", "level", "label", "relation", "text",
        F.col("pat_subject").alias("subject"), F.col("pat_min_level").alias("minimum_level"), F.lit(False).alias("placeholder"),
    )
    nodes = course_nodes.unionByName(rules, allowMissingColumns=True)
    cut = None
    if max_nodes is not None:
        place = F.row_number().over(Window.partitionBy("root").orderBy("order", "id"))
        # One more than the cap is kept to tell whether anything was cut.
        nodes = stage(nodes.withColumn("_place", place).where(F.col("_place") <= max_nodes + 1))
        cut = nodes.where(F.col("_place") > max_nodes).select("root").distinct()
        nodes = nodes.where(F.col("_place") <= max_nodes).drop("_place")
    else:
        nodes = stage(nodes)
    edges = dedupe_edges(tree_edges(trees, "root"), "root")
    if max_nodes is not None:
        ends = nodes.select("root", "id")
        edges = edges.join(ends.withColumnRenamed("id", "source"), ["root", "source"], "left_semi")
        edges = edges.join(ends.withColumnRenamed("id", "target"), ["root", "target"], "left_semi")
    edges = edges.select("root", "source", "target", "relation", "qualifier", "symmetric", "order")
    diagnostics = diagnose(nodes, cycles, cut, max_nodes)
    truncated = cut.withColumn("truncated", F.lit(True)) if cut is not None else roots.limit(0).withColumn("truncated", F.lit(True))
    summary = roots.join(truncated, "root", "left").select(
        "root", F.lit(direction).alias("direction"), F.lit(depth).cast("int").alias("depth"),
        F.array(*map(F.lit, picked)).alias("relations"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )
    return Graph(nodes, edges, diagnostics, summary)


def _spread_none(roots: DataFrame) -> DataFrame:
    return roots.select("root", F.col("root").alias("code"), F.lit(0).alias("distance"))


def _levelled(rows: DataFrame, levels: DataFrame | None, code: str) -> DataFrame:
    if levels is None:
        return rows.withColumn("level", F.lit(None).cast("int"))
    return rows.join(levels.select(F.col("code").alias(code), "level"), code, "left")


def _describe_courses(course_nodes: DataFrame, courses: DataFrame, levels: DataFrame | None) -> DataFrame:
    """Catalog fields of course nodes; courses the catalog lacks become placeholders."""
    optional = {"subject": "string", "title": "string", "credits": "string", "source_url": "string"}
    have = [F.col(c) if c in courses.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    records = _levelled(courses.select("code", *have, F.lit(True).alias("_known")), levels, "code")
    joined = course_nodes.join(records, "code", "left")
    lost = F.col("_known").isNull()
    return joined.select(
        "root", _course_id(F.col("code")).alias("id"), F.lit("course").alias("type"), "code", "order",
        F.when(lost, F.split_part("code", F.lit(" "), F.lit(1))).otherwise(F.col("subject")).alias("subject"),
        F.when(lost, NO_DETAILS).otherwise(F.col("title")).alias("title"),
        F.when(lost, "").otherwise(F.col("credits")).alias("credits"),
        F.when(~lost, F.col("source_url")).alias("source_url"),
        "level", lost.alias("placeholder"),
    )


def diagnose(nodes: DataFrame, cycles: DataFrame | None, cut: DataFrame | None, max_nodes: int | None) -> DataFrame:
    """``(root, type, relation, message, courses)``: cycles that touch the graph, unresolved courses, cuts."""
    none = F.lit(None).cast("string")
    lost = nodes.where(F.col("placeholder")).groupBy("root").agg(F.array_sort(F.collect_set("code")).alias("courses"))
    rows = lost.select("root", F.lit("unresolved").alias("type"), none.alias("relation"), F.lit(UNRESOLVED_MESSAGE).alias("message"), "courses")
    if cycles is not None:
        touching = cycles.withColumn("code", F.explode("courses")).join(nodes.select("root", "code"), "code")
        rows = touching.select("root", "type", "relation", "message", "courses").distinct().unionByName(rows)
    if cut is not None:
        rows = rows.unionByName(cut.select(
            "root", F.lit("truncated").alias("type"), none.alias("relation"),
            F.lit(TRUNCATED_MESSAGE.format(max_nodes)).alias("message"), F.lit(None).cast("array<string>").alias("courses"),
        ))
    return rows


def visible_diagnostics(diagnostics: DataFrame, nodes: DataFrame) -> DataFrame:
    """Diagnostics without courses, and those that name a course among the shown ``nodes(root, code)``."""
    columns = diagnostics.columns
    general = diagnostics.where(F.col("courses").isNull())
    shown = nodes.select("root", "code").where(F.col("code").isNotNull())
    named = diagnostics.withColumn("code", F.explode("courses")).join(shown, ["root", "code"], "left_semi")
    return general.unionByName(named.select(*columns).distinct())


def node_score() -> Column:
    """How much a node tells: real beats placeholder, then level, title, url."""
    titled = F.col("title").isNotNull() & ~F.col("title").isin("", NO_DETAILS)
    linked = F.coalesce(F.col("source_url"), F.lit("")) != ""
    return (
        F.when(F.coalesce("placeholder", F.lit(False)), 0).otherwise(8)
        + F.when(F.col("level").isNotNull(), 4).otherwise(0)
        + F.when(titled, 2).otherwise(0)
        + F.when(linked, 1).otherwise(0)
    )


def merge_graphs(graph: Graph, members: DataFrame) -> Graph:
    """Union of several roots' graphs per ``members(group, root)`` (say, per student).

    The best described node of an id wins, the earlier root on a tie; edges and diagnostics are
    distinct; edges that lost an end are dropped; a group is truncated if any member is.
    """
    members = members.select("group", "root").distinct()
    fields = [c for c in graph.nodes.columns if c not in ("root", "id")]
    named = graph.nodes.join(members, "root").withColumn("_rank", F.struct((-node_score()).alias("score"), F.col("root")))
    best = named.groupBy("group", "id").agg(F.min_by(F.struct(*fields), "_rank").alias("n"))
    nodes = best.select("group", "id", "n.*")
    # Equal edges have the same ends.  Ends that the edge's own root has are in every group of the root, so they
    # are looked up once per root; only edges that lost an end there meet the nodes of the whole group.
    at = graph.nodes.select("root", "id").distinct()
    marked = graph.edges
    for end in ("source", "target"):
        marked = marked.join(at.select("root", F.col("id").alias(end), F.lit(True).alias(f"_{end}")), ["root", end], "left")
    marked = marked.withColumn("_whole", F.col("_source").isNotNull() & F.col("_target").isNotNull()).drop("_source", "_target")
    store = Staged(graph.edges.sparkSession)
    loose = store.append(marked, F.count_if(~F.col("_whole")).alias("loose"))["loose"]
    ranked = store.last().join(members, "root").withColumn("order", F.struct(F.col("root").alias("from_root"), F.col("order").alias("order")))
    kept = ranked.where("_whole")
    if loose:
        ends = named.select("group", "id").distinct()
        found = ranked.where("NOT _whole")
        for end in ("source", "target"):
            found = found.join(ends.withColumnRenamed("id", end), ["group", end], "left_semi")
        kept = kept.unionByName(found)
    edges = dedupe_edges(kept.drop("_whole"), "group", keep_qualifier=True).drop("order")
    diagnostics = graph.diagnostics.join(members, "root").drop("root").distinct()
    parts = graph.summary.join(members, "root")
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("relations"))))
    summary = parts.groupBy("group").agg(
        F.min("root").alias("root"), F.lit("backward").alias("direction"),
        F.min_by("depth", F.when(F.col("depth").isNotNull(), F.col("root"))).alias("depth"),
        names.alias("relations"), F.bool_or("truncated").alias("truncated"),
    )
    return Graph(nodes, edges, diagnostics, summary)


def load_report(requests: DataFrame, bad: DataFrame) -> DataFrame:
    """Per group "loaded n of m" with the failed roots: ``requests(group, root)``."""
    failed = bad.select(F.col("requested").alias("root"), "error").distinct()
    joined = requests.distinct().join(failed, "root", "left")
    return joined.groupBy("group").agg(
        F.count_if(F.col("error").isNull()).cast("bigint").alias("loaded"),
        F.count(F.lit(1)).alias("asked"),
        F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.col("root")))).alias("failed"),
    )


def project_edges(nodes: DataFrame, edges: DataFrame, key: str = "root", sources: DataFrame | None = None) -> DataFrame:
    """Junctions contracted away: direct edges between the remaining nodes.

    A path runs through junctions of one relation; its first non-empty qualifier counts; it is
    symmetric if any part is; self loops are dropped.  With ``sources(key, id)`` only the edges that
    start at these nodes.  Edges that meet no junction are not walked.
    """
    rules = nodes.where(F.col("type").isin("all", "any")).select(key, F.col("id").alias("at"), F.lit(True).alias("through")).distinct()
    none = F.nullif(F.col("qualifier"), F.lit(""))
    links = edges.select(key, "source", F.col("target").alias("at"), "relation", none.alias("qualifier"), "symmetric")
    links = links.join(rules, [key, "at"], "left").join(rules.select(key, F.col("at").alias("source"), F.col("through").alias("within")), [key, "source"], "left")
    links = stage(links.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("through", "within")}))
    starts = links.where(~F.col("within"))
    if sources is not None:
        starts = starts.join(sources.select(key, F.col("id").alias("source")), [key, "source"], "left_semi")
    onward = links.where("within").select(
        key, F.col("source").alias("at"), F.col("at").alias("next"), "relation",
        F.col("qualifier").alias("next_qualifier"), F.col("symmetric").alias("next_symmetric"), F.col("through").alias("next_through"),
    )
    columns = [key, "source", "at", "relation", "qualifier", "symmetric", "through"]
    starts = starts.select(*columns).withColumn("qualifier", F.coalesce("qualifier", F.lit("")))

    def step(front, _):
        moved = front.where("through").join(onward, [key, "at", "relation"])
        qualifier = F.when(F.col("qualifier") != "", F.col("qualifier")).otherwise(F.coalesce("next_qualifier", F.lit("")))
        hop = moved.select(
            key, "source", F.col("next").alias("at"), "relation", qualifier.alias("qualifier"),
            (F.col("symmetric") | F.col("next_symmetric")).alias("symmetric"), F.col("next_through").alias("through"),
        )
        return hop.groupBy(key, "source", "at", "relation", "qualifier", "through").agg(F.bool_or("symmetric").alias("symmetric"))

    walked = grow(starts.where("through"), [key, "source", "at", "relation", "qualifier"], step)
    ended = walked.unionByName(starts.where(~F.col("through")))
    ended = ended.where(~F.col("through") & (F.col("source") != F.col("at")))
    return ended.groupBy(key, "source", F.col("at").alias("target"), "relation", "qualifier").agg(F.bool_or("symmetric").alias("symmetric"))


def leaf_projection(req_nodes: DataFrame) -> DataFrame:
    """Contraction of a whole catalog in one pass: every leaf course joined to its owner."""
    leaves = tree_nodes(req_nodes.where(F.col("kind") == "course")).withColumn("upper", _course_id(F.col("owner")))
    edges = tree_edges(leaves.withColumn("order", F.lit(0))).where(F.col("source") != F.col("target"))
    return edges.select("source", "target", "relation", F.coalesce("qualifier", F.lit("")).alias("qualifier"), "symmetric").distinct()


def visible_ids(projected: DataFrame, roots: DataFrame, key: str = "root") -> DataFrame:
    """``(key, id)``: nodes that reach a root along projected edges, plus direct prerequisite dependents."""
    into = stage(projected.select(key, F.col("target").alias("id"), F.col("source").alias("from")).distinct())
    seed = roots.select(key, F.col("id")).distinct()
    reached = grow(seed, [key, "id"], lambda front, _: front.join(into, [key, "id"]).select(key, F.col("from").alias("id")).distinct())
    return reached.unionByName(direct_dependents(projected, roots, key)).distinct()


def direct_dependents(projected: DataFrame, roots: DataFrame, key: str = "root") -> DataFrame:
    """Courses that use a root directly as a prerequisite."""
    hits = projected.where((F.col("relation") == "prerequisite") & F.col("target").startswith("course:"))
    hits = hits.join(roots.select(key, F.col("id").alias("source")), [key, "source"], "left_semi")
    return hits.select(key, F.col("target").alias("id")).distinct()


def restrict(nodes: DataFrame, edges: DataFrame, ids: DataFrame, key: str = "root") -> tuple[DataFrame, DataFrame]:
    """Nodes with these ids and the edges between them."""
    kept = edges.join(ids.withColumnRenamed("id", "source"), [key, "source"], "left_semi")
    kept = kept.join(ids.withColumnRenamed("id", "target"), [key, "target"], "left_semi")
    return nodes.join(ids, [key, "id"], "left_semi"), kept


def requirement_groups(nodes: DataFrame, edges: DataFrame, owners: DataFrame, max_depth: int | None = 1, key: str = "root") -> DataFrame:
    """``(key, owner, arm, id, hops)``: the courses under each arm of an owner's prerequisite.

    A single top ALL gives one group per arm, anything else one group; courses up to ``max_depth``
    course hops away belong to it (at least 1; None = all).
    """
    pre = edges.where(F.col("relation") == "prerequisite").select(key, F.col("target").alias("at"), F.col("source").alias("from")).distinct()
    pre = stage(pre.join(nodes.select(key, F.col("id").alias("from"), "type"), [key, "from"]))
    tops = owners.select(key, F.col("id").alias("owner")).join(pre.withColumnRenamed("at", "owner"), [key, "owner"])
    shape = tops.groupBy(key, "owner").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("type") == "all").alias("is_all"))
    split = tops.join(shape, [key, "owner"]).withColumn("by_arm", (F.col("n") == 1) & F.col("is_all"))
    whole = split.where(~F.col("by_arm")).select(key, "owner", F.lit("").alias("arm"), F.col("from").alias("id"), "type")
    arms = split.where("by_arm").select(key, "owner", F.col("from").alias("at")).join(pre, [key, "at"]).select(
        key, "owner", F.col("from").alias("arm"), F.col("from").alias("id"), "type"
    )
    below = pre.select(key, F.col("at").alias("id"), F.col("from"), "type")

    def first_courses(starts: DataFrame, name: list[str]) -> DataFrame:
        """``(key, name..., id)``: from ``starts`` down to the first courses, through junctions only."""

        def deeper(front, _):
            under = front.where(F.col("type") != "course").drop("type").join(below, [key, "id"])
            return under.select(key, *name, F.col("from").alias("id"), "type").distinct()

        open_ends = starts.where(F.col("type").isin("all", "any"))
        met = starts.unionByName(grow(open_ends, [key, *name, "id"], deeper))
        return met.where(F.col("type") == "course").select(key, *name, "id").distinct()

    first = stage(first_courses(whole.unionByName(arms).distinct(), ["owner", "arm"]).withColumn("hops", F.lit(1)))
    limit = None if max_depth is None else max(1, int(max_depth)) - 1
    if limit == 0:
        return first
    # What each course needs first; if there is one hop to go, of the first courses only.
    starts = below.withColumnRenamed("id", "of").withColumnRenamed("from", "id")
    asked = first.select(key, F.col("id").alias("of")) if limit == 1 else nodes.where(F.col("type") == "course").select(key, F.col("id").alias("of"))
    hops = first_courses(starts.join(asked.distinct(), [key, "of"], "left_semi"), ["of"])
    hops = stage(hops.select(key, F.col("of").alias("id"), F.col("id").alias("from")))

    def onward(front, hop):
        return front.join(hops, [key, "id"]).select(key, "owner", "arm", F.col("from").alias("id"), F.lit(hop + 1).alias("hops")).distinct()

    found = grow(first, [key, "owner", "arm", "id"], onward, limit)
    return found.select(key, "owner", "arm", "id", "hops")


def neighborhood(edges: DataFrame, starts: DataFrame, parents: DataFrame, key: str = "root") -> DataFrame:
    """``(key, start, id)``: a node, its one-hop neighbours over ``edges``, and the groups above them.

    ``parents(key, id, parent)`` is the containment forest of groups.
    """
    begin = starts.select(key, F.col("id").alias("start"), "id")
    outgoing = begin.join(edges.select(key, F.col("source").alias("id"), F.col("target").alias("to")), [key, "id"])
    incoming = begin.join(edges.select(key, F.col("target").alias("id"), F.col("source").alias("to")), [key, "id"])
    near = begin.unionByName(outgoing.unionByName(incoming).select(key, "start", F.col("to").alias("id"))).distinct()
    up = stage(parents.where(F.col("parent").isNotNull()).select(key, "id", "parent").distinct())
    return grow(near, [key, "start", "id"], lambda front, _: front.join(up, [key, "id"]).select(key, "start", F.col("parent").alias("id")).distinct())


def node_relation(nodes: DataFrame, edges: DataFrame, key: str = "root") -> DataFrame:
    """Relation a node is shown under: its own, else that of the first edge that touches it."""
    ends = edges.select(key, F.explode(F.array("source", "target")).alias("id"), "relation", "order")
    first = ends.groupBy(key, "id").agg(F.min_by("relation", F.struct("order", "relation")).alias("edge_relation"))
    joined = nodes.join(first, [key, "id"], "left")
    return joined.withColumn("shown_relation", F.coalesce(F.nullif("relation", F.lit("")), "edge_relation", F.lit(""))).drop("edge_relation")


def outline(nodes: DataFrame, edges: DataFrame, roots: DataFrame, targets: DataFrame, dependent_ids: DataFrame, key: str = "root") -> DataFrame:
    """Course list of a view: ``(key, level, code, kind, position)``, unknown levels last.

    ``roots``, ``targets`` and ``dependent_ids`` are ``(key, id)``.  A target is marked first, then
    a dependent, then the selected course, then the relation.
    """

    def flag(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(key, "id").distinct().withColumn(name, F.lit(True))

    listed = node_relation(nodes, edges, key).where(F.col("type") == "course")
    listed = listed.join(flag(targets, "_t"), [key, "id"], "left").join(flag(dependent_ids, "_d"), [key, "id"], "left")
    listed = listed.join(flag(roots, "_r"), [key, "id"], "left")
    relation = F.when(F.col("shown_relation").isin(RELATIONS), F.initcap("shown_relation")).otherwise("Requirement")
    kind = F.when(F.col("_t"), "Target").when(F.col("_d"), "Uses course").when(F.col("_r"), "Selected").otherwise(relation)
    place = Window.partitionBy(key, "level").orderBy("code")
    return listed.withColumn("kind", kind).withColumn("position", F.row_number().over(place)).select(
        key, "level", "code", "kind", "position"
    )
