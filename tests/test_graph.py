import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from trellis import session
from trellis.operators import graph, levels, requirements, verdicts

REQ = [
    ("COMP 4211", "prerequisite", "COMP 2011 AND (COMP 2711 OR MATH 2111)"),
    ("COMP 2011", "prerequisite", "COMP 1021 (Grade A)"),
    ("COMP 2011", "corequisite", "COMP 2711"),
    ("COMP 2711", "corequisite", "COMP 2011"),
    ("COMP 4211", "exclusion", "COMP 2711"),
    ("COMP 2711", "exclusion", "COMP 4211"),
    ("COMP 4900", "prerequisite", "Any COMP course of 3000-level or above AND approval"),
]
CODES = ["COMP 4211", "COMP 2011", "COMP 1021", "COMP 2711", "COMP 4900"]


@pytest.fixture(scope="module")
def book(spark):
    courses = spark.createDataFrame([(c, c[:4], f"T {c}", "3", "/x") for c in CODES], "code string, subject string, title string, credits string, source_url string")
    nodes, _ = requirements.parse_requirements(spark.createDataFrame(REQ, "owner string, relation string, raw string"))
    nodes = nodes.persist()
    level, cycles = levels.dependency_levels(courses, nodes)
    return courses, nodes, level, cycles


def test_backward_graph(spark, book):
    courses, nodes, level, cycles = book
    roots = spark.createDataFrame([("COMP 4211",)], "root string")
    g = graph.build_graph(roots, courses, nodes, level, cycles, depth=2)
    got = {r.id: r for r in g.nodes.collect()}
    assert set(got) == {
        "course:COMP 4211", "course:COMP 2011", "course:COMP 2711", "course:MATH 2111", "course:COMP 1021",
        "bool:COMP 4211:prerequisite:0", "bool:COMP 4211:prerequisite:0.1",
    }
    assert got["course:MATH 2111"].placeholder and got["course:MATH 2111"].title == graph.NO_DETAILS
    edges = rows(g.edges, "source", "target", "relation", "qualifier", "symmetric")
    assert ("course:COMP 1021", "course:COMP 2011", "prerequisite", "(Grade A)", False) in edges
    # Mutual corequisites and exclusions appear once.
    assert [e for e in edges if e[2] == "exclusion"] == [("course:COMP 4211", "course:COMP 2711", "exclusion", None, True)]
    assert len([e for e in edges if e[2] == "corequisite"]) == 1
    assert rows(g.diagnostics, "type", "courses") == [("unresolved", ["MATH 2111"])]
    only_root = graph.build_graph(roots, courses, nodes, level, cycles, depth=0)
    assert rows(only_root.nodes, "id") == [("course:COMP 4211",)]
    small = graph.build_graph(roots, courses, nodes, level, cycles, depth=2, max_nodes=4)
    assert small.nodes.count() == 4 and small.summary.first().truncated
    projected = graph.project_edges(g.nodes, g.edges)
    assert ("course:COMP 2711", "course:COMP 4211", "prerequisite") in rows(projected, "source", "target", "relation")
    ids = graph.visible_ids(projected, spark.createDataFrame([("COMP 4211", "course:COMP 4211")], "root string, id string"))
    assert rows(ids, "id") == [("course:COMP 1021",), ("course:COMP 2011",), ("course:COMP 2711",), ("course:COMP 4211",), ("course:MATH 2111",)]


def test_cap_inside_the_expansion(spark):
    """On random rules with cycles and a hub: the same nodes, edges and cuts as cutting the whole graph."""
    rng = random.Random(5)
    codes = [f"ARTS {1000 + k}" for k in range(40)]
    pick = lambda: rng.choice([codes[3], *codes, "GONE 9999"])
    stated = [(c, rel, " AND ".join(f"({pick()} OR {pick()})" if rng.random() < 0.4 else pick() for _ in range(rng.randint(1, 3)))) for c in codes for rel in ("prerequisite", "corequisite") if rng.random() < 0.6]
    courses = spark.createDataFrame([(c, "ARTS", "t", "3", "") for c in codes], "code string, subject string, title string, credits string, source_url string")
    nodes, _ = requirements.parse_requirements(spark.createDataFrame(stated, "owner string, relation string, raw string"))
    nodes = nodes.persist()
    level, cycles = levels.dependency_levels(courses, nodes)
    roots = courses.select(F.col("code").alias("root"))
    for direction in ("backward", "forward"):
        whole = graph.build_graph(roots, courses, nodes, level, cycles, direction=direction, max_nodes=None)
        listed, edges = {}, rows(whole.edges, "root", "source", "target", "relation", "qualifier")
        for r in whole.nodes.select("root", "id", "order").collect():
            listed.setdefault(r.root, []).append((r.order, r.id))
        for cap in (1, 4, 11):
            small = graph.build_graph(roots, courses, nodes, level, cycles, direction=direction, max_nodes=cap)
            kept = {(root, i) for root, found in listed.items() for _, i in sorted(found)[:cap]}
            assert set(rows(small.nodes, "root", "id")) == kept
            assert rows(small.edges, "root", "source", "target", "relation", "qualifier") == [e for e in edges if (e[0], e[1]) in kept and (e[0], e[2]) in kept]
            assert rows(small.summary.where("truncated"), "root") == sorted((root,) for root, found in listed.items() if len(found) > cap)


def test_capped_reach_stops(spark):
    """A chain of 300 courses below one that a thousand others need: rows and rounds stay within the cap."""
    links = [(f"C{k:04d}", f"C{k + 1:04d}") for k in range(300)] + [(f"H{k:04d}", "C0300") for k in range(1000)]
    hops = spark.createDataFrame(links, "code string, to string")
    roots = spark.createDataFrame([("C0000",), ("C0295",), ("C0300",)], "root string")
    found = graph._spread(roots, hops, None, 9)
    assert rows(found.groupBy("root").agg(F.count("*"), F.max("distance"))) == [("C0000", 9, 8), ("C0295", 6, 5), ("C0300", 1, 0)]
    back = hops.select(F.col("to").alias("code"), F.col("code").alias("to"))
    found = rows(graph._spread(roots.where("root = 'C0300'"), back, None, 9), "distance", "code")
    assert found == [(0, "C0300"), (1, "C0299"), *((1, f"H{k:04d}") for k in range(7))]


def test_forward_graph_and_errors(spark, book):
    courses, nodes, level, cycles = book
    g = graph.build_graph(spark.createDataFrame([("COMP 1021",)], "root string"), courses, nodes, level, cycles, direction="forward")
    assert {"course:COMP 2011", "course:COMP 4211", "course:MATH 2111"} <= {r.id for r in g.nodes.collect()}
    good, bad = graph.check_roots(spark.createDataFrame([("nope",), ("NOPE 0000",), ("comp 2011",)], "root string"), courses)
    assert rows(good) == [("COMP 2011",)]
    assert rows(bad) == [("NOPE 0000", "course_not_found"), ("nope", "invalid_course_code")]
    with pytest.raises(graph.RequestError):
        graph.pick_relations("prereqs,unknown")
    with pytest.raises(graph.RequestError):
        graph.build_graph(courses.limit(0).select(F.col("code").alias("root")), courses, nodes, level, cycles, direction="sideways")
    assert graph.pick_relations("coreqs, prerequisite") == ["corequisite", "prerequisite"]


def test_levels_of_components(spark, book):
    _, _, level, cycles = book
    # COMP 2011 and COMP 2711 are one component; MATH 2111 is an unknown alternative.
    assert rows(level) == [("COMP 1021", 1), ("COMP 2011", 2), ("COMP 2711", 2), ("COMP 4211", 3), ("COMP 4900", 1)]
    assert cycles.count() == 0


def brute_levels(codes, trees, ties):
    comp = {c: c for c in codes}
    for a, b in ties:
        old, new = comp[a], comp[b]
        comp = {c: new if x == old else x for c, x in comp.items()}
    refs = lambda t: [t] if isinstance(t, str) else sum((refs(x) for x in t[1]), [])
    deps = {k: {comp[r] for c in codes if comp[c] == k and c in trees for r in refs(trees[c]) if r in comp} for k in set(comp.values())}
    reach = {k: set(v) for k, v in deps.items()}
    for _ in deps:
        reach = {k: v | set().union(*[reach[x] for x in v]) if v else v for k, v in reach.items()}
    memo = {}

    def rank(t):
        if isinstance(t, str):
            return level(comp[t]) if t in comp else None
        vs = [rank(x) for x in t[1]]
        if t[0] == "all":
            return None if None in vs else max(vs)
        known = [v for v in vs if v is not None]
        return max(known) if known else None

    def level(k):
        if k in reach[k]:
            return None
        if k not in memo:
            own = [1 if c not in trees else (None if rank(trees[c]) is None else 1 + rank(trees[c])) for c in codes if comp[c] == k]
            memo[k] = None if None in own else max(own)
        return memo[k]

    return {c: level(comp[c]) for c in codes}


def test_levels_match_direct_evaluation(spark):
    rng = random.Random(11)
    reqs, expected, every = [], {}, []
    for g in range(30):
        codes = [f"{''.join(chr(65 + (g // 26 ** i) % 26) for i in range(4))} {1000 + i}" for i in range(rng.randint(3, 8))]
        trees, ties = {}, []

        def tree(pool, depth=0):
            if depth < 2 and rng.random() < 0.5:
                return (rng.choice(["any", "all"]), [tree(pool, depth + 1) for _ in range(rng.randint(2, 3))])
            return "ZZZZ 9999" if rng.random() < 0.1 else rng.choice(pool)

        def text(t):
            return t if isinstance(t, str) else "(" + (" OR " if t[0] == "any" else " AND ").join(map(text, t[1])) + ")"

        for i, c in enumerate(codes):
            pool = codes if rng.random() < 0.15 else codes[:i]
            if pool and rng.random() < 0.8:
                trees[c] = tree(pool)
                reqs.append((c, "prerequisite", text(trees[c])))
            if i and rng.random() < 0.15:
                ties.append((c, codes[i - 1]))
                reqs.append((c, "corequisite", codes[i - 1]))
        expected.update(brute_levels(codes, trees, ties))
        every += codes
    nodes, _ = requirements.parse_requirements(spark.createDataFrame(reqs, "owner string, relation string, raw string"))
    courses = spark.createDataFrame([(c,) for c in every], "code string")
    level, cycles = levels.dependency_levels(courses, nodes.persist())
    assert {r.code: r.level for r in level.collect()} == expected
    assert cycles.count() > 0


def test_long_chain_component(spark):
    n = 300
    links = spark.createDataFrame([(f"C{i:04d}", f"C{i + 1:04d}") for i in range(n)], "a string, b string")
    vertices = spark.createDataFrame([(f"C{i:04d}",) for i in range(n + 2)], "code string")
    assert rows(levels.connected_components(vertices, links).groupBy("component").count()) == [("C0000", n + 1), ("C0301", 1)]


def test_verdicts(spark):
    req = [
        ("COMP 3111", "prerequisite", "COMP 2011 AND COMP 2711"), ("COMP 4212", "prerequisite", "COMP 2711 OR MATH 2111"),
        ("COMP 4911", "prerequisite", "COMP 3111 AND permission of instructor"), ("COMP 4900", "prerequisite", "Any COMP course of 3000-level or above"),
    ]
    nodes, _ = requirements.parse_requirements(spark.createDataFrame(req, "owner string, relation string, raw string"))
    courses = spark.createDataFrame([(c,) for c in ["COMP 3111", "COMP 4212", "COMP 4911", "COMP 4900", "COMP 1991"]], "code string")
    done = {1: [], 2: ["comp2011"], 3: ["COMP 2011", "COMP 2711", "bad"], 4: ["MATH2111", "COMP 3111"]}
    completed = spark.createDataFrame([(s, c) for s, cs in done.items() for c in cs], "student int, code string")
    targets = spark.createDataFrame([(s, c) for s in done for c in ["COMP 3111", "COMP 4212", "comp4911", "COMP 4900", "COMP 1991", "NOPE 1000"]], "student int, code string")
    got = {}
    for r in verdicts.requirement_status(targets, courses, nodes, completed).orderBy("student", "code").collect():
        got.setdefault(r.student, []).append(r.status)
    # COMP 1991, 3111, 4212, 4900, 4911
    assert got == {
        1: ["met", "unmet", "unmet", "unmet", "unmet"],
        2: ["met", "unmet", "unmet", "unmet", "unmet"],
        3: ["met", "met", "met", "unmet", "unmet"],
        4: ["met", "completed", "met", "met", "unknown"],
    }


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_known_rows_are_not_shuffled(spark):
    """A round deals its candidates out once; the known rows are read bucket by bucket."""
    store = session.Bucketed(spark, ["root", "code"])
    hops = spark.range(400).select(F.col("id").cast("string").alias("code"), (F.col("id") + 1).cast("string").alias("to"))
    store.append(store.dealt(spark.range(50).select(F.lit("r").alias("root"), F.col("id").cast("string").alias("code"), F.lit(0).alias("distance"))))
    candidates = store.last().join(hops, "code").select("root", F.col("to").alias("code"), F.lit(1).alias("distance"))
    lines = plan_of(session.fresh_rows(store, candidates)).splitlines()
    anti = next(k for k, line in enumerate(lines) if "SortMergeJoin" in line and "LeftAnti" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    known = [k for k in range(anti + 1, len(lines)) if depth(lines[k]) == depth(lines[anti]) + 3][1]
    below = "\n".join(lines[known:])
    assert "Bucketed: true" in below and "Exchange" not in below, plan_of(session.fresh_rows(store, candidates))
    assert "\n".join(lines[anti:known]).count("Exchange hashpartitioning(root") == 1
    for n in range(20):  # many small rounds are put together; the last one stays by itself
        store.append(store.dealt(spark.createDataFrame([("x", str(n), n)], "root string, code string, distance int")))
        assert rows(store.last()) == [("x", str(n), n)]
    assert store.all().count() == 70 and store.files < 20
    assert store.close().count() == 70


def brute_components(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
    changed = True
    while changed:
        changed = False
        for a in reach:
            more = set().union(*(reach.get(b, set()) for b in reach[a])) - reach[a]
            if more:
                reach[a] |= more
                changed = True
    return {frozenset(b for b in reach[a] if a in reach.get(b, set())) for a in reach if a in reach[a]}


def components_of(spark, edges):
    groups = {}
    for r in levels.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect():
        groups.setdefault(r.scc, set()).add(r.vertex)
    return {frozenset(g) for g in groups.values()}


def test_strong_components(spark):
    rng = random.Random(4)
    edges = []
    for g in range(25):  # many small random graphs next to each other, loops and repeated edges included
        n = rng.randint(1, 7)
        edges += [(f"g{g}v{rng.randrange(n)}", f"g{g}v{rng.randrange(n)}") for _ in range(rng.randint(1, 2 * n))]
    assert components_of(spark, edges) == brute_components(edges)


def test_long_chains_and_rings(spark):
    """A chain off a cycle, a ring, and a chain that closes a cycle: far fewer rounds than vertices."""
    ring = [(f"r{i:04d}", f"r{(i + 1) % 300:04d}") for i in range(300)]
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(2000)] + [("c0001", "c0000")]
    handle = [("h0000", "h0001"), ("h0001", "h0000")] + [(f"h{i:04d}", f"h{i + 1:04d}") for i in range(1, 400)] + [("h0400", "h0000")]
    jobs = []
    real = session.Staged.append
    session.Staged.append = lambda self, *a: jobs.append(1) or real(self, *a)
    try:
        got = components_of(spark, ring + chain + handle)
    finally:
        session.Staged.append = real
    assert got == {frozenset(a for a, _ in ring), frozenset(["c0000", "c0001"]), frozenset(f"h{i:04d}" for i in range(401))}
    assert len(jobs) < 120, len(jobs)


def test_a_vertex_counts_down_once(spark):
    """Nodes with many links settle when the last one is in; what waits for itself is handed to ``unblock``."""
    wide = [(f"leaf{i}", "top", 500) for i in range(499)] + [("mid", "top", 500), ("leaf1", "mid", 1), ("a", "b", 1), ("b", "a", 2), ("leaf2", "a", 2), ("b", "after", 1)]
    links = spark.createDataFrame(wide, "f_node string, t_node string, of long")
    settled = spark.createDataFrame([(f"leaf{i}", i) for i in range(499)] + [("lone", -1)], "node string, value int")
    asked = []

    def unblock(waiting):
        asked.append(rows(waiting.select("f_node", "t_node")))
        return spark.createDataFrame([("a", None), ("b", None)], "node string, value int") if len(asked) == 1 else None

    got = session.countdown(links, ["node"], None, settled, lambda r: r.groupBy("node").agg(F.max("value").alias("value")), unblock)
    found = {r.node: r.value for r in got.collect()}
    assert (found["top"], found["mid"], found["lone"], found["a"], found["b"], found["after"]) == (498, 1, -1, None, None, None)
    assert len(found) == got.count() == 505
    assert asked[0] == [("a", "b"), ("b", "a"), ("b", "after")]


def test_buckets_of_a_loop_follow_its_rows(spark, monkeypatch):
    """A small loop does not write a file per shuffle partition in every round; a loop that outgrows its buckets gets more."""
    seen, real = [], session.Bucketed.append
    monkeypatch.setattr(session.Bucketed, "append", lambda self, *a: seen.append(self.buckets) or real(self, *a))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(8 * cores))
    try:
        step = lambda front, n: front.where(F.col("id") < 2**10).select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("id"))
        one = spark.range(1, 2)
        assert session.grow(one, ["id"], step, 3).count() == 15
        assert set(seen) == {cores}
        monkeypatch.setattr(session.Bucketed, "BUCKET_ROWS", 8)
        seen.clear()
        assert rows(session.grow(one, ["id"], step)) == sorted([(i,) for i in range(1, 2**11)], key=repr)
        assert seen[0] == cores and seen[-1] == 8 * cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_merge_looks_ends_up_per_root(spark, book):
    """Edges whose ends their own root has never meet the group's nodes; the others still do."""
    courses, nodes, level, cycles = book
    roots = spark.createDataFrame([("COMP 4211",), ("COMP 2011",)], "root string")
    members = spark.createDataFrame([("both", "COMP 4211"), ("both", "COMP 2011"), ("one", "COMP 4211")], "group string, root string")
    g = graph.build_graph(roots, courses, nodes, level, cycles, depth=2)
    whole = graph.merge_graphs(g, members).edges
    assert "LeftSemi" not in whole._jdf.queryExecution().optimizedPlan().toString()
    # COMP 4211 loses two nodes: COMP 1021 is in the other root's graph, MATH 2111 in no other.
    lost = (F.col("root") == "COMP 4211") & F.col("id").isin("course:COMP 1021", "course:MATH 2111")
    g.nodes = g.nodes.where(~lost)
    touched = rows(whole.where(F.array_contains(F.array("source", "target"), "course:MATH 2111")), "group", "source", "target")
    alone = rows(whole.where((F.col("group") == "one") & F.array_contains(F.array("source", "target"), "course:COMP 1021")), "group", "source", "target")
    assert len(touched) == 2 and len(alone) == 1
    got = rows(graph.merge_graphs(g, members).edges, "group", "source", "target")
    assert got == [e for e in rows(whole, "group", "source", "target") if e not in touched and e not in alone]


def test_direct_groups_need_no_projection(spark, book, monkeypatch):
    courses, nodes, level, cycles = book
    roots = spark.createDataFrame([("COMP 4211",)], "root string")
    g = graph.build_graph(roots, courses, nodes, level, cycles, depth=1)
    monkeypatch.setattr(graph, "project_edges", None)
    found = graph.requirement_groups(g.nodes, g.edges, roots.select("root", F.concat(F.lit("course:"), "root").alias("id")), 1)
    assert rows(found, "id", "hops") == [("course:COMP 2011", 1), ("course:COMP 2711", 1), ("course:MATH 2111", 1)]


def test_views_without_levels_keep_nodes_and_edges(spark, book):
    """Without levels and cycles a graph has the same nodes, edges and other diagnostics."""
    courses, nodes, level, cycles = book
    roots = courses.select(F.col("code").alias("root"))
    for direction, cap in (("backward", None), ("forward", 3)):
        full = graph.build_graph(roots, courses, nodes, level, cycles, direction=direction, depth=1, max_nodes=cap)
        bare = graph.build_graph(roots, courses, nodes, None, None, direction=direction, depth=1, max_nodes=cap)
        shown = [c for c in full.nodes.columns if c != "level"]
        assert rows(bare.nodes, *shown) == rows(full.nodes, *shown) and bare.nodes.where("level IS NOT NULL").isEmpty()
        assert bare.nodes.columns == full.nodes.columns
        assert rows(bare.edges) == rows(full.edges)
        assert rows(bare.diagnostics, "root", "type", "courses") == rows(full.diagnostics.where("type <> 'cycle'"), "root", "type", "courses")


def test_projection_walks_junctions_only(spark, book, monkeypatch):
    """Edges that meet no junction are not walked; with sources only their edges come, the same ones."""
    courses, nodes, level, cycles = book
    roots = courses.select(F.col("code").alias("root"))
    g = graph.build_graph(roots, courses, nodes, level, cycles, direction="forward", depth=1)
    seeds = []
    monkeypatch.setattr(graph, "grow", lambda seed, *rest: (seeds.append(seed), session.grow(seed, *rest))[1])
    whole = rows(graph.project_edges(g.nodes, g.edges))
    own = roots.select("root", F.concat(F.lit("course:"), "root").alias("id"))
    some = rows(graph.project_edges(g.nodes, g.edges, sources=own))
    assert some == [e for e in whole if e[1] == "course:" + e[0]] and 0 < len(some) < len(whole)
    assert all(s.where("NOT through").isEmpty() for s in seeds)


def test_far_groups_need_no_projection(spark, book, monkeypatch):
    courses, nodes, level, cycles = book
    roots = spark.createDataFrame([("COMP 4211",)], "root string")
    g = graph.build_graph(roots, courses, nodes, level, cycles, relations="prerequisite")
    monkeypatch.setattr(graph, "project_edges", None)
    own = roots.select("root", F.concat(F.lit("course:"), "root").alias("id"))
    for depth in (2, None):
        found = graph.requirement_groups(g.nodes, g.edges, own, depth)
        assert rows(found, "id", "hops") == [("course:COMP 1021", 2), ("course:COMP 2011", 1), ("course:COMP 2711", 1), ("course:MATH 2111", 1)]


def test_cycles_without_levels(spark):
    req = [("AAAA 1001", "BBBB 1001"), ("BBBB 1001", "AAAA 1001 OR CCCC 1001"), ("CCCC 1001", "DDDD 1001"), ("EEEE 1001", "EEEE 1001 AND AAAA 1001"), ("DDDD 1001", "ZZZZ 9999")]
    courses = spark.createDataFrame([(f"{c * 4} 1001",) for c in "ABCDE"], "code string")
    nodes, _ = requirements.parse_requirements(spark.createDataFrame([(o, "prerequisite", r) for o, r in req], "owner string, relation string, raw string"))
    nodes = session.stage(nodes)
    whole = levels.dependency_levels(courses, nodes)[1]
    alone = levels.dependency_cycles(courses, nodes)
    assert alone.columns == whole.columns
    assert rows(alone) == rows(whole) and len(rows(alone)) == 2
