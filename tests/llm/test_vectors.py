"""Clustering, hard negatives and cover trees against brute force."""

import hashlib
import math

import numpy as np
import pytest

from trellis.llm import cover_tree
from trellis.llm.clustering import cluster_vectors, digest
from trellis.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, v string, at int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def lloyd(rows, clusters, rounds, dimensions, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in rows if finite(v) and len(v) == dimensions]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centres = [list(v) for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        placed = [nearest(v)[1] for _, v in kept]
        for k in range(len(centres)):
            own = [v for (_, v), p in zip(kept, placed) if p == k]
            if own:
                centres[k] = [sum(c) // len(own) for c in zip(*own)]
    return sorted(((i, *reversed(nearest(v))) for i, v in kept), key=repr), centres


@pytest.mark.parametrize("clusters,block,chunk", [(3, 2, 4), (8, 4, 100)])
def test_clusters(spark, clusters, block, chunk):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0) for i in range(40)]
    rows += [(3, rows[5][1], 1), (None, rows[5][1], 1), (None, rows[6][1], 1)]  # repeated and null ids, equal vectors
    rows += [(900 + k, rows[7][1], 0) for k in range(25)]  # a heap of copies
    rows += [(500, None, 0), (501, [1.0] * 5, 0), (502, [1.0] * 5 + [None], 0), (503, [float("nan")] + [0.0] * 5, 0), (504, [float("inf")] + [0.0] * 5, 0), (505, [], 0)]
    found, centroids = cluster_vectors(table(spark, rows), clusters=clusters, rounds=4, dimensions=6, block=block, chunk=chunk)
    want, centres = lloyd(rows, clusters, 4, 6)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    got = {r.cluster: r for r in centroids.withColumn("h", digest("centroid")).collect()}
    assert [got[k].centroid for k in range(len(centres))] == centres
    for k, centre in enumerate(centres):
        own = [d for _, c, d in want if c == k]
        assert (got[k].n, got[k].inertia) == (len(own), sum(own))
        assert got[k].h == hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    same = [0.5] * 4
    rows = [(1, same, 0), (2, same, 0)]  # equal centroids: the first takes all, the other stays empty
    found, centroids = cluster_vectors(table(spark, rows), clusters=8, rounds=2, dimensions=4)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0), (2, 0, 0)]
    assert sorted((r.cluster, r.n, r.inertia, r.centroid) for r in centroids.collect()) == [(0, 2, 0, [512] * 4), (1, 0, 0, [512] * 4)]
    found, centroids = cluster_vectors(table(spark, [(1, None, 0)]), clusters=8, rounds=2, dimensions=4)
    assert found.columns == ["vec_id", "cluster", "distance"] and found.count() == centroids.count() == 0
    with pytest.raises(Exception, match="not below"):
        cluster_vectors(table(spark, [(1, [1e30] * 4, 0)]), dimensions=4)
    with pytest.raises(ValueError, match="centroids"):
        cluster_vectors(table(spark, rows), clusters=1 << 20, dimensions=64)


def test_blocks_are_not_shuffled_again(spark):
    """Labels go to the bucketed blocks; the vectors themselves have no exchange."""
    from trellis.llm import clustering

    seen = []
    real = clustering._next_slices
    clustering._next_slices = lambda blocks, *rest: seen.append(real(blocks, *rest)) or seen[-1]
    try:
        rng = np.random.default_rng(1)
        cluster_vectors(table(spark, [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(50)]), rounds=1, dimensions=4)
    finally:
        clustering._next_slices = real
    plan = seen[0]._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    scans = [k for k, line in enumerate(plan.splitlines()) if "column_blocks" in line and "Bucketed: true" in line]
    assert scans, plan
    lines = plan.splitlines()
    for k in scans:  # nothing between the scan and its join deals the blocks out anew
        above = [x for x in lines[max(0, k - 4) : k] if "hashpartitioning(chunk" in x and "block" in x]
        assert not above, plan


def exact(points, queries, low, high, accept, ids, k):
    out = []
    for q in range(len(queries)):
        for w in range(low.shape[1]):
            ranked = sorted((-int(queries[q] @ p), int(ids[i]), i) for i, p in enumerate(points) if accept(q, i) and low[q, w] <= int(queries[q] @ p) <= high[q, w])
            out += [(q * low.shape[1] + w, -s, i) for s, i, _ in ranked[:k]]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies", "line", "one", "huge"])
def test_tree(kind):
    rng = np.random.default_rng(7)
    n = 400
    if kind == "clusters":
        points = rng.integers(-2000, 2000, (8, 5))[rng.integers(0, 8, n)] + rng.integers(-5, 6, (n, 5))
    elif kind == "copies":
        points = rng.integers(-3, 4, (n, 2))
    elif kind == "line":
        points = np.column_stack([2 ** rng.integers(0, 20, n), np.zeros(n, int)])
    elif kind == "one":
        points = np.zeros((1, 3), int)
    elif kind == "huge":
        points = rng.integers(-(1 << 26), 1 << 26, (n, 3))
    else:
        points = rng.integers(-100, 100, (n, 6))
    n = len(points)
    tree = cover_tree.build(points, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(n)) and (tree.points == points[tree.order]).all()
    ids = rng.permutation(n) // 2  # ids that repeat
    colours = rng.integers(0, 3, n)
    queries = rng.integers(-100, 100, (5, points.shape[1]))
    every = np.array([queries @ p for p in points]).T
    low = np.column_stack([np.full(5, np.iinfo(np.int64).min), np.percentile(every, 40, axis=1).astype(int), np.full(5, 5)])
    high = np.column_stack([np.full(5, np.iinfo(np.int64).max), np.percentile(every, 60, axis=1).astype(int), np.full(5, 4)])
    accept = lambda q, p: colours[tree.order][p][None, :] != (np.asarray(q) % 3)[:, None]
    (slots, scores, found, places), scored = cover_tree.search(tree, queries, low, high, accept, ids[tree.order], 3)
    got = sorted(zip(slots.tolist(), scores.tolist(), found.tolist()))
    assert got == exact(points, queries, low, high, lambda q, i: colours[i] != q % 3, ids, 3)
    assert (points[tree.order[places]] == tree.points[places]).all()
    if kind == "clusters":  # windows and best results rule most of the tree out
        assert scored < 0.5 * 5 * n


def covered(tree, points):
    """Every node's points within its radius of its centre, and children's centres within the level's reach."""
    x = np.column_stack([points[tree.order], np.sqrt(np.maximum(tree.largest**2 - (points[tree.order] ** 2).sum(1), 0))])

    def under(node):
        begin, n = tree.own[node]
        first, m = tree.below[node]
        return [*range(begin, begin + n), *(p for c in range(first, first + m) for p in under(c))]

    for node in range(len(tree.radii)):
        gaps = np.linalg.norm(x[under(node)] - tree.centres[node], axis=1)
        assert gaps.max() <= tree.radii[node] + 1e-3, (node, gaps.max(), tree.radii[node])


def test_radii():
    rng = np.random.default_rng(3)
    points = rng.integers(-500, 500, (12, 4))[rng.integers(0, 12, 300)] + rng.integers(-20, 21, (300, 4))
    tree = cover_tree.build(points, leaf=8)
    assert len(tree.radii) > 10
    covered(tree, points)


def mined(rows, every, positives, negatives, scale=256):
    kept = [(k, i, label, [math.floor(scale * float(np.float32(x))) for x in v]) for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and finite(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, i, label, v in kept:
        if i % every:
            continue
        ranked = sorted((-dot(v, w), j, b, m) for b, j, m, w in kept if b != a)
        best = [r for r in ranked if r[3] == label][:positives]
        for s, j, _, _ in best:
            p = -s
            fits = [r for r in ranked if r[3] != label and 50 * p <= -100 * r[0] <= 95 * p][:negatives]
            out += [(i, j, rank, r[1], p, -r[0]) for rank, r in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=5)], int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200 + k, rows[10][1], 1 + k % 2) for k in range(40)]  # a heap of equal vectors: ties by id
    rows += [(310, [0.0] * 5, 0), (320, [1.0, 1.0], 1), (330, [], 2), (340, [2.0] * 7, 7)]  # zero, short, empty, long; a label of its own
    rows += [(None, [1.0] * 5, 0), (350, None, 0), (360, [1.0] * 5, None), (370, [1.0, None, 0.0, 0.0, 0.0], 0), (380, [float("nan")] * 5, 1), (390, [-float("inf")] * 5, 1)]
    found = hard_negatives(table(spark, rows), every=10, shard=32, block=8)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == mined(rows, 10, 5, 3)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(10, [1.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, [0.7, 0.1], 1), (11, [0.7, 0.1], 1), (12, [0.9, 0.0], 0)]
    found = hard_negatives(table(spark, rows), every=10)
    assert sorted(map(tuple, found.collect())) == mined(rows, 10, 5, 3)


def test_no_rows(spark):
    assert hard_negatives(table(spark, [(1, None, 0)])).count() == 0
    assert hard_negatives(table(spark, [(1, [1.0], 0)])).count() == 0  # no anchors
    assert hard_negatives(table(spark, [(50, [1.0], 0)])).count() == 0  # nothing but the anchor
