"""Exact, line and near-duplicate operators against brute force."""

import random

import numpy as np
import pytest

from brute import exact, lines, near
from trellis.llm import exact_dedup, line_dedup, near_dup
from trellis.session import stage


def corpus(n=60, seed=2):
    random.seed(seed)
    bag = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "theta", "iota9", "kappa"]
    base = [" ".join(random.choice(bag) for _ in range(random.randint(1, 60))) for _ in range(n // 3)]
    rows = []
    for k in range(n):
        text = random.choice(base)
        kind = k % 5
        if kind == 1:
            text = text.replace(" ", "\n", 3)
        elif kind == 2:
            w = text.split(" ")
            w[random.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = f"  {text}\t\nA shared line of text\n{random.choice(base)} \n short"
        rows.append((k, text))
    return [*rows, (n, ""), (n + 1, None), (n + 2, " \n\t"), (n + 3, "one two"), (n + 4, "One two!")]


def frame(spark, rows, extra="id long, digest string, hash string, bucket long, node long, n_lines long, kept string"):
    return spark.createDataFrame([(*r, 1, "d", "h", 2, 3, 4, "k") for r in rows], f"doc_id long, text string, {extra}")


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_perfect_hash_is_minimal_and_refuses_foreign_digests():
    rng = np.random.default_rng(1)
    digests = np.unique(rng.integers(0, 256, (3000, 32), np.uint8), axis=0)
    levels, slots = exact_dedup.perfect_hash(digests)
    assert sorted(slots) == list(range(len(digests)))
    assert (exact_dedup.probe(levels, digests) == slots).all()
    foreign = exact_dedup.probe(levels, rng.integers(0, 256, (50, 32), np.uint8))
    assert foreign.max() < len(digests)


def test_exact_dedup(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_BUCKET", 4)
    monkeypatch.setattr(exact_dedup, "ROWS_PER_PART", 3)
    rows = corpus()
    df = exact_dedup.dedup(frame(spark, rows))
    assert got(df, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == exact(rows)
    assert exact_dedup.dedup(frame(spark, rows).limit(0)).collect() == []


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    rows = sorted(map(tuple, exact_dedup.dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()), key=repr)
    assert rows == [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)]


def test_exact_dedup_against_history(spark):
    old = exact_dedup.digest_rows(spark.createDataFrame([(1, "a b"), (2, "c"), (3, "c")], "doc_id long, text string"))
    index = exact_dedup.build_index(exact_dedup.summaries(old))
    new = spark.createDataFrame([(10, "ab"), (11, "new"), (12, "n ew"), (13, "c")], "doc_id long, text string")
    rows = got(exact_dedup.dedup(new, index), "doc_id", "keep_id", "group_size", "kept", "historical")
    assert rows == [(10, 1, 1, False, True), (11, 12, 2, False, False), (12, 12, 2, True, False), (13, 2, 2, False, True)]


def test_line_dedup(spark):
    rows = corpus()
    df = line_dedup.dedup_lines(frame(spark, rows), batches=5)  # enough for a compaction
    assert got(df, "doc_id", "n_lines", "n_dropped", "text") == lines(rows)
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).collect() == []


def test_line_runs_compact_and_continue(spark):
    runs = line_dedup.Runs(spark, fanout=2)
    first = spark.createDataFrame([(1, "a line of some length"), (2, "another line here")], "doc_id long, text string")
    later = spark.createDataFrame([(5, "A line of some length\nfresh line of text"), (6, "fresh line of text\nxyz"), (None, "fresh line of text")], "doc_id long, text string")
    line_dedup.dedup_lines(first, runs=runs, batches=1)
    rows = sorted(map(tuple, line_dedup.dedup_lines(later, runs=runs, batches=1).select("doc_id", "n_dropped", "text").collect()), key=repr)
    assert rows == [(5, 1, "fresh line of text"), (6, 1, "xyz"), (None, 0, "fresh line of text")]
    assert [len(level) for level in runs.levels] == [0, 1]
    runs.close()


def test_near_duplicates(spark):
    rows = corpus(90, 4)
    columns = ("doc_id", "copy_of", "n_copies", "class_id", "n_links")
    assert got(near_dup.near_duplicates(frame(spark, rows)), *columns) == near(rows)
    assert got(near_dup.near_duplicates(frame(spark, rows), block_shingles=60), *columns) == near(rows)  # several blocks a component
    assert near_dup.near_duplicates(frame(spark, rows).limit(0)).collect() == []


def test_near_duplicates_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + " more"), (None, text)], "doc_id long, text string")
    rows = sorted(map(tuple, near_dup.near_duplicates(docs).collect()), key=repr)
    assert rows == [(1, 1, 2, 1, 1), (1, 1, 2, 1, 1), (2, 2, 1, 1, 1), (None, None, 1, None, 0)]


def labelled(seed, n):
    """(node, labels) of sets in families: a hot one of close sets, small looser ones, and sets on their own."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        family, share = (0, 0.99) if k < n // 3 else (1 + k % 9, 0.8) if k < 2 * n // 3 else (10 + k, 1.0)
        drawn = np.random.default_rng([seed, family]).integers(0, 256, near_dup.TREES * near_dup.DEPTH)
        own = np.where(rng.random(len(drawn)) < share, drawn, rng.integers(0, 256, len(drawn))).astype(np.uint8)
        out.append((k, own.reshape(near_dup.TREES, near_dup.DEPTH).view(">u8").reshape(-1).astype(np.int64).tolist()))
    return out


def common(a, b):
    """Leading bytes that two labels share."""
    return next((k for k in range(near_dup.DEPTH) if (a ^ b) >> 8 * (near_dup.DEPTH - 1 - k) & 255), near_dup.DEPTH)


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("floor,parts,batch", [(7, 5, 10_000), (5, 40, 3), (7, 3, 1)])
def test_forest_opens_the_nodes_that_sets_come_down_to(spark, floor, parts, batch):
    rows = labelled(7, 60)
    sets = spark.createDataFrame(rows, "node long, labels array<long>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        walked = stage(near_dup.company(sets, floor))
        prefixes = stage(near_dup.own_prefixes(walked, 0.8, floor, near_dup.RECALL))
        own = {r.node: r.prefix for r in prefixes.collect()}
        links = [tuple(r) for r in near_dup.candidate_links(walked, prefixes, floor).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    wanted = []
    for a, of_a in rows:
        for b, of_b in rows[:a]:
            deepest = max(map(common, of_a, of_b))
            if deepest >= floor:
                assert a in own and b in own
                if deepest >= min(own[a], own[b]):
                    wanted.append((b, a))
    assert groups(links, own) == groups(wanted, own)
    assert len(links) <= len(rows) * near_dup.TREES * (near_dup.DEPTH - floor + 1)


def test_prefixes_adapt_to_the_company_of_a_set(spark):
    rows = labelled(11, 90)
    sets = spark.createDataFrame(rows, "node long, labels array<long>")
    walked = stage(near_dup.company(sets, 7))
    own = {r.node: r.prefix for r in near_dup.own_prefixes(walked, 0.8, 7, near_dup.RECALL).collect()}
    assert {own[k] for k in range(30)} == {near_dup.DEPTH}  # among close ones: full length
    assert {own[k] for k in range(60, 90) if k in own} <= {7}  # on their own: down to the floor


def test_prefix_length_reaches_the_recall():
    n = near_dup.prefix_length(0.8)
    assert 1 - (1 - 0.8**n) ** near_dup.TREES >= near_dup.RECALL
    assert near_dup.prefix_length(0.1) == 1
