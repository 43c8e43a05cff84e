"""Near-duplicate join: MinHash LSH forest over word shingles, verified exactly.

Sketch.  A text is its set of 5-word shingles (64-bit hashes).  Texts of one set are copies: they share a class and
are joined once.  Each of ``TREES`` trees labels a set with ``DEPTH`` one-byte MinHash values, most significant
first, in one 64-bit number: sorted labels are a prefix trie, and a shorter prefix is a shift.

Candidates.  Each tree's labels are sorted (range-partitioned by tree, label and set, so that a prefix shared by a third
of all sets is split over tasks), and one pass along them compares every label with its neighbours: that is how deep
a set has company in the trie.  Every set starts at full length and shortens its prefix byte by byte until its own estimated
recall reaches the target (``own_prefixes``): over the partners that it met, at the similarity that the share of
trees with company tells, and one unmet partner at the threshold.  Sets among many close ones keep long prefixes, lonely ones
go down to ``prefix_length``, where even a pair at the threshold meets with the target recall.  A trie node is opened if a
set below it came down to its depth; all sets below an open node are candidates of each other.  It links its members to
its smallest one, so it gives as many rows as it has members, and chains of nodes give candidate components.

Verification.  All pairs of a candidate component are compared exactly, inside tasks: intersections are counted
through posting lists, and a task returns one row per set (number of links, smallest set it hangs together
with), never a row per pair.  Small components share a task; a large one is dealt into blocks and each pair of blocks
is a task, so no task holds more than two blocks, however many sets hang together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.decontamination import word_chunks
from trellis.llm.memory import held
from trellis.llm.shipping import ship
from trellis.operators.levels import connected_components
from trellis.session import stage

WIDTH = 5
#: Similarity from which two texts are linked, as a fraction.
THRESHOLD = (4, 5)
TREES, DEPTH, RECALL = 32, 8, 0.999
#: Shingles of the sets that one block of a verification task holds.
BLOCK_SHINGLES = 250_000
REMEMBERED_WORDS = 300_000


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix at which a pair at the threshold meets in some tree with the wanted probability: no set goes below it."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_TREE_MIX = np.random.default_rng(20240501).integers(1, 2**63, (2, TREES * DEPTH), dtype=np.uint64) | np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` are one shingle, no words are none."""
    hashes = held(("word hashes",), _WordHashes)
    words = [np.fromiter(map(hashes.__getitem__, chunk), np.uint64, len(chunk)) for chunk in word_chunks(text)]
    w = np.concatenate(words)
    width = min(width, len(w))
    if not width:
        return w
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def labels(hashes: np.ndarray) -> np.ndarray:
    """One label per tree: DEPTH bytes of MinHash values."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        mixed = hashes[at : at + 256, None] * _TREE_MIX[0]
        mixed += _TREE_MIX[1]
        np.minimum(least, mixed.min(axis=0), out=least)
    low = ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8)
    return low.reshape(TREES, DEPTH).view(">u8").reshape(TREES).astype(np.int64)


def sketches(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, digest of the shingle set, number of shingles, labels) of every row; nulls without an id or a word."""
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, marks = [], [], []
            for key, value in zip(*batch.columns):
                found = shingles(value.as_py() or "") if key.is_valid else ()
                digests.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
                sizes.append(len(found))
                marks.append(labels(found) if len(found) else None)
            made = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "digest", "size", "labels"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, digest binary, size long, labels array<long>")


def company(sets: DataFrame, floor: int) -> DataFrame:
    """(tree, label, node, depth, before, prior, after, next): labels that share ``floor`` bytes with a neighbour in sorted order.

    ``before`` and ``after`` count the bytes shared with the neighbours ``prior`` and ``next``, depth is the larger one.  First and last
    labels of a partition, whose neighbours lie elsewhere, are always kept and may share up to DEPTH bytes.
    """
    placed = sets.select("node", F.posexplode("labels").alias("tree", "label")).select(F.col("tree").cast("byte").alias("tree"), "label", "node")
    ordered = placed.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")

    def walked(tree: np.ndarray, label: np.ndarray, node: np.ndarray, begin: int, end: int, edges: list[int]) -> pa.RecordBatch:
        differing = (label[1:] ^ label[:-1]).view(np.uint64)
        shared = np.zeros(len(differing), np.int8)
        for depth in range(1, DEPTH + 1):
            shared += differing >> np.uint64(8 * (DEPTH - depth)) == 0
        shared[tree[1:] != tree[:-1]] = 0
        before, after = np.concatenate([[0], shared]), np.concatenate([shared, [0]])
        depth = np.maximum(before, after)
        depth[edges] = DEPTH
        rows = begin + np.flatnonzero(depth[begin:end] >= floor)
        columns = (tree, label, node, depth, before, np.roll(node, 1), after, np.roll(node, -1))
        names = ["tree", "label", "node", "depth", "before", "prior", "after", "next"]
        kinds = [np.int8 if name in ("tree", "depth", "before", "after") else np.int64 for name in names]
        return pa.RecordBatch.from_arrays([pa.array(c[rows].astype(kind)) for c, kind in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last label, which waits for its successor, and the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
            begin = 0 if kept is None else len(kept[0]) - 1
            first = kept is None or begin == 0
            rows = new if kept is None else [np.concatenate(pair) for pair in zip(kept, new)]
            if len(rows[0]) > 1:
                yield walked(*rows, begin, len(rows[0]) - 1, [0] if first else [])
            kept = [column[-2:] for column in rows]
        if kept is not None:
            n = len(kept[0])
            yield walked(*kept, n - 1, n, [n - 1])

    return ordered.mapInArrow(run, "tree byte, label long, node long, depth byte, before byte, prior long, after byte, next long")


def own_prefixes(walked: DataFrame, threshold: float, floor: int, recall: float) -> DataFrame:
    """(node, prefix): the longest prefix at which a set's estimated recall reaches the target, ``floor`` at the least.

    With n different partners next to it at a length, met in m of the TREES trees, they are met again with a probability of
    1 - (1 - m / TREES)^TREES each; one more partner at the threshold may be unmet.  The estimate is the mean over all n + 1.
    """
    longer = range(DEPTH, floor, -1)
    met = [F.sum((F.greatest("before", "after") >= p).cast("int")).alias(f"m{p}") for p in longer]
    partners = [F.size(F.array_union(F.collect_set(F.when(F.col("before") >= p, F.col("prior"))), F.collect_set(F.when(F.col("after") >= p, F.col("next"))))).alias(f"n{p}") for p in longer]
    reached = [
        F.when(
            F.col(f"n{p}") * (1 - F.pow(1 - F.col(f"m{p}") / TREES, F.lit(TREES))) + (1 - (1 - threshold**p) ** TREES) >= recall * (F.col(f"n{p}") + 1),
            F.lit(p),
        )
        for p in longer
    ]
    return walked.groupBy("node").agg(F.count(F.lit(1)).alias("trees"), *met, *partners).select("node", F.coalesce(*reached, F.lit(floor)).alias("prefix"))


def candidate_links(walked: DataFrame, prefixes: DataFrame, floor: int) -> DataFrame:
    """(a, b): every set below an open trie node, with the node's smallest set."""
    below = walked.join(prefixes, "node").select("tree", "label", "node", "prefix", F.explode(F.sequence(F.lit(floor), F.col("depth").cast("int"))).alias("length"))
    below = below.withColumn("start", F.expr(f"shiftrightunsigned(label, 8 * ({DEPTH} - length))")).drop("label")
    key = ["tree", "length", "start"]
    opened = below.groupBy(*key).agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n"), F.min("prefix").alias("least")).where("n > 1 AND least <= length")
    return below.join(opened.select(*key, "a"), key).where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct()


def compare(sets: list[np.ndarray], side: np.ndarray | None, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set and the smallest index it hangs together with; with ``side`` only pairs across sides count."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, inverse, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    first = np.concatenate([[0], np.cumsum(held)])
    postings = owner[np.argsort(inverse, kind="stable")]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    up, down = threshold
    counts, left, right = np.zeros(n, np.int64), [], []
    for k in range(n):
        own = inverse[begins[k] : begins[k + 1]]
        own = own[held[own] > 1]
        lengths = held[own]
        total = int(lengths.sum())
        if not total:
            continue
        at = np.repeat(first[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        common = np.bincount(postings[at], minlength=n)
        union = sizes[k] + sizes - common
        linked = common * down >= union * up
        linked[: k + 1] = False
        if side is not None:
            linked &= side != side[k]
        others = np.flatnonzero(linked)
        counts[k] += len(others)
        counts[others] += 1
        left.append(np.full(len(others), k))
        right.append(others)
    roots = np.arange(n)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            before = roots.copy()
            low = np.minimum(roots[a], roots[b])
            np.minimum.at(roots, a, low)
            np.minimum.at(roots, b, low)
            roots = roots[roots]
            if (roots == before).all():
                break
    return counts, roots


def _verify(docs: DataFrame, members: DataFrame, threshold: tuple[int, int], block_shingles: int) -> DataFrame:
    """(node, links, root, split) for each member of a candidate component, once per task that it is in."""
    sizes = members.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / block_shingles)).alias("blocks"))
    lumps = max(1, -(-(members.agg(F.sum("size")).first()[0] or 0) // block_shingles))
    dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    one = F.array(F.struct(F.pmod(F.xxhash64("component"), F.lit(lumps)).alias("c"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")))
    many = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda y: F.struct(F.col("component").alias("c"), F.least("block", y).alias("i"), F.greatest("block", y).alias("j")),
    )
    dealt = dealt.select("node", "id", "digest", "component", "block", F.when(F.col("blocks") == 1, one).otherwise(many).alias("tasks"))
    texts = docs.join(dealt.hint("merge"), "id")  # the members grow with the corpus: texts are shuffled at any size
    names = ["node", "component", "block", "tasks"]

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets = [], []
            for k, (value, digest) in enumerate(zip(batch.column("text"), batch.column("digest"))):
                found = shingles(value.as_py() or "").tobytes()
                if hashlib.md5(found).digest() == digest.as_py():  # ids may repeat with other texts
                    rows.append(k)
                    sets.append(found)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in names), pa.array(sets, pa.binary())], names=[*names, "shingles"])

    def check(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        _, keep = np.unique(nodes, return_index=True)
        table = table.take(pa.array(keep))
        nodes, components, blocks = (table[n].to_numpy() for n in ("node", "component", "block"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        out = [[], [], []]
        for component in np.unique(components):
            rows = np.flatnonzero(components == component)
            sets = [np.frombuffer(table["shingles"][int(r)].as_py(), np.uint64) for r in rows]
            counts, roots = compare(sets, blocks[rows] if i != j else None, threshold)
            for column, values in zip(out, (nodes[rows], counts, nodes[rows][roots])):
                column.append(values)
        columns = [np.concatenate(c) for c in out]
        return pa.table([*map(pa.array, columns), pa.array([i >= 0] * len(columns[0]))], names=["node", "links", "root", "split"])

    tasks = "array<struct<c: long, i: long, j: long>>"
    rows = texts.select("text", "digest", *names).mapInArrow(shingled, f"node long, component long, block long, tasks {tasks}, shingles binary")
    spread = rows.select("node", "component", "block", "shingles", F.inline("tasks"))
    return spread.groupBy("c", "i", "j").applyInArrow(check, "node long, links long, root long, split boolean")


def near_duplicates(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, copy_of, n_copies, class_id, n_links.

    ``copy_of`` is the smallest id with the same shingle set and n_copies the number of rows that have it; n_links
    counts the other sets within the threshold; class_id is the smallest id that links lead to (its own without any).
    Rows without words (null and empty texts) and rows without an id are copies of nothing, have no links and are
    classes of their own.  Rows that repeat an id count as copies where their sets agree.  Other columns are ignored;
    an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    drawn = stage(sketches(docs, text, doc_id))
    grouped = drawn.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("labels").alias("labels")
    )
    sets = stage(grouped.withColumn("node", F.monotonically_increasing_id()))
    similarity = threshold[0] / threshold[1]
    floor = prefix_length(similarity, recall=recall)
    walked = stage(company(sets, floor))
    prefixes = stage(own_prefixes(walked, similarity, floor, recall))
    links = stage(candidate_links(walked, prefixes, floor))
    components = _components(links)
    members = stage(sets.select("node", "id", "digest", "size").join(components, "node"))
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    verified = stage(_verify(texts, members, threshold, block_shingles))
    across = _components(verified.where("split AND node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = verified.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    headed = counted.join(across, "node", "left").select("node", "n_links", F.coalesce("component", "root").alias("head"))
    named = stage(sets.select("node", "digest", "id", "n_copies").join(headed, "node", "left"))
    heads = named.where("n_links > 0").groupBy("head").agg(F.min("id").alias("class_id"))
    classes = named.join(heads, "head", "left").select(
        "digest", F.col("id").alias("copy_of"), "n_copies", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return drawn.select("id", "digest").join(classes, "digest", "left").select(
        F.col("id").alias(doc_id), F.coalesce("copy_of", "id").alias("copy_of"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _components(links: DataFrame) -> DataFrame:
    """(node, component) of every end of the links (a, b)."""
    ends = links.select(F.col("a").alias("code")).unionByName(links.select(F.col("b").alias("code")))
    return connected_components(ends, links).select(F.col("code").alias("node"), "component")
