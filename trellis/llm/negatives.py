"""Hard-negative mining: exact searches by inner product in cover trees, anchors against all rows in blocks.

Rows are dealt into shards of at most ``SHARD`` rows, each with a cover tree of its own (``cover_tree.py``), and the
anchors into blocks of at most ``ANCHORS``.  A task holds one block and one shard, so it is as large as these two
whatever the table's size, and no key gathers more.  Two passes::

    positives   of every (block, shard) the best rows of the anchors' own labels; the best of all shards per anchor
    negatives   with the positives' scores as windows, the best rows of other labels inside each window; then the
                best of all shards per (anchor, positive)

What a pass returns is at most the wanted number of rows per anchor, window and shard.  A block meets every shard
(a stated set of queries against all rows), a shard's tree skips what its bounds rule out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm import cover_tree
from trellis.llm.shipping import ship
from trellis.llm.vectors import chunked, matrix, scaled, usable
from trellis.session import stage

SCALE, LIMIT = 256, 1 << 30
#: Rows of a shard, and anchors of a block.
SHARD, ANCHORS = 4096, 1024
POSITIVES, NEGATIVES = 5, 3
#: Scores of negatives, in hundredths of the positive's.
WINDOW = (50, 95)
NONE = np.iinfo(np.int64).min


def _parts(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


def _packed_shards(rows: DataFrame, width: int, size: int) -> tuple[DataFrame, int]:
    """(part, tree): rows with their trees, ids, labels and numbers; and how many parts there are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunked(batches, size + size // 4):  # parts differ by a few rows
            tree = cover_tree.build(matrix(table["v"], width, np.int32))
            own = [table[name].to_numpy()[tree.order] for name in ("id", "label", "at")]
            held = pickle.dumps((tree, *own), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held], pa.binary())], names=["part", "tree"])

    parts = _parts(rows, size)
    return stage(rows.repartition(parts).mapInArrow(pack, "part int, tree binary")), parts


def _packed_blocks(anchors: DataFrame, width: int, size: int) -> tuple[DataFrame, int]:
    """(block, anchors): ids, labels, numbers, vectors and, if there are any, the scores of the positives; and how many blocks there are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunked(batches, size + size // 4):
            numbers = [table[name].to_numpy() for name in ("id", "label", "at")]
            positives = None
            if "scores" in table.column_names:
                lists = table["scores"].to_pylist()
                positives = np.full((len(lists), max(map(len, lists))), NONE)
                for k, own in enumerate(lists):
                    positives[k, : len(own)] = own
            held = pickle.dumps((*numbers, matrix(table["v"], width, np.int32), positives), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held], pa.binary())], names=["block", "anchors"])

    parts = _parts(anchors, size)
    return stage(anchors.repartition(parts).mapInArrow(pack, "block int, anchors binary")), parts


def _met(blocks: DataFrame, n_blocks: int, shards: DataFrame, n_shards: int) -> DataFrame:
    """(anchors, tree) of every block and part, each pair under a key of its own."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = blocks.select("block", "anchors", every(n_shards).alias("part"))
    return asked.join(shards.select("part", "tree", every(n_blocks).alias("block")).hint("merge"), ["block", "part"])


def _windows(positives: np.ndarray, window: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest integer score with low * p <= 100 * s <= high * p; an empty range without a positive."""
    there = positives != NONE
    p = np.where(there, positives, 0)
    low, high = -((-window[0] * p) // 100), (window[1] * p) // 100
    return np.where(there, low, 1), np.where(there, high, 0)


def _search(met: DataFrame, k: int, window: tuple[int, int] | None) -> DataFrame:
    """(anchor_at, anchor_id, slot, score, id, at): at most ``k`` rows per slot of every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, held in zip(batch.column("anchors"), batch.column("tree")):
                anchor_ids, anchor_labels, anchor_at, vectors, positives = pickle.loads(packed.as_py())
                tree, ids, labels, at = pickle.loads(held.as_py())
                if window is None:
                    low = np.full((len(vectors), 1), NONE)
                    high = np.full((len(vectors), 1), np.iinfo(np.int64).max)
                    accept = lambda q, p: (anchor_labels[q][:, None] == labels[p]) & (anchor_at[q][:, None] != at[p])  # noqa: E731, B023
                else:
                    low, high = _windows(positives, window)
                    accept = lambda q, p: anchor_labels[q][:, None] != labels[p]  # noqa: E731, B023
                (slots, scores, found, places), _ = cover_tree.search(tree, vectors, low, high, accept, ids, k)
                q, w = np.divmod(slots, low.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, (anchor_at[q], anchor_ids[q], w.astype(np.int32), scores, found, at[places]))],
                    names=["anchor_at", "anchor_id", "slot", "score", "id", "at"],
                )

    return met.select("anchors", "tree").mapInArrow(run, "anchor_at long, anchor_id long, slot int, score long, id long, at long")


def hard_negatives(
    vectors: DataFrame, *, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW, scale: int = SCALE, shard: int = SHARD, block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; its positives are the best ``positives`` other rows of
    its label, and for each of them come the best ``negatives`` rows of other labels whose score is within ``window``
    hundredths of the positive's.  Scores are integer inner products of floor(scale * x); higher ones come first,
    ties by smaller id.  Rows without id or label, without a vector or with a null or not finite component take no
    part.  Vectors of other lengths count as filled up with zeros.  Rows that repeat an id are rows of their own: each
    may be an anchor, a positive or a negative.  A component of ``LIMIT`` or more, or a score of ``cover_tree.LARGEST``, is an
    error.  Other columns are ignored; an empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    named = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("v"))
    whole = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    rows = stage(whole.select("id", "label", scaled("v", scale, LIMIT).alias("v"), F.monotonically_increasing_id().alias("at")))
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    trees = _packed_shards(rows, width, shard)
    anchors = rows.where(F.col("id") % every == 0)

    def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "at")  # a key has k rows a shard
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = stage(best(_search(_met(*_packed_blocks(anchors, width, block), *trees), positives, None), ["anchor_at"], positives))
    scores = near.groupBy(F.col("anchor_at").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    asked = _packed_blocks(stage(anchors.join(scores, "at")), width, block)
    far = best(_search(_met(*asked, *trees), negatives, window), ["anchor_at", "slot"], negatives)
    paired = far.select("anchor_at", (F.col("slot") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        near.select("anchor_at", F.col("rank").alias("place"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_at", "place"]
    )
    return paired.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
