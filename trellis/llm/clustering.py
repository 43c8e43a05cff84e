"""Lloyd's algorithm with the dimensions dealt out over shards.

The integer vectors are written once as chunks of rows, each cut into column blocks: a table of (chunk, block,
matrix), bucketed by (chunk, block).  A centroid is cut the same way; block b's slices of all centroids are one row
of a small table.  A round::

    partial   every (chunk, block) task gives the exact squared distances of its columns to its centroid slices
    reduce    the blocks' distances of a chunk are added by key, and the least total decides (ties: smaller number)
    update    the labels go back to the chunk's blocks; every block adds up its own columns by label, and gets its
              own slices of the next centroids as exact floors of sum / count

Only distances (rows x centroids) and labels are shuffled, never the vectors: the labels meet the blocks bucket by
bucket.  Sums combine in the tasks and again before their shuffle, so a cluster that holds a third of all rows is one
row per task.  Every round's centroids are written to the shared folder; a lost executor costs part of a round.  The
slices are broadcast, and their size is checked against ``CENTROID_BYTES``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.shipping import ship
from trellis.llm.vectors import chunked, matrix, scaled, usable
from trellis.session import stage, staging_root

CLUSTERS, ROUNDS, SEED, SCALE, DIMENSIONS = 8, 10, 3, 1024, 64
#: Columns of a block, and rows of a chunk.
BLOCK, CHUNK = 16, 2048
#: Largest centroid table that is broadcast: clusters x dimensions x 8 bytes.
CENTROID_BYTES = 64 << 20
#: Integer components are below this, so that a squared distance in up to 256 dimensions fits into a long.
LIMIT = 1 << 26


def _blocks(vectors: DataFrame, dimensions: int, block: int, chunk: int) -> tuple[DataFrame, DataFrame, str]:
    """(ids(chunk, at, id), blocks(chunk, block, data)), the latter bucketed by (chunk, block); its table's name."""
    spark = vectors.sparkSession
    shards = -(-dimensions // block)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for seq, table in enumerate(chunked(batches, chunk)):
            data, number = matrix(table["v"], dimensions, np.int32), (task << 32) + seq
            for b in range(shards):
                ids = table["id"].combine_chunks() if b == 0 else table["id"].combine_chunks().slice(0, 0)
                packed = np.ascontiguousarray(data[:, b * block : (b + 1) * block]).tobytes()
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([b], pa.int32()), listed, pa.array([packed], pa.binary())], names=["chunk", "block", "ids", "data"])

    kind = vectors.schema["id"].dataType.simpleString()
    cuts = stage(vectors.mapInArrow(cut, f"chunk long, block int, ids array<{kind}>, data binary"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"column_blocks_{uuid.uuid4().hex}"
    dealt = cuts.select("chunk", "block", "data").repartition(buckets, "chunk", "block")
    dealt.write.bucketBy(buckets, "chunk", "block").sortBy("chunk", "block").option("path", f"{staging_root(spark)}/{name}").saveAsTable(name)
    ids = cuts.where("block = 0").select("chunk", F.posexplode("ids").alias("at", "id"))
    return ids, spark.table(name), name


def partial_distances(data: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every slice, in exact integers."""
    out = np.empty((len(data), len(slices)), np.int64)
    for k, c in enumerate(slices):
        gap = data - c
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def _assigned(blocks: DataFrame, slices: DataFrame, width: int) -> DataFrame:
    """(chunk, labels, distances) of every chunk, packed."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for packed, own in zip(batch.column("data"), batch.column("slices")):
                cut = np.array(own.as_py(), np.int64)
                data = np.frombuffer(packed.as_py(), np.int32).reshape(-1, cut.shape[1]).astype(np.int64)
                sums.append(partial_distances(data, cut).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(sums, pa.binary())], names=["chunk", "part"])

    def reduce(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py(), np.int64) for p in table["part"]).reshape(-1, width)
        labels = total.argmin(axis=1)  # the first of equal ones
        least = total[np.arange(len(total)), labels]
        return pa.table({"chunk": table["chunk"][:1], "labels": pa.array([labels.astype(np.int32).tobytes()], pa.binary()), "distances": pa.array([least.tobytes()], pa.binary())})

    met = blocks.join(F.broadcast(slices), "block").select("chunk", "data", "slices")
    parts = met.mapInArrow(partial, "chunk long, part binary")
    return parts.groupBy("chunk").applyInArrow(reduce, "chunk long, labels binary, distances binary")


def _next_slices(blocks: DataFrame, assigned: DataFrame, slices: DataFrame, dimensions: int, block: int) -> DataFrame:
    """The blocks' slices after one update; clusters without rows keep theirs."""
    shards = -(-dimensions // block)
    back = assigned.select("chunk", "labels", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("block"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, packed, marks in zip(batch.column("block").to_pylist(), batch.column("data"), batch.column("labels")):
                labels = np.frombuffer(marks.as_py(), np.int32)
                data = np.frombuffer(packed.as_py(), np.int32).reshape(len(labels), -1).astype(np.int64)
                for k in np.unique(labels):
                    own = data[labels == k]
                    found = np.concatenate([own.sum(axis=0), [len(own)]])
                    sums[b, int(k)] = sums[b, int(k)] + found if (b, int(k)) in sums else found
        rows = [(b, k, at, int(s), int(found[-1])) for (b, k), found in sums.items() for at, s in enumerate(found[:-1])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["block", "cluster", "at", "total", "n"])

    joined = blocks.join(back.hint("merge"), ["chunk", "block"]).select("block", "data", "labels")
    sums = joined.mapInArrow(add, "block long, cluster long, at long, total long, n long")
    sums = sums.groupBy("block", "cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    old = slices.select("block", F.posexplode("slices").alias("cluster", "slice")).select("block", "cluster", F.posexplode("slice").alias("at", "old"))
    floor = F.expr("(total - pmod(total, n)) div n")
    new = old.join(sums, ["block", "cluster", "at"], "left").select("block", "cluster", "at", F.coalesce(floor, "old").alias("value"))
    return _listed(new)


def _listed(values: DataFrame) -> DataFrame:
    """(block, slices) of (block, cluster, at, value)."""
    in_order = lambda rows, *names: F.transform(F.array_sort(F.collect_list(F.struct(*names))), lambda x: x[names[-1]])
    slices = values.groupBy("block", "cluster").agg(in_order(values, "at", "value").alias("slice"))
    return slices.groupBy("block").agg(in_order(slices, "cluster", "slice").alias("slices"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> DataFrame:
    """(cluster, v): the vectors whose ids have the smallest hashes with ``seed``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    least = stage(vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters))
    return least.select((F.row_number().over(Window.orderBy("key", "v")) - 1).alias("cluster"), "v")  # at most ``clusters`` rows


def cluster_vectors(
    vectors: DataFrame, *, vector: str = "embedding", vec_id: str = "vec_id", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE,
    dimensions: int = DIMENSIONS, block: int = BLOCK, chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """``(rows(vec_id, cluster, distance), centroids(cluster, centroid, n, inertia))``.

    Vectors of exactly ``dimensions`` components, none null or not finite, take part, as integers floor(scale * x);
    a component of ``LIMIT`` or more is an error.  Centroids start as the vectors whose ids have the smallest SHA-256
    with ``seed``; of ids that repeat (null ids count as one) the smaller vector comes first.  Of fewer vectors than
    ``clusters`` all are centroids.  Equal distances go to the smaller number, so of equal centroids the later ones
    stay empty, and empty ones keep their place.  Rows that repeat are rows of their own; other columns are ignored;
    an empty table gives empty results.
    """
    spark = vectors.sparkSession
    ship(spark)
    if 8 * clusters * dimensions > CENTROID_BYTES:
        raise ValueError(f"{clusters} centroids of {dimensions} dimensions are more than {CENTROID_BYTES} bytes")
    if dimensions > 256:
        raise ValueError("squared distances in more than 256 dimensions may not fit into a long")
    named = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    kept = stage(named.where((F.size("v") == dimensions) & usable("v")).select("id", scaled("v", scale, LIMIT).alias("v")))
    start = first_centroids(kept, clusters, seed)
    width = start.count()
    values = start.select("cluster", F.posexplode("v").alias("d", "value")).select(
        F.floor(F.col("d") / block).cast("long").alias("block"), F.col("cluster").cast("long").alias("cluster"), (F.col("d") % block).cast("long").alias("at"), "value"
    )
    slices = stage(_listed(values))
    ids, blocks, name = _blocks(kept, dimensions, block, chunk)
    for _ in range(rounds if width else 0):
        slices = stage(_next_slices(blocks, _assigned(blocks, slices, width), slices, dimensions, block))
    last = stage(_assigned(blocks, slices, max(width, 1)))
    spark.sql(f"DROP TABLE IF EXISTS {name}")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, labels, distances in zip(batch.column(0), batch.column(1), batch.column(2)):
                own = np.frombuffer(labels.as_py(), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), number.as_py())), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own), pa.array(np.frombuffer(distances.as_py(), np.int64))],
                    names=["chunk", "at", "cluster", "distance"],
                )

    found = last.mapInArrow(unpack, "chunk long, at int, cluster int, distance long")
    rows = stage(ids.join(found, ["chunk", "at"]).select("id", "cluster", "distance"))
    parts = slices.select("block", F.posexplode("slices").alias("cluster", "slice")).groupBy("cluster")
    whole = parts.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "slice"))), lambda x: x["slice"])).alias("centroid"))
    sums = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("inertia"))
    centroids = whole.join(sums, "cluster", "left").select("cluster", "centroid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("inertia", F.lit(0)).alias("inertia"))
    return rows.select(F.col("id").alias(vec_id), "cluster", "distance"), stage(centroids)


def digest(components: str | Column) -> Column:
    """SHA-256 of integers in decimal, joined by commas."""
    return F.sha2(F.array_join(F.transform(components, lambda x: x.cast("string")), ","), 256)
