"""Staging of intermediate tables: how loops cut their lineage.

Every iterative operator writes what it has found so far as Parquet below the cluster's shared
checkpoint folder and reads it back.  A lost executor then costs one round, not the whole history,
and the next round is planned from real file sizes.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=None)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session (tests, notebooks) may leave it unset; there a private temporary
    folder is used.  On a cluster a machine-local folder would be unreadable for other executors,
    so an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return "file://" + _local_folder()


class Staged:
    """An append-only table of rounds below the staging root."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{staging_root(spark)}/trellis-{uuid.uuid4().hex}"
        self.schema = None
        self.paths: list[str] = []

    def append(self, df: DataFrame, *metrics) -> dict:
        """Write one round; returns its row count and any further observed metrics."""
        self.schema = self.schema or df.schema
        path = f"{self.base}/round-{len(self.paths):05d}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics).write.mode("overwrite").parquet(path)
        self.paths.append(path)
        return seen.get

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def last(self) -> DataFrame:
        return self._read(self.paths[-1:])

    def all(self) -> DataFrame:
        return self._read(self.paths)


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once and continue from the written table."""
    store = Staged(df.sparkSession)
    store.append(df)
    return store.last()


class Bucketed:
    """An append-only table of rounds that stays dealt out by ``keys``.

    Every round is written as one file per bucket below a folder of its own.  Joins and groupings on ``keys`` read
    all rounds bucket by bucket, without shuffling them; a round can also be read by itself.  The files of a bucket
    are put together again after ``FILES`` rounds, or earlier while they are so small (``SMALL_ROWS`` in all) that
    opening them takes longer.

    There are as many buckets as shuffle partitions, or, for a table that begins with :meth:`start`, as its rows need:
    a bucket for every ``BUCKET_ROWS``, one per core at least.  A round of a loop costs a task and a file per bucket
    however few rows it finds, so buckets that hold little make every round dearer.
    """

    FILES, FEW_FILES, SMALL_ROWS = 64, 6, 1_000_000
    BUCKET_ROWS = 100_000

    def __init__(self, spark: SparkSession, keys: list[str]):
        self.spark, self.keys, self.schema, self.rounds, self.rows = spark, keys, None, 0, 0
        self.buckets, self.sized = int(spark.conf.get("spark.sql.shuffle.partitions")), False
        self._new_table()

    def _new_table(self) -> None:
        self.name = f"trellis_{uuid.uuid4().hex}"
        self.base = f"{staging_root(self.spark)}/{self.name}"
        self.files = 0

    def _fitting(self, rows: int) -> int:
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return min(most, max(self.spark.sparkContext.defaultParallelism, -(-rows // self.BUCKET_ROWS)))

    def start(self, df: DataFrame) -> int:
        """Write the first round into as many buckets as its rows need; returns its row count."""
        plain = Staged(self.spark)
        self.buckets, self.sized = self._fitting(plain.append(df)["rows"]), True
        return self.append(self.dealt(plain.last()))["rows"]

    def dealt(self, df: DataFrame) -> DataFrame:
        """``df`` dealt out the same way."""
        return df.repartition(self.buckets, *self.keys)

    def _write(self, df: DataFrame) -> None:
        writer = df.write.mode("append").partitionBy("_round").bucketBy(self.buckets, *self.keys)
        writer.option("path", self.base).saveAsTable(self.name)
        self.files += 1

    def append(self, df: DataFrame, *metrics) -> dict:
        """Write one round of rows that are dealt out already; returns its row count and further observed metrics."""
        self.schema = self.schema or df.schema
        seen = Observation()
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics)
        self._write(observed.select(*(F.col(f"`{f.name}`") for f in self.schema), F.lit(self.rounds).alias("_round")))
        self.rounds += 1
        self.rows += seen.get["rows"]
        outgrown = self.sized and self._fitting(self.rows) > 4 * self.buckets
        if outgrown or self.files >= (self.FEW_FILES if self.rows < self.SMALL_ROWS else self.FILES):
            self._compact()
        return seen.get

    def _compact(self) -> None:
        """The last round stays by itself; the number of buckets follows the rows."""
        older = F.when(F.col("_round") < self.rounds - 1, 0).otherwise(F.col("_round"))
        old, name = self._read().withColumn("_round", older), self.name
        if self.sized:
            self.buckets = self._fitting(self.rows)
        self._new_table()
        self._write(self.dealt(old))
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _read(self) -> DataFrame:
        return self.spark.table(self.name)

    def last(self) -> DataFrame:
        return self._read().where(F.col("_round") == self.rounds - 1).drop("_round")

    def all(self) -> DataFrame:
        return self._read().drop("_round")

    def rounded(self) -> DataFrame:
        """All rows with the number of their round."""
        return self._read()

    def close(self) -> DataFrame:
        """All rows as plain files, of any number of tasks; the table's name leaves the catalog."""
        plain = self.spark.read.schema(self._read().schema).parquet(self.base).drop("_round")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return plain


def grow(seed: DataFrame, keys: list[str], step, max_rounds: int | None = None) -> DataFrame:
    """Semi-naive fixpoint.

    ``step(frontier, round)`` derives candidate rows from the rows found in the round before; rows
    whose ``keys`` are already known are dropped, and the loop ends when a round finds nothing new.
    The known rows stay in buckets of their keys: a round shuffles its candidates once, one row per
    key, and meets the known ones where they lie.
    """
    store = Bucketed(seed.sparkSession, keys)
    found = store.start(seed)
    rounds = 0
    while found and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        found = store.append(fresh_rows(store, step(store.last(), rounds)))["rows"]
    return store.close()


def fresh_rows(store: Bucketed, candidates: DataFrame) -> DataFrame:
    """One candidate row for each key that ``store`` does not have yet."""
    picked = candidates.select(*(F.col(f.name) for f in store.schema))
    rest = [c for c in picked.columns if c not in store.keys]
    distinct = store.dealt(picked).groupBy(*store.keys).agg(*(F.first(c).alias(c) for c in rest)) if rest else store.dealt(picked.distinct()).distinct()
    return distinct.join(store.all().select(*store.keys).hint("merge"), store.keys, "left_anti")


def countdown(links: DataFrame, node: list[str], arrived: DataFrame | None, settled: DataFrame, settle, unblock=None) -> DataFrame:
    """Settle nodes once everything that they wait for is settled (Kahn's method), and return ``(node..., values...)``.

    ``links(f_<node>..., t_<node>..., of, payload...)`` says that the node f is one of the ``of`` things that the node
    t waits for.  ``settled`` are the nodes known from the start with their values; ``arrived(t_<node>..., of,
    payload..., values...)`` are things that count as settled without being nodes.  ``settle(rows)`` gives
    ``(node..., values...)`` of nodes from all their rows, which then have the payload and the values of what they
    waited for; it must not need another shuffle than by t.

    What has arrived at a node stays in the buckets of the node.  A round sends the values of the nodes settled last
    along their links (stored by f), which is its only shuffle, and settles the nodes whose last open link that was.
    ``unblock(waiting)`` is asked when nothing moves: it gets the links whose both ends are open and may return nodes
    to be settled with their values, or None; links between two of them are never sent.
    """
    spark = links.sparkSession
    source, target = [f"f_{c}" for c in node], [f"t_{c}" for c in node]
    values = [c for c in settled.columns if c not in node]
    payload = [c for c in links.columns if c not in (*source, *target, "of")]
    roads = Bucketed(spark, source)
    roads.start(links)
    stock = Bucketed(spark, target)
    stock.buckets = roads.buckets  # what is settled in a bucket meets its links without a shuffle
    columns = [*source, *target, "of", "linked", *payload, *values]

    def send(nodes: DataFrame, roads: DataFrame) -> DataFrame:
        """Every node with its values, once per link, or once without any."""
        marked = roads.withColumn("linked", F.lit(True))
        named = nodes.select(*(F.col(c).alias(f) for c, f in zip(node, source)), *values)
        met = named.hint("shuffle_hash").join(marked, source, "left")
        own = {t: F.coalesce(t, f) for f, t in zip(source, target)}
        return met.withColumns(own | {"linked": F.coalesce("linked", F.lit(False))}).select(*columns)

    first = send(settled, roads.all())
    if arrived is not None:
        first = first.unionByName(arrived.withColumn("linked", F.lit(True)), allowMissingColumns=True).select(*columns)
    moved = stock.append(stock.dealt(first))["rows"]
    blocked = True
    while moved or blocked:
        if not moved:
            blocked = False
            done = stock.all().where(F.col(source[0]).isNotNull()).select(*source).distinct()
            nodes = unblock(_between(roads.all(), done, source, target)) if unblock else None
            if nodes is None:
                break
            both = nodes.select(*(F.col(c).alias(t) for c, t in zip(node, target))).withColumn("_too", F.lit(True))
            tied = roads.all().join(nodes.select(*(F.col(c).alias(f) for c, f in zip(node, source))), source, "left_semi")
            outward = tied.join(both, target, "left_anti").select(*links.columns)
            moved = stock.append(stock.dealt(send(nodes, outward)))["rows"]
            continue
        here = stock.rounded().where("linked")
        counts = here.groupBy(*target, "of").agg(F.count(F.lit(1)).alias("n"), F.max("_round").alias("_round"))
        ready = counts.where((F.col("n") == F.col("of")) & (F.col("_round") == stock.rounds - 1)).select(*target)
        near = here.join(ready.hint("shuffle_hash"), target, "left_semi")
        fresh = settle(near.select(*(F.col(t).alias(c) for c, t in zip(node, target)), *payload, *values))
        moved = stock.append(stock.dealt(send(fresh.select(*node, *values), roads.all())))["rows"]
    roads.close()
    known = stock.close().where(F.col(source[0]).isNotNull())
    return known.select(*(F.col(f).alias(c) for c, f in zip(node, source)), *values).distinct()


def _between(links: DataFrame, done: DataFrame, source: list[str], target: list[str]) -> DataFrame:
    """Links whose both ends are not done."""
    left = links.join(done, source, "left_anti")
    return left.join(done.select(*(F.col(f).alias(t) for f, t in zip(source, target))), target, "left_anti")
