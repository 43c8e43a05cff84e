"""Line dedup: sorted runs of line hashes in levels, merged with each new batch.

A line's key is the line without white space at both ends and with A-Z lower-cased; the store keeps the 16-byte
MD5 of keys of at least ``MIN_CHARS`` code points with the smallest document id that holds them.  A run is a
table bucketed and sorted by hash.  A new batch is reduced to its distinct hashes and merge-joined with every
run, bucket by bucket, without shuffling the runs: hashes that no run has become a new run of level 0.  When a
level has ``FANOUT`` runs they are compacted into one of the next level, so a batch meets few runs however many
came before.  Batches come in ascending order of ids, so the first owner of a hash stays its owner.

Scale.  Lines leave their documents as (id, hash).  A hash that stands in a third of all documents combines
before it is shuffled; where lines are held against the owners of their hashes, both sides are plain shuffles
whose large partitions Spark splits.  A document gets back only the hashes of its own lines.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from trellis.llm.schema import extended
from trellis.llm.shipping import ship
from trellis.session import Staged, stage, staging_root

MIN_CHARS = 10
#: Runs of a level before they are compacted.
FANOUT = 3
#: Batches that one table is taken in.
BATCHES = 4
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of a line's key; None for one that is too short to be compared."""
    key = line.strip(BLANK)
    return hashlib.md5(key.encode().lower()).digest() if len(key) >= min_chars else None  # bytes: only A-Z change


class Runs:
    """Levels of runs (hash, owner)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "hash")
        dealt.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{staging_root(self.spark)}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def resolve(self, batch: DataFrame) -> DataFrame:
        """Owner of every hash of ``batch`` (hash, owner; hashes distinct); adds those that were new as a run."""
        known = batch.withColumn("earlier", F.lit(None).cast(batch.schema["owner"].dataType))
        for run in self.runs():
            met = run.select("hash", F.col("owner").alias("found"))
            known = known.join(met.hint("merge"), "hash", "left").withColumn("earlier", F.coalesce("earlier", "found")).drop("found")
        known = stage(known)
        self._write(known.where("earlier IS NULL").select("hash", "owner"), 0)
        self._compact()
        return known.select("hash", F.coalesce("earlier", "owner").alias("owner"))

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            names = self.levels[level]
            if len(names) >= self.fanout:
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self.levels[level] = []
                self._write(merged, level + 1)
                self._forget(names)
            level += 1

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Take the runs' names out of the catalog; their files stay below the staging root."""
        self._forget([name for level in self.levels for name in level])
        self.levels = []


def line_hashes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, hash): the distinct line hashes of every row; none of short lines and none of rows without an id."""
    picked = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes = [], []
            for k, value in enumerate(batch.column(1)):
                own = {line_key(line, min_chars) for line in (value.as_py() or "").split("\n")} - {None}
                at += [k] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hashes, pa.binary())], names=["id", "hash"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, hash binary")


def _batches(lines: DataFrame, count: int) -> list[DataFrame]:
    """Ranges of ids in ascending order; one where ids are not numbers."""
    if count < 2 or not isinstance(lines.schema["id"].dataType, NumericType):
        return [lines]
    shares = [(k + 1) / count for k in range(count - 1)]
    cuts = sorted(set(lines.agg(F.percentile_approx("id", shares)).first()[0] or []))
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:]):
        part = lines if low is None else lines.where(F.col("id") > low)
        out.append(part if high is None else part.where(F.col("id") <= high))
    return out


def repeated_lines(lines: DataFrame, runs: Runs, batches: int = BATCHES) -> DataFrame:
    """(id, hash) of the lines that a smaller id holds too, within ``lines`` or in earlier batches of ``runs``."""
    found = Staged(lines.sparkSession)
    for batch in _batches(lines, batches):
        owners = runs.resolve(batch.groupBy("hash").agg(F.min("id").alias("owner")))
        found.append(batch.join(owners, "hash").where(F.col("owner") < F.col("id")).select("id", "hash"))
    return found.all()


def dedup_lines(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), min_chars: int = MIN_CHARS, batches: int = BATCHES, runs: Runs | None = None
) -> DataFrame:
    """doc_id, ``keep`` columns, n_lines (before), n_dropped, and the text with repeated lines left out.

    A line goes when its key has at least ``min_chars`` code points and a document of a smaller id holds it too;
    the smallest keeps all of its lines.  ``runs`` continues a store whose ids are all smaller.  Null and empty
    texts are one empty line.  Rows of the same id are one document; rows without an id stay whole and count for
    nothing.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    lines = stage(line_hashes(docs, text=text, doc_id=doc_id, min_chars=min_chars))
    own = runs is None
    runs = runs or Runs(spark)
    dropped = repeated_lines(lines, runs, batches)
    if own:
        runs.close()
    per_doc = dropped.groupBy(F.col("id").alias("_id")).agg(F.collect_set("hash").alias("_gone"))
    names = [doc_id, *keep]
    picked = docs.select(*names, F.col(text).alias("_text"))
    joined = picked.join(per_doc, picked[doc_id] == per_doc["_id"], "left").select(*names, "_text", "_gone")

    def rewrite(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            totals, losses, texts = [], [], []
            for value, gone in zip(batch.column(len(names)), batch.column(len(names) + 1)):
                rows = (value.as_py() or "").split("\n")
                hashes = set(gone.as_py() or ())
                left = [r for r in rows if line_key(r, min_chars) not in hashes] if hashes else rows
                totals.append(len(rows))
                losses.append(len(rows) - len(left))
                texts.append("\n".join(left))
            new = [pa.array(totals, pa.int64()), pa.array(losses, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], names=[*names, "n_lines", "n_dropped", text])

    return joined.mapInArrow(rewrite, extended(picked.schema.fields[: len(names)], f"n_lines long, n_dropped long, `{text}` string"))
