"""Exact dedup: a minimal perfect hash over known digests, looked up for every row.

Method.  ``digest_rows`` gives each row the SHA-256 of its text without white space.  ``build_index`` deals the
distinct digests into buckets by their own hash and builds a minimal perfect hash per bucket (levels of bit
sets: at each level a key is placed where no other key falls, the rest go on to the next level).  A slot holds
the full digest and the winner's locator, so a lookup is one probe and one comparison of 32 bytes; a digest that
was never indexed lands in a foreign slot and fails the comparison.  Rows that match are repeats of the slot's
winner; the others are grouped among themselves.

Scale.  Texts are read once and only digests move.  Digest groups combine before their shuffle, so a text with a
third of all copies is one row per task there.  Lookup groups are pairs (bucket, part) of about
``ROWS_PER_PART`` rows: a hot bucket is dealt to as many parts as its rows need and its index row is copied to
each.  Everything staged lies below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.shipping import ship
from trellis.session import stage

#: Distinct digests per bucket of the index, and rows per lookup group.
KEYS_PER_BUCKET = 4096
ROWS_PER_PART = 4096
#: Bits of a level for each key that reaches it.
SPREAD = 2
INDEX = "bucket long, levels array<binary>, digests binary, locators array<struct<keep_chars: long, keep_id: {id}, group_size: long>>"


def normalised(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digest_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, chars, digest) of every row."""
    return docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"),
        F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"),
    )


def summaries(rows: DataFrame) -> DataFrame:
    """Per digest: its winner (most code points, then smallest id; null ids last) and its number of rows."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", (-F.col("best.less")).alias("keep_chars"), F.col("best.id").alias("keep_id"), "group_size"
    )


def _words(digests: np.ndarray) -> np.ndarray:
    return np.frombuffer(digests.tobytes(), "<u8").reshape(-1, 4)


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key at a level; all four words take part, so distinct digests part sooner or later."""
    h = np.full(len(words), (level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
    for i in range(4):
        h = (h ^ words[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(32))) % np.uint64(size)


def perfect_hash(digests: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Levels of the hash over distinct 32-byte digests (rows of uint8), and the slot of each."""
    words, left = _words(digests), np.arange(len(digests))
    levels, slots, placed = [], np.empty(len(digests), np.int64), 0
    while len(left):
        size = max(64, SPREAD * len(left))
        at = _positions(words[left], len(levels), size)
        taken = np.bincount(at.astype(np.int64), minlength=size) == 1
        alone = taken[at]
        slots[left[alone]] = placed + np.cumsum(taken)[at[alone]] - 1
        placed += int(alone.sum())
        left = left[~alone]
        levels.append(np.uint32(size).tobytes() + np.packbits(taken).tobytes())
    return levels, slots


def probe(levels: list[bytes], digests: np.ndarray) -> np.ndarray:
    """Slot of each digest; -1 where no level has it.  A foreign digest may get any slot."""
    words, left = _words(digests), np.arange(len(digests))
    slots, placed = np.full(len(digests), -1, np.int64), 0
    for k, level in enumerate(levels):
        size = int(np.frombuffer(level[:4], np.uint32)[0])
        taken = np.unpackbits(np.frombuffer(level[4:], np.uint8), count=size)
        at = _positions(words[left], k, size)
        here = taken[at] == 1
        slots[left[here]] = placed + np.cumsum(taken, dtype=np.int64)[at[here]] - 1
        placed += int(taken.sum())
        left = left[~here]
    return slots


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets))


class Index:
    """A written table of buckets: (bucket, levels, digests, locators)."""

    def __init__(self, table: DataFrame, buckets: int):
        self.table, self.buckets = table, buckets


def build_index(known: DataFrame) -> Index:
    """Index over distinct digests with their locators (digest, keep_chars, keep_id, group_size)."""
    known = stage(known)
    buckets = max(1, -(-known.count() // KEYS_PER_BUCKET))
    id_type = known.schema["keep_id"].dataType.simpleString()
    layout = INDEX.format(id=id_type)

    def build(group: pa.Table) -> pa.Table:
        digests = _matrix(group["digest"])
        levels, slots = perfect_hash(digests)
        order = np.argsort(slots)
        winners = group.select(["keep_chars", "keep_id", "group_size"]).take(pa.array(order)).to_pylist()
        locator = pa.struct([("keep_chars", pa.int64()), ("keep_id", group["keep_id"].type), ("group_size", pa.int64())])
        return pa.table({
            "bucket": pa.array([group["bucket"][0].as_py()], pa.int64()),
            "levels": pa.array([levels], pa.list_(pa.binary())),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "locators": pa.array([winners], pa.list_(locator)),
        })

    return Index(stage(known.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, layout)), buckets)


def lookup(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` (id, chars, digest) with the locator of their digest; nulls where it is not indexed."""
    placed = rows.withColumn("bucket", _bucket(index.buckets))
    parts = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_PART).alias("parts"))
    dealt = placed.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("id", "chars"), "parts")).drop("parts")
    copies = index.table.join(parts, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.select(["id", "chars", "digest"])
        if not right.num_rows or not left.num_rows:
            slots = np.full(left.num_rows, -1)
        else:
            mine, stored = _matrix(left["digest"]), np.frombuffer(right["digests"][0].as_py(), np.uint8).reshape(-1, 32)
            slots = probe(right["levels"][0].as_py(), mine)
            slots[(slots >= 0) & (stored[slots] != mine).any(axis=1)] = -1  # byte check
        where = pa.array(slots, mask=slots < 0)
        locators = right["locators"][0].values if right.num_rows else None
        for name, kind in (("keep_chars", pa.int64()), ("keep_id", left["id"].type), ("group_size", pa.int64())):
            column = locators.field(name).take(where) if locators is not None else pa.nulls(left.num_rows, kind)
            out = out.append_column(name, column)
        return out

    id_type = rows.schema["id"].dataType.simpleString()
    return dealt.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInArrow(
        match, f"id {id_type}, chars long, digest binary, keep_chars long, keep_id {id_type}, group_size long"
    )


def dedup(docs: DataFrame, history: Index | None = None, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, historical.

    Without ``history`` the digests that ``docs`` itself repeats are indexed; a row that misses the index has a
    text of its own.  With ``history`` (an earlier ``build_index``) a row whose digest it holds is a repeat of the
    historical winner and never kept (``historical``; group_size counts the rows of history); the others are
    grouped among themselves in the same way.

    Null and empty texts are equal to each other and to white space.  Rows that repeat the winner's id and length
    are one winner and share ``kept``; null ids win only among themselves.  Other columns are ignored; an empty
    table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = stage(digest_rows(docs, text, doc_id))
    before = None
    if history is not None:
        looked = stage(lookup(rows, history))
        before = looked.where("group_size IS NOT NULL").withColumn("historical", F.lit(True))
        rows = looked.where("group_size IS NULL").select("id", "chars", "digest")
    found = lookup(rows, build_index(summaries(rows).where("group_size > 1"))).withColumn("historical", F.lit(False))
    alone = F.col("group_size").isNull()
    out = found.select(
        F.col("id"), F.col("chars"), F.col("digest"),
        F.when(alone, F.col("chars")).otherwise(F.col("keep_chars")).alias("keep_chars"),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "historical",
    )
    out = out if before is None else out.unionByName(before)
    kept = ~F.col("historical") & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return out.select(
        F.col("id").alias(doc_id), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "historical"
    )
