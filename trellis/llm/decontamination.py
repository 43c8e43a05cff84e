"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item's windows are its runs of ``WINDOW`` words (a shorter item is one window).  A document that contains a
window contains all of its shingles, so one necessary shingle is enough to find every candidate: shingles are
ordered by the number of documents that hold them, and a window's prefix is its rarest one (the prefix of a set
that must be contained whole has length one).  A window whose rarest shingle no document holds cannot occur and
leaves the join.  At a matching shingle the window's place in the document is known; it is dropped if it would
begin before the text or end after it, and otherwise compared word by word.

Scale.  Documents are scanned where they lie: no document word is shuffled, and a passage that a third of all
documents share costs each of them one comparison.  Windows are dealt into blocks of about ``BLOCK_BYTES``,
however large the benchmark is; one block at a time is broadcast, counted and matched, and the blocks' results
are put together per text, of whose copies each block gives one row only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.schema import extended
from trellis.llm.shipping import ship
from trellis.session import stage

WINDOW, SHINGLE = 10, 3
#: Bytes of windows and item ids that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Code points of a text that are split into words at once.
CHUNK = 1 << 20
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(b if b in _WORD_BYTES else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))

Words = list[bytes]


def words_of(text: str) -> Words:
    """Runs of digits, letters a-z and anything beyond ASCII, A-Z lower-cased first."""
    return text.encode().translate(_FOLD).split()


def word_chunks(text: str, size: int = CHUNK) -> Iterator[Words]:
    """The words of a text, chunk by chunk; chunks end at separators."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and words_of(text[end]):
            end += 1
        yield words_of(text[start:end])
        start = end
    yield words_of(text[start:])


def shingles_of(words: Words, width: int) -> Iterator:
    return zip(*(words[k:] for k in range(width))) if width > 1 else iter(words)


def _width(window: Words) -> int:
    return min(SHINGLE, len(window))


class Block:
    """Windows that are matched at once: (words, item ids) each."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list[str]]]):
        self.windows = windows
        self.widths = sorted({_width(w) for w, _ in windows})
        self.longest = max((len(w) for w, _ in windows), default=1)
        self.shingles = [s for width in self.widths for s in sorted({s for w, _ in windows if _width(w) == width for s in shingles_of(w, width)})]
        self.by_width = {w: frozenset(s for s in self.shingles if (len(s) if isinstance(s, tuple) else 1) == w) for w in self.widths}
        self.prefixes: dict[int, dict] = {}

    def count(self, texts: Iterator[str]) -> Counter:
        """Documents that hold each shingle of the block."""
        found: Counter = Counter()
        for text in texts:
            held, carried = set(), []
            for words in word_chunks(text):
                words = carried + words
                for width, wanted in self.by_width.items():
                    held |= wanted.intersection(shingles_of(words, width))
                carried = words[-(SHINGLE - 1) :]
            found.update(held)
        return found

    def choose(self, documents: dict) -> None:
        """Take each window's rarest shingle as its prefix; windows with one that no document holds are out."""
        for window, items in self.windows:
            width = _width(window)
            held, shingle, offset = min((documents.get(s, 0), s, k) for k, s in enumerate(shingles_of(window, width)))
            if held:
                self.prefixes.setdefault(width, {}).setdefault(shingle, []).append((offset, list(window), items))

    def match(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged spans of hit words, and items with a window in the text."""
        total, carried, spans, items = 0, [], set(), set()
        for new in word_chunks(text):
            words, first = carried + new, total - len(carried)
            for width, prefixes in self.prefixes.items():
                for at in [k for k, s in enumerate(shingles_of(words, width)) if s in prefixes]:
                    key = words[at] if width == 1 else tuple(words[at : at + width])
                    for offset, window, owners in prefixes[key]:
                        start = at - offset
                        if 0 <= start <= len(words) - len(window) and words[start : start + len(window)] == window:
                            spans.add((first + start, first + start + len(window)))
                            items.update(owners)
            total += len(new)
            carried = words[-(self.longest - 1) :] if self.longest > 1 else []
        return total, merged(spans), items


def merged(spans) -> list[tuple[int, int]]:
    """Half-open spans without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_windows(benchmark: DataFrame, text: str, item_id: str, window: int) -> DataFrame:
    """Distinct windows (words joined by a space) with the sorted ids of their items, as strings."""
    picked = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(value or "")
                n = min(window, len(words))
                rows += [{"window": b" ".join(words[k : k + n]), "item": item} for k in range(len(words) - n + 1) if n]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("window", pa.binary()), ("item", pa.string())]))

    return picked.mapInArrow(run, "window binary, item string").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _document_counts(docs: DataFrame, block) -> dict:
    """Documents per shingle of the block, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            found.update(block.value.count(v.as_py() or "" for v in batch.column(0)))
        place = {s: k for k, s in enumerate(block.value.shingles)}
        yield pa.RecordBatch.from_arrays(
            [pa.array([place[s] for s in found], pa.int64()), pa.array(found.values(), pa.int64())], names=["shingle", "held"]
        )

    counts = docs.select("_text").mapInArrow(run, "shingle long, held long").groupBy("shingle").agg(F.sum("held").alias("held"))
    return {block.value.shingles[r.shingle]: r.held for r in counts.collect()}  # at most the block's shingles


def _scan(docs: DataFrame, names: list[str], block, everything: bool) -> DataFrame:
    """Every row (or only those with hits) with its number of words, spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows, totals, spans, items = [], [], [], []
            for k, value in enumerate(batch.column(len(names))):
                total, found, owners = block.value.match(value.as_py() or "")
                if everything or found:
                    rows.append(k)
                    totals.append(total)
                    spans.append([{"start": a, "end": b} for a, b in found])
                    items.append(sorted(owners))
            kept = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(names))]
            made = [pa.array(totals, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names, "n_words", "spans", "items"])

    return docs.mapInArrow(run, extended(docs.schema.fields[: len(names)], "n_words long, spans array<struct<start: long, end: long>>, items array<string>"))


def _of_texts(parts: list[DataFrame]) -> DataFrame:
    """(_row, spans, items): the hits of every text in each block, once for all copies of the text."""
    found = None
    for k, part in enumerate(parts):
        hits = part.where(F.size("spans") > 0).select("_row", F.lit(k).alias("_block"), "spans", "items")
        found = hits if found is None else found.unionByName(hits)
    return found.dropDuplicates(["_row", "_block"]).drop("_block")


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_text: str = "text", item_id: str = "item_id",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns, n_words, spans (of hit words, merged, half-open), n_hit and items of every row of ``docs``.

    A null text has no words; neither has an item without words or without an id any window.  Items that repeat an
    id are one item.  Rows of ``docs`` may repeat and give repeated results; other columns are ignored.  Empty
    tables: no rows for no documents, and no hits for no items.
    """
    spark = docs.sparkSession
    ship(spark)
    windows = stage(item_windows(benchmark, item_text, item_id, window))
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length(F.concat_ws(",", "items")) + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    picked = docs.select(*keep, F.col(text).alias("_text"))
    key = list(keep)
    if blocks > 1:  # results of several blocks meet by row
        key = [*keep, "_row"]
        picked = picked.select(*keep, F.sha2(F.coalesce("_text", F.lit("")), 256).alias("_row"), "_text")
    parts = []
    for k in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).collect()  # at most about block_bytes
        block = Block([(tuple(bytes(r.window).split(b" ")), list(r["items"])) for r in rows])
        shared = spark.sparkContext.broadcast(block)
        counts = _document_counts(picked, shared)
        shared.destroy()
        block.choose(counts)
        parts.append(_scan(picked, key, spark.sparkContext.broadcast(block), everything=k == 0))
    found = parts[0]
    if blocks > 1:
        every = found.select(*key, "n_words")
        found = _of_texts(parts).groupBy("_row").agg(
            F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        found = every.join(found, "_row", "left").select(*keep, "n_words", _merged("spans").alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(*keep, "n_words", "spans", hit.alias("n_hit"), "items")


def _merged(spans: str):
    """Union of overlapping spans of an array column."""
    ordered = F.array_sort(F.coalesce(F.col(spans), F.array().cast("array<struct<start: bigint, end: bigint>>")))
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(ordered, empty, add)
