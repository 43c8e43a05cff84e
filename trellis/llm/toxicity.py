"""Toxicity by class-conditional Kneser-Ney models.

Two byte n-gram models of words, one of toxic and one of ordinary documents, have class counts of their own at the
highest order (``ORDER`` bytes, or fewer from a word's start) and share everything below it: interpolated
Kneser-Ney over continuation counts of both classes together.  An n-gram that one class never showed, or showed
rarely, so leans on the same backoff in both, and rare words do not look toxic or ordinary by chance.

    P_c(x | h) = max(n_c(hx) - D, 0) / n_c(h)  +  D T_c(h) / n_c(h) * P_shared(x | h')

An expression (a word, or ``PIECE`` bytes of a longer run) is scored by the difference of its toxic and ordinary
log-likelihoods divided by its length; a document has the largest of them and its own length-normalised difference.
A logistic curve over these two, fitted on labelled rows that were not counted, gives the score.

Scale.  Labelled texts are counted where the join leaves them, and word counts combine before they are shuffled; all
model steps are joins and groupings of n-grams.  An n-gram of at most six bytes is packed in a number, so a
model that scoring broadcasts is two sorted arrays: at most ``MODEL_GRAMS`` n-grams of 12 bytes and as many contexts.
A larger model stays a table, whole: the corpus's distinct words are scored by joins of their n-grams with it, and
texts meet the values of their words by a join.  Scores are the same either way, but for rounding.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.decontamination import word_chunks
from trellis.llm.schema import extended
from trellis.llm.memory import held
from trellis.llm.shipping import ship
from trellis.session import stage

ORDER, DISCOUNT, PIECE = 6, 0.75, 32
#: Largest model that is broadcast, in n-grams and in contexts; a larger one is joined.
MODEL_GRAMS = 8_000_000
#: Labelled rows that the logistic curve is fitted on at most.
CALIBRATION_ROWS = 50_000
#: Weights (largest expression, whole document, constant) without any labelled row, and their strength.
PRIOR, STRENGTH = np.array([4.0, 0.0, -5.0]), 0.05
THRESHOLD = 0.3
START, END = b"^", b"$"  # no word has these bytes
COUNTED_WORDS, REMEMBERED_WORDS = 200_000, 300_000
#: Bytes of words whose n-grams a task lists at once.
LISTED_BYTES = 1 << 18


def fold(doc_id: str) -> Column:
    """0-15 by the CRC-32 of the id as text; its remainder by 4 is 2 for held-out rows."""
    return F.crc32(F.col(doc_id).cast("string")) % 16


def held_out(doc_id: str) -> Column:
    return F.coalesce(fold(doc_id) % 4 == 2, F.lit(False))


def _for_calibration(doc_id: str) -> Column:
    return fold(doc_id).isin(3, 7)


# ---- counting -----------------------------------------------------------------------------------

def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, ordinary, toxic): occurrences in texts of either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("word counts",), dict)  # other operators' memories go; the counts below are the task's own
        found = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(set(found[0]) | set(found[1]))
            columns = [pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in found)]
            for c in found:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "ordinary", "toxic"])

        for batch in batches:
            for value, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                for words in word_chunks(value.as_py() or ""):
                    found[toxic].update(words)
                if len(found[0]) + len(found[1]) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    rows = labelled.select("text", "toxic").mapInArrow(run, "word binary, ordinary long, toxic long")
    return rows.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, place) of every byte of every word and of its end: the n-gram that ends there, packed with its length."""
    data = np.frombuffer(b"".join(START + w + END for w in words), np.uint8)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = data.astype(np.uint64)
    for k in range(1, ORDER):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k]
        key |= np.where(place >= k, before, 0).astype(np.uint64) << np.uint64(8 * k)
    key |= np.minimum(place + 1, ORDER).astype(np.uint64) << np.uint64(48)
    real = place > 0
    return key[real].astype(np.int64), word[real], place[real]


def gram_counts(words: DataFrame) -> DataFrame:
    """(key, ordinary, toxic): class counts of the highest order, n-grams from a word's start being shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, word, _ = packed(batch.column(0).to_pylist())
            unique, at = np.unique(keys, return_inverse=True)
            sums = [np.bincount(at, weights=batch.column(c).to_numpy()[word]).astype(np.int64) for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(unique), *map(pa.array, sums)], names=["key", "ordinary", "toxic"])

    rows = words.mapInArrow(run, "key long, ordinary long, toxic long")
    return rows.groupBy("key").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _size(key: Column) -> Column:
    return F.shiftright(key, 48)


def _context(key: Column) -> Column:
    """The n-gram without its last byte."""
    return F.shiftright(key.bitwiseAND(F.lit((1 << 48) - 1)), 8).bitwiseOR(F.shiftleft(_size(key) - 1, 48))


def _suffix(key: Column, size: int) -> Column:
    """The n-gram of ``size`` bytes without its first byte."""
    return key.bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1)).bitwiseOR(F.lit((size - 1) << 48))


def shared_backoff(grams: DataFrame) -> DataFrame:
    """(key, p): interpolated Kneser-Ney probability of every n-gram below the highest order, over both classes."""
    levels: dict[int, DataFrame] = {}
    above = grams.where(_size(F.col("key")) == ORDER).select("key")
    for size in range(ORDER - 1, 0, -1):
        counts = above.groupBy(_suffix(F.col("key"), size + 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        levels[size] = stage(counts)
        above = levels[size].select("key").unionByName(grams.where(_size(F.col("key")) == size).select("key"))
    lower, every = None, None
    for size in range(1, ORDER):
        here = levels[size].withColumn("context", _context(F.col("key")))
        contexts = here.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        here = here.join(contexts, "context")
        own = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")
        spare = DISCOUNT * F.col("types") / F.col("total")
        if lower is None:
            here = here.withColumn("p", own + spare / 256)
        else:
            here = here.withColumn("suffix", _suffix(F.col("key"), size)).join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("q")), "suffix")
            here = here.withColumn("p", own + spare * F.col("q"))
        lower = stage(here.select("key", "p"))
        every = lower if every is None else every.unionByName(lower)
    return every


def _bounded(rows: DataFrame, weight: Column, bound: int) -> DataFrame:
    """All rows, or the heaviest if there are more than ``bound``.  Scoring does not use it: a model is never cut."""
    if rows.count() <= bound:
        return rows
    steps = rows.groupBy(F.floor(F.log2(weight) * 8).alias("step")).count().orderBy(F.desc("step")).collect()
    kept, cut = 0, steps[0].step + 1
    for r in steps:
        if kept + r["count"] > bound:
            break
        kept, cut = kept + r["count"], r.step
    return rows.where(F.floor(F.log2(weight) * 8) >= cut)


class Model:
    """Log-likelihood differences by n-gram, and by context for n-grams that neither class has."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], name: str | None = None):
        self.grams, self.contexts = grams, contexts
        self.name = name or uuid.uuid4().hex  # what workers remember of its words is held under it

    def __getstate__(self):
        return self.grams, self.contexts, self.name

    def __setstate__(self, state):
        self.__init__(*state)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, values = table
        if not len(names):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        return names[at] == keys, values[at]

    def differences(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: the largest length-normalised difference of its pieces, and its whole difference."""
        keys, word, place = packed(words)
        found, value = self._find(self.grams, keys)
        rest = np.flatnonzero(~found)
        k = keys[rest]
        size = k >> 48
        in_context, spare = self._find(self.contexts, ((k & ((1 << 48) - 1)) >> 8) | ((size - 1) << 48))
        value = np.where(found, value, 0.0)
        value[rest] = np.where(in_context, spare, 0.0)
        sums = np.bincount(word, weights=value, minlength=len(words))
        begins = np.flatnonzero((place - 1) % PIECE == 0)
        pieces = np.add.reduceat(value, begins) / np.diff(np.append(begins, len(value)))
        most = np.full(len(words), -np.inf)
        np.maximum.at(most, word[begins], pieces)
        return most, sums

    def features(self, text: str) -> tuple[float, float]:
        """Largest expression and whole document, both per byte; zeros without words."""
        most, total, length, known = 0.0, 0.0, 0, held(("toxicity", self.name), dict)
        for words in word_chunks(text):
            if not words:
                continue
            if len(known) > REMEMBERED_WORDS:
                known.clear()
            new = [w for w in set(words) if w not in known]
            if new:
                known.update(zip(new, zip(*(a.tolist() for a in self.differences(new)))))
            values = list(map(known.__getitem__, words))
            most = max(most, max(values)[0])
            total += sum(v[1] for v in values)
            length += sum(map(len, words)) + len(words)
        return most, total / length if length else 0.0


def model_tables(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model of labelled rows (text, toxic 0 or 1): (key, value) of every n-gram and of every context."""
    words = stage(word_counts(labelled))
    grams = stage(gram_counts(words))
    per_context = grams.groupBy(_context(F.col("key")).alias("context")).agg(
        *(F.sum(c).alias(f"{c}_total") for c in ("ordinary", "toxic")), *(F.count_if(F.col(c) > 0).alias(f"{c}_types") for c in ("ordinary", "toxic"))
    )
    per_context = stage(per_context)

    def spare(c: str) -> Column:
        return F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_types") / F.col(f"{c}_total")).otherwise(1.0)

    def probability(c: str) -> Column:
        own = F.when(F.col(f"{c}_total") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_total")).otherwise(0.0)
        return own + spare(c) * F.col("p")

    key, size = F.col("key"), _size(F.col("key"))
    suffix = F.lit(None).cast("long")
    for n in range(2, ORDER + 1):
        suffix = F.when(size == n, _suffix(key, n)).otherwise(suffix)
    joined = grams.select("*", _context(key).alias("context"), suffix.alias("suffix")).join(per_context, "context")
    joined = joined.join(shared_backoff(grams).withColumnRenamed("key", "suffix"), "suffix")
    valued = stage(joined.select("key", F.log(probability("toxic") / probability("ordinary")).cast("float").alias("value")))
    return valued, per_context.select(F.col("context").alias("key"), F.log(spare("toxic") / spare("ordinary")).cast("float").alias("value"))


def collected(valued: DataFrame, spares: DataFrame) -> Model:
    tables = []
    for rows in (valued, spares):
        table = rows.toArrow()
        keys, values = table["key"].to_numpy(), table["value"].to_numpy()
        order = np.argsort(keys)
        tables.append((keys[order], values[order]))
    return Model(*tables)


def train(labelled: DataFrame) -> Model:
    """Model of labelled rows (text, toxic 0 or 1), all of it in memory."""
    return collected(*model_tables(labelled))


# ---- scoring ------------------------------------------------------------------------------------

def features(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * 12 * MODEL_GRAMS bytes
    picked = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [shared.value.features(v.as_py() or "") for v in batch.column(len(keep))]
            made = [pa.array([p[k] for p in pairs], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "_expression", "_document"])

    return picked.mapInArrow(run, extended(picked.schema.fields[: len(keep)], "_expression double, _document double"))


def _digest(word: bytes) -> bytes:
    return hashlib.blake2b(word, digest_size=16).digest()


def _distinct_words(texts: DataFrame) -> DataFrame:
    """(word): the distinct words of a column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("distinct words",), dict)
        found: set[bytes] = set()
        for batch in batches:
            for value in batch.column(0):
                for words in word_chunks(value.as_py() or ""):
                    found.update(words)
                if len(found) > COUNTED_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["word"])
                    found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["word"])

    return texts.mapInArrow(run, "word binary").distinct()


def _word_values(words: DataFrame, valued: DataFrame, spares: DataFrame) -> DataFrame:
    """(word, most, whole) by digest of the word: what ``Model.differences`` gives, by joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(own: list[bytes]) -> pa.RecordBatch:
            keys, word, place = packed(own)
            digests = pa.array(map(_digest, own), pa.binary()).take(pa.array(word))
            return pa.RecordBatch.from_arrays([digests, pa.array((place - 1) // PIECE), pa.array(keys)], names=["word", "piece", "key"])

        for batch in batches:
            own, size = [], 0
            for value in batch.column(0):
                own.append(value.as_py())
                size += len(own[-1])
                if size > LISTED_BYTES:
                    yield listed(own)
                    own, size = [], 0
            if own:
                yield listed(own)

    marks = words.mapInArrow(run, "word binary, piece long, key long")
    keys = marks.select("key").distinct().join(valued, "key", "left").withColumn("context", _context(F.col("key")))
    keys = keys.join(spares.select(F.col("key").alias("context"), F.col("value").alias("spare")), "context", "left")
    keys = keys.select("key", F.coalesce("value", "spare", F.lit(0.0)).cast("double").alias("value"))
    pieces = marks.join(keys, "key").groupBy("word", "piece").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return pieces.groupBy("word").agg(F.max(F.col("value") / F.col("n")).alias("most"), F.sum("value").alias("whole"))


def joined_features(docs: DataFrame, valued: DataFrame, spares: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """What ``features`` gives, by a model of any size that stays a table.  Copies of a text are scored once."""
    picked = docs.select(*keep, F.col(text).alias("_text")).withColumn("_digest", F.sha2(F.coalesce("_text", F.lit("")), 256))
    values = _word_values(stage(_distinct_words(picked.select("_text"))), valued, spares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_digest", "word", "n", "bytes"]
        made: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*made) if made else ((), (), (), ())
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64(), pa.int64()))]
            made.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for digest, value in zip(batch.column(0), batch.column(1)):
                counts: Counter = Counter()
                for words in word_chunks(value.as_py() or ""):
                    counts.update(words)
                made += [(digest.as_py(), _digest(w), n, n * (len(w) + 1)) for w, n in counts.items()]
                if len(made) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    mentions = picked.select("_digest", "_text").mapInArrow(run, "_digest string, word binary, n long, bytes long")
    mentions = mentions.groupBy("_digest", "word").agg(F.any_value("n").alias("n"), F.any_value("bytes").alias("bytes"))
    texts = mentions.join(values, "word").groupBy("_digest").agg(
        F.greatest(F.max("most"), F.lit(0.0)).alias("_expression"), (F.sum(F.col("n") * F.col("whole")) / F.sum("bytes")).alias("_document")
    )
    return picked.join(texts, "_digest", "left").select(*keep, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("_expression", "_document")))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights near ``PRIOR`` by Newton's method; rows of ``x`` are (expression, document)."""
    design = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, 3))
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + STRENGTH * (w - PRIOR)
        bend = design.T @ (design * (p * (1 - p))[:, None]) + STRENGTH * np.eye(3)
        step = np.linalg.solve(bend, slope)
        size = np.abs(step).max()
        w = w - step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) of every row of ``docs``.

    Labels are learnt from rows of ``labels`` whose fold is not held out; ids that repeat there count once, toxic if
    any row says so; null labels and ids are ignored.  Of these, folds 3 and 7 of 16 fit the curve and the others are
    counted.  Null and empty texts have no expressions and get the curve's value at zero.  Without labels the
    prior curve is used and no text is toxic.  Rows may repeat; other columns are ignored; an empty table gives
    an empty result.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("toxic"))
    counted = known.where(~_for_calibration("_id"))
    own = docs.where(~held_out(doc_id) & ~_for_calibration(doc_id)).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    valued, spares = model_tables(own.join(counted.hint("merge"), "_id").select("text", "toxic"))  # labels grow with the corpus: no broadcast
    if max(valued.count(), spares.count()) <= MODEL_GRAMS:
        scored = stage(features(docs, collected(valued, spares), text, [doc_id, *keep]))
    else:
        scored = stage(joined_features(docs, valued, spares, text, [doc_id, *keep]))
    fitted = scored.select(F.col(doc_id).alias("_id"), "_expression", "_document").join(known.where(_for_calibration("_id")), "_id")
    rows = fitted.select("_expression", "_document", "toxic").orderBy(F.xxhash64("_id")).limit(CALIBRATION_ROWS).toArrow()
    x, y = np.column_stack([rows[c].to_numpy() for c in ("_expression", "_document")]), rows["toxic"].to_numpy()
    a, b, c = fit_curve(x, y.astype(float)).tolist()
    score = 1 / (1 + F.exp(-(a * F.col("_expression") + b * F.col("_document") + c)))
    return scored.select(doc_id, *keep, held_out(doc_id).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
