"""The corpus pipeline: toxicity, repeated lines, near duplicates, benchmark passages, then token ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the
columns of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.decontamination import contamination
from trellis.llm.line_dedup import dedup_lines
from trellis.llm.near_dup import near_duplicates
from trellis.llm.queries import encoded_and_decoded, table, vocabulary_path
from trellis.llm.toxicity import score_toxicity
from trellis.session import stage


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns, whatever their names, in one."""
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("_"), *(docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text"))).alias("_rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs``, of packed rows; ``changed`` ones only if they are there."""
    return rows.select(*(c if c in ("doc_id", "text") else changed.get(c, F.col("_rest")[c]).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    scored = score_toxicity(_packed(docs), table(spark, sf_dir, "labels"), keep=("text", "_rest"))
    return _unpacked(scored.where("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller id holds too."""
    return _unpacked(dedup_lines(_packed(docs), keep=("_rest",)), docs, n_chars=F.length("text").cast("long"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, one row: of the smallest id, and of the smaller hash of the text where ids repeat.

    Rows are told apart by id and text, so a text stays if only another text of its id is a copy; of equal rows one
    stays.  Rows without an id and rows without a word stay.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("hash")))
    keyed = _packed(docs).withColumn("_key", key)
    found = stage(near_duplicates(keyed, doc_id="_key").select("_key", "class_id", "n_copies"))
    heads, others = found.where("class_id = _key AND n_copies > 1"), found.where("class_id <> _key").select("_key").distinct()
    kept = keyed.join(others.hint("merge"), "_key", "left_anti")
    repeated = stage(heads.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"))
    if not repeated.isEmpty():
        again = kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
        kept = kept.join(repeated, "_key", "left_anti").unionByName(again)
    return _unpacked(kept, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = contamination(_packed(docs), table(spark, sf_dir, "benchmark"), keep=("doc_id", "text", "_rest"))
    return _unpacked(found.where("n_hit = 0"), docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of every document's token ids, and digest of the text that they decode to."""
    return encoded_and_decoded(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_and_decode),
]

#: Language-model scores are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
