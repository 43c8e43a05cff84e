"""One query per operator, with its production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.exact_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).drop("historical")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.pii import surrogates

    return surrogates(table(spark, sf_dir, "documents"), b"a key for tests, not for production")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def encoded_and_decoded(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids of every text and of the text that they decode to."""
    from trellis.llm.transducer import round_trip

    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return round_trip(docs, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_decoded(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.warc import archive_folder, read_pages, write_pages

    folder = archive_folder(spark)
    write_pages(table(spark, sf_dir, "pages"), folder)
    return read_pages(spark, folder)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.clustering import cluster_vectors, digest

    rows, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    per_cluster = centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), digest("centroid").alias("centroid_sha256"))
    total = centroids.agg(F.sum("inertia")).first()[0]  # of one row a centroid
    return rows.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256"
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trellis.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_toxicity": op2_toxicity,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_token_files": op6_token_files,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_token_counts": op9_token_counts,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_quality_rules": op13_quality_rules,
}
