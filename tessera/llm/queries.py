"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, fingerprints, language_id, lm_scoring, mixing, near_dedup, oracles, passages, substring_index, token_output, toxicity
from tessera.llm._shared import read_table, temporary_tables

#: Domains of the mixture, by the columns of ``labels``, and their target weights.
DOMAINS = {
    "toxic": "toxic = 1",
    "low": "toxic = 0 and quality = 0",
    "good": "toxic = 0 and quality = 1",
}
TARGETS = {"toxic": 0.1, "low": 0.15, "good": 0.75}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A file of the public vocabularies installed beside the library (never copied here)."""
    import public_tokenizers

    return os.environ.get("TESSERA_TOKENIZER", public_tokenizers.path(name))


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    members = mixing.posteriors(docs, read_table(spark, sf_dir, "labels"), DOMAINS)
    rated, _, _ = mixing.fit_rates(members, list(TARGETS.values()))
    shares = (F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(DOMAINS))
    rated = rated.withColumn("_row", F.explode(F.expr("sequence(1L, n_rows)")))
    return rated.select("doc_id", "row_hash", "n_tokens", *shares, "rate", mixing.copies(F.col("rate"), F.col("doc_id"), F.col("row_hash")).alias("copies"))


def op3_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(read_table(spark, sf_dir, "documents"))


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scoring.score_documents(read_table(spark, sf_dir, "documents"), order=2)
    return found.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log")})


def op5_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(read_table(spark, sf_dir, "documents"))


def op6_benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    with temporary_tables(spark) as keep:
        index = decontamination.build_index(docs)
        near = decontamination.proximity_matches(index, items).groupBy(F.struct("doc_id", "row_hash").alias("d")).agg(F.count("*").alias("n"))
        found = decontamination.hits_by_document(index, items)
        found = found.join(near, F.struct("doc_id", "row_hash") == F.col("d"), "left")
        return keep(
            found.select(
                "doc_id",
                "n_words",
                "n_hit",
                F.size("item_ids").cast("long").alias("n_items"),
                F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                (F.col("n_hit") > 0).alias("contaminated"),
                F.coalesce("n", F.lit(0)).cast("long").alias("n_near"),
            ),
            "benchmark-phrases",
        )


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_index.remove_repeats(read_table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(read_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    categories = {"low_quality": "quality = 0", "toxicity": "toxic = 1"}
    chain = toxicity.fit_chain(docs, read_table(spark, sf_dir, "labels"), categories)
    return toxicity.score(docs, chain).withColumn("toxic", F.col("toxicity") >= 0.5)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_output.write_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_output.read_digests(manifest)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_mixture, op2_soft_mixing, op3_piecewise_fingerprints, op4_stupid_backoff, op5_near_passages, op6_benchmark_phrases, op7_repeated_substrings, op8_near_duplicates, op9_toxicity_chain, op10_token_files, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
