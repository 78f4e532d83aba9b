"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Languages are identified and unidentifiable documents go; one document of each near-duplicate group stays;
documents with benchmark passages go; the rest is mixed to target weights; the result is written as token ids.

Defined results: a null or blank text has no letters and goes with the first stage; a null doc_id stays, is never a
duplicate, and sorts first in the files; rows that repeat id and text are one document, rows that share an id only are
judged by their own texts; an empty table gives an empty result; columns beyond those of documents go along up to
the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, language_id, mixing, near_dedup, token_output
from tessera.llm._shared import drop_table, free_names, materialize, read_table, temporary_tables
from tessera.llm.queries import DOMAINS, TARGETS, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or which no learned language explains better than chance, go; a missing lang is filled in."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the smallest id of a group stays."""
    return near_dedup.keep_one_of_each(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any ten consecutive words of a benchmark item go."""
    d, h = free_names(docs, "_d", "_h")
    with temporary_tables(spark) as keep:
        found = decontamination.contamination(docs, read_table(spark, sf_dir, "benchmark")).where("n_hit > 0")
        found = keep(found.select(F.col("doc_id").alias(d), F.col("row_hash").alias(h)).distinct(), "contaminated")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h)), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domain weights are met by repeating documents, never by dropping one."""
    with temporary_tables(spark) as keep:
        members = mixing.posteriors(docs, read_table(spark, sf_dir, "labels"), DOMAINS)
        rated, _, _ = mixing.fit_rates(members, list(TARGETS.values()), least=1.0)
        rated = keep(rated.select("doc_id", "row_hash", "rate"), "rates")
    return mixing.mix(docs, rated)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the files and reads each document's digest back from them."""
    return token_output.read_digests(token_output.write_documents(docs, tokenizer_path(), end_id=2))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_output", token_ids),
]

#: Mixture inference, minimum hashing and tokenizers have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's output is removed once the next one has written its own."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporary_tables(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)
        before = docs
    return docs
