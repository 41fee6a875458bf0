"""The registered queries of the training-data operators, one for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tallylog.llm import (
    alignment, binary, chat, fingerprints, identifiers, language, licenses, minhash, packing, pieces,
    quality, variants, vectors,
)
from tallylog.llm.common import held_out, prepared, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepared(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_scaled_sketch")
def sketched(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, folder, "documents"))


@query("op2_language_profiles")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    profiles = language.learn_profiles(docs.where(~held_out()))
    return language.predict_languages(docs, profiles)


@query("op3_piece_viterbi")
def encoded(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"))


@query("op4_first_fit_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op5_chat_snapshots", chat.FORMAT_SQL)
def formatted(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_conversations(table(spark, folder, "conversations"))


@query("op6_quality_ftrl")
def scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train_quality(docs, table(spark, folder, "labels"))
    return quality.score_documents(docs, model)


@query("op7_product_quantisation")
def linked(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, folder, "embeddings"))


@query("op8_token_files")
def written(spark: SparkSession, folder: str) -> DataFrame:
    return binary.token_files(table(spark, folder, "documents"))


@query("op9_circulant_minhash")
def deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"), size=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op10_license_dice", licenses.scan_sql())
def licensed(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


@query("op11_bootstrapped_identifiers")
def personal(spark: SparkSession, folder: str) -> DataFrame:
    return identifiers.find_identifiers(table(spark, folder, "documents"))


@query("op12_galloping_alignment")
def aligned(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_documents(table(spark, folder, "documents"))


@query("op13_spelling_tiles")
def grouped(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
