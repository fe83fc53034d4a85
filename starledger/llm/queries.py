"""The text operators as registered queries, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.llm import (
    bpe,
    crc_resampling,
    decontamination,
    importance,
    language,
    line_dedup,
    ngram_join,
    packing,
    pii,
    quality_rules,
    secrets,
    twins,
    vector_codes,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, folder, "documents"), words=4, percent=85)


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"),
        "spans",
        "n_literal",
    )


def spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_overlaps(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )


def line_edit_join(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, folder, "documents")).select(
        "doc_id", "text", "n_lines", "n_removed"
    )


def surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace_entities(_table(spark, folder, "documents"), key="registered query").select(
        "doc_id", "text", "n_entities"
    )


def pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"))


def importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_table(spark, folder, "documents"))


def language_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language.identify(docs, language.train(docs)).select(
        "doc_id",
        language.held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        "score",
        "n_switches",
    )


def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    page = F.pandas_udf(lambda ids: pd.Series([warc.page_of(x) for x in ids], dtype="Int64"), "long")
    _, records = warc.archive_pages(_table(spark, folder, "pages"))
    return records.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(_table(spark, folder, "documents")).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def laesa_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes, codebooks = vector_codes.compress(_table(spark, folder, "embeddings"))
    digest = F.lit(vector_codes.codebooks_digest(codebooks))
    return codes.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return crc_resampling.draw(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": ngram_jaccard,
    "op2_secret_scan": secret_scan,
    "op3_importance_resampling": importance_resampling,
    "op4_divergence_rules": divergence_rules,
    "op5_spaced_seeds": spaced_seeds,
    "op6_line_edit_join": line_edit_join,
    "op7_shortest_pack_first": pack,
    "op8_language_crf": language_crf,
    "op9_surrogates": surrogates,
    "op10_warc_normaliser": warc_round_trip,
    "op11_byte_bpe": byte_bpe,
    "op12_laesa_codes": laesa_codes,
    "op13_crc_resampling": target_resampling,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard": twins.NGRAM_JACCARD,
    "op4_divergence_rules": twins.DIVERGENCE_RULES,
    "op5_spaced_seeds": twins.SPACED_SEEDS,
    "op6_line_edit_join": twins.LINE_EDIT_JOIN,
    "op10_warc_normaliser": twins.WARC_NORMALISER,
    "op12_laesa_codes": twins.LAESA_CODES,
    "op13_crc_resampling": twins.CRC_RESAMPLING,
}
