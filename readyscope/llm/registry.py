"""The registered queries of the training-data operators, and the SQL of those that have it."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readyscope.llm import (
    balltree,
    bpe,
    linededup,
    packing,
    phrases,
    pii,
    quality,
    secrets,
    simhash,
    spans,
    topk,
    toxicity,
    urlrules,
    warc,
)
from readyscope.llm.common import read_table

ROOT = str(Path(__file__).resolve().parents[2])

Query = Callable[[SparkSession, str], DataFrame]


def with_workers(query: Query) -> Query:
    """Python workers import this package too, so they are told where it lies."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment = spark.sparkContext.environment
        known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":")
        if ROOT not in known:
            environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, known)])
        return query(spark, sf_dir)

    return run


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = linededup.without_repeats(docs)
    return cut.withColumn("n_cut", F.coalesce(F.size("cut_spans"), F.lit(0)).cast("long")).select(
        "doc_id", "text", "n_cut", "cut_spans"
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path("word_bpe_49k.json"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(read_table(spark, sf_dir, "pages"))
    return warc.read_archive(spark, archive).select(
        "page_id",
        F.length("payload").cast("long").alias("payload_bytes"),
        warc.sha1_base32(F.col("payload")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs)
    return found.select(
        "doc_id",
        *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        spans.digest(F.col("base")).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    return found.select(
        "doc_id",
        *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        spans.digest(F.col("base")).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = quality.rate_documents(docs, read_table(spark, sf_dir, "labels"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "llr",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = toxicity.grade_documents(docs, read_table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "severity", "toxic", (~F.col("toxic")).alias("kept"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.floored(read_table(spark, sf_dir, "embeddings"), "embedding", 256)
    return topk.top_k(
        vectors, F.col("vec_id") % 50 == 0, k=5, vec_id="vec_id", vector="embedding"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlrules.judge_urls(pages, urlrules.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return balltree.rank(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def queries() -> dict[str, Query]:
    own = [
        op1_line_dedup, op2_bpe, op3_warc, op4_pii, op5_packing, op6_secrets, op7_quality, op8_toxicity,
        op9_exact_topk, op10_simhash, op11_url_rules, op12_ranked_search, op13_collocations,
    ]
    return {query.__name__: with_workers(query) for query in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": warc.ORACLE, "op9_exact_topk": topk.ORACLE, "op11_url_rules": urlrules.ORACLE,
        "op12_ranked_search": balltree.ORACLE, "op13_collocations": phrases.ORACLE,
    }
