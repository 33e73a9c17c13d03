"""Queries of the training-data operators, one for each, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bpe, chat_format, decontaminate, html_extract, imatch, neardup, packing, prefix_trie, quality, secret_scan, spelling, topk_search, url_filter
from tidegauge.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(probe)), ordered=True)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, F.col("vec_id") % topk_search.EVERY == 0)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.compare_edited(docs, imatch.lexicon_of(docs))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), "ids")
    decoded = bpe.decode(encoded, path, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    counts = [secret_scan.number(F.col("spans"), kind).cast("bigint").alias("n_" + kind) for kind in secret_scan.KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base).cast("binary"), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    """Trained on labelled rows that aren't held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(~quality.held_out())
    return quality.train(docs.select("doc_id", "text"), labels)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_document_fingerprints": op3_document_fingerprints,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_url_filter": op5_url_filter,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_bpe_round_trip": op7_bpe_round_trip,
        "op8_secret_scan": op8_secret_scan,
        "op9_html_extraction": op9_html_extraction,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_benchmark_decontamination": op12_benchmark_decontamination,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    from tidegauge.llm import oracles

    return oracles.oracle_sql()
