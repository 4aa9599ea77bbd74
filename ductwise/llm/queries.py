"""The queries of this package, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, media, neardup, packing, quality, rules, secrets, suffixes, tokenbin, toxicity, trie, whitening


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.identify(langid.document_columns(docs), langid.fit(docs))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return langid.identify(langid.page_columns(pages), langid.fit(_documents(spark, sf_dir)), key="page_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir)), threshold=0.7)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, _labels(spark, sf_dir)), threshold=0.5)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), *_tokenizer("byte_bpe_50k.tiktoken"))


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.load(*media.store(_documents(spark, sf_dir)))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read_tokens(tokenbin.write_tokens(_documents(spark, sf_dir), *_tokenizer("byte_bpe_50k.json"), end_id=0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), *_tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), size=2, percent=80)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir), threshold=0.5).withColumn("candidate", F.sha2("candidate", 256))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(*whitening.fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = suffixes.remove_repeats(_documents(spark, sf_dir), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return clean.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (
        op1_language_id, op2_toxicity, op3_quality, op4_byte_bpe, op5_media_chunks, op6_token_binary, op7_quality_rules, op8_best_fit_packing, op9_minhash_near_dedup,
        op10_secret_scan, op11_embedding_whitening, op12_suffix_dedup, op13_conversation_trie,
    )
    return {f.__name__: f for f in (*numbered, language_id_pages)}


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": rules.sql()}
