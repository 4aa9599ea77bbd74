"""The corpus pipeline: quality, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again for the next.  All but the last return the columns of documents.  Every stage judges rows by their texts, whole
however long, and never by doc_id: rows whose doc_id is null or repeated are judged like any other, and equal rows alike.  Null and empty texts pass the quality stage
(its threshold is 0 for no bytes), are rejected by the language stage (no language can be told; without any labelled text the stage rejects nothing), and have no near duplicates, no secrets and one piece.  An empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ductwise.llm import langid, neardup, packing, quality, secrets
from ductwise.llm._runtime import materialise, scratch

#: No SQL expresses a stage; the tests compare with brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of at least one half; rows are judged by text and source, whatever their ids."""
    key = F.concat(F.hex(F.xxhash64("text", "source")), F.hex(F.xxhash64("source", F.lit(1), "text")))
    model = langid.fit(docs)
    if not model.languages:  # nothing can be told, so nothing is rejected
        return docs
    rejected = langid.identify(langid.document_columns(docs.withColumn("doc_id", key)), model).where("NOT accepted").select(F.col("doc_id").alias("rejected_")).distinct()
    return docs.join(materialise(rejected, "unidentified"), key == F.col("rejected_"), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8); unlike texts stay, whatever their ids."""
    return neardup.one_of_each(docs, size=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2, capacity=1024)


STAGES = [
    ("quality", keep_good),
    ("language", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as outer:  # a stage's own tables go once its result is written
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", under=outer)
    return STAGES[-1][1](spark, docs, sf_dir)
