"""From raw documents to packed token sequences: five stages, each calling one operator of marlcore.llm.

toxicity (documents that it rejects go), exact deduplication (one row of each group stays), n-gram Jaccard join over five-word
shingles at 0.8 (one document of each component stays), secret scan (secrets are replaced by a placeholder, all documents
stay), packing.  Each stage's result is written as Parquet under the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlcore.llm import entries, exact_dedup, jaccard, packing, secrets, toxicity
from marlcore.session import let_workers_import, materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_repeats(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return jaccard.keep_one_of_each(docs, size=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return packing.pack_documents(docs, entries.tokenizer_path(), cache_size=CACHE)


#: Pre-tokens that the packing stage keeps in a worker: few, as the workers hold what earlier stages left there.
CACHE = 80_000

STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard", jaccard_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the language models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
