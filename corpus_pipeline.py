"""A corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import decontaminate, jaccard, mixing, secrets, toxicity
from spanveil.llm.runtime import delete, scratch, write


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays."""
    return jaccard.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; every document stays."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, whole, with the words it takes of each."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("secret_scans", secret_spans),
    ("source_mixing", source_mix),
]
#: No SQL: trees, automata and hashed orders can't be said in it; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written before the next one begins; then what the stage itself had written goes, and its input."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch(spark):
            docs, path = write(stage(spark, docs, sf_dir))
        if before:
            delete(spark, before)
        before = path
    return docs
