"""A training corpus from `documents`: five stages, each an operator of umbraframe.llm, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.llm import bpe, secrets, similar, toxicity, wumanber
from umbraframe.llm.common import load, work_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on its input's labelled rows, scores under its threshold."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar documents (five-word shingles, similarity 0.8)."""
    return similar.keep_one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are words of benchmark windows."""
    return wumanber.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark, and n_chars as the text then has it."""
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its id, token ids (little-endian uint32), their number and digests of ids and decoded bytes."""
    return bpe.round_trip(docs).select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("byte_bpe", encode)]
#: No SQL form: fuzzy matching, fingerprints and byte-level BPE are beyond it. tests/llm has a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = load(spark, sf_dir, "documents"), work_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
