"""From documents to token ids: language identification, exact and near deduplication, decontamination, encoding.

Every stage works on all that the one before it kept, and is written and read again in between. The stages keep their
operators' own rules: exact duplicates keep the largest doc_id, near-duplicates (simhash over 3-word shingles, 2 bits) the
smallest of each group, and a document is contaminated by the 13-word rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.llm import bpe, decontaminate, exact_dedup, langid, simhash
from strikeline.llm.common import materialise
from strikeline.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the identifier rejects: without letters, or below its calibrated confidence. Without a labelled
    document there is no identifier, and only those without letters go."""
    model = langid.fit(docs, langid.fold(5) != 0)
    if model is None:
        return langid.lettered(docs)
    return langid.identify(docs, model).filter("not lang_rejected").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs, latest=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("encoding", encode),
]

#: The learnt and iterative stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
