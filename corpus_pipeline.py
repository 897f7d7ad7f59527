"""The corpus pipeline: STAGES of (name, function), each written as Parquet and read again as the next one's documents.

toxicity -> near duplicates -> repeated strings -> benchmark decontamination -> byte-level BPE.  Every stage but the last
returns the columns of documents.  Each one calls an operator of routeloom.llm on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import bpe, decontam, jaccard, suffixes, toxicity
from routeloom.llm.common import dropped, released, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from the labelled rows of the documents table."""
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.remove(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component under 5-word shingle sets with a Jaccard similarity of 0.8 or more."""
    return jaccard.keep_first(docs, words=5, percent=80)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a smaller document holds; a text that had bytes and has none left goes."""
    had = docs.withColumn("__had", F.coalesce(F.octet_length("text"), F.lit(0)) > 0)
    cut = suffixes.deduplicated(had, length=50).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.where("not __had or text != ''").drop("__had")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too many words of benchmark windows go."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token count and digests of every document that is left."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeated_strings),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The first and the last stage are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
            dropped(*last)
            released(spark)
            last = [docs]
    return docs
