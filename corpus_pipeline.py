"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``docs``. Part of the llm subpackage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontam, minhash, packing, quality, runtime, substring

#: op3's query has four by its own contract; a stage takes five.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the current policy keeps; rows of one id are judged each by its own text."""
    ledger = quality.judged(docs)
    return runtime.without_rows(docs, ledger.where("not kept").select(F.col("row_key").alias("__row")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates on shingles of five words; rows of
    one id are linked each by its own text, and rows with a null id, which are linked with
    nothing, stay."""
    groups = minhash.labelled(docs, size=SHINGLE_WORDS)
    return runtime.without_rows(docs, groups.where("doc <> component").select(F.xxhash64("doc", "hash").alias("__row")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated windows; those left without words go.

    A text that loses nothing stays as it is; another becomes its kept words
    joined by one space, and n_chars its length.
    """
    cut = substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    cut = cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences."""
    return packing.packed(docs, encode_special_tokens=False)


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("benchmark_decontamination", decontamination), ("best_fit_packing", packing_stage)]

#: Not expressible in SQL (tokenizer, packing order); tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{runtime.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
