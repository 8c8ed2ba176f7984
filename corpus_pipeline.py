"""A training-data pipeline of five stages over ``documents``.

Each stage's result is written and reread as the next one's input, by ``run`` as by any scheduler. All
stages but the last return the columns of ``documents``; the last returns the places of pieces in training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import mixing, packing, pii, quality_rules, simhash
from sievelight.storage import materialise

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return simhash.keep_one(docs)


def protect_people(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by pseudonyms; ``n_chars`` follows the new text."""
    safe = pii.protect(docs).drop("pii")
    return safe.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, globally shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all copies, packed into sequences; ``row`` tells the copies of a document apart."""
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return packing.pack_documents(numbered, public_tokenizers.path(TOKENIZER), row="row")


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", protect_people),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Expectation-maximisation, fingerprints and tokenizers cannot be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
