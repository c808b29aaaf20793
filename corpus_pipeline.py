"""The corpus pipeline: five stages, each on all rows its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read
again for the next one. All but the last return the columns of ``documents``. An empty table
passes through; NULL texts are never duplicate or contaminated; rows that share an id are one
document and stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from spotweave.llm import decontaminate, jaccard_join, packing, secret_scan, toxicity
from spotweave.llm.queries import table, training_labels
from spotweave.session import cut_lineage

#: SQL cannot express classifier, tokenizer and packing; tests use brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the threshold. Learns from the labelled
    documents of the training fold."""
    classifier = toxicity.fit(docs, training_labels(spark, sf_dir))
    return toxicity.drop_toxic(docs, classifier)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id."""
    return jaccard_join.keep_one(docs)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; a document of which no word is left goes."""
    return decontaminate.cut_out(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; ``n_chars`` follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the remaining documents, a row per piece."""
    pieces = packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(cut_lineage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_near_duplicates),
    ("benchmark decontamination", cut_benchmarks),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
