"""A training-corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

Every stage but the last returns rows of the table it was given, with its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm import decontam, langid, packing, secret_scan, simhash
from weekloom.session import ship_package, write_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; labels of two thirds of the rows are learned from.

    Where no row is labelled nothing can be recognised, and documents with a letter stay.
    """
    ship_package(spark)
    model = langid.train(docs.where(~langid.held_out()))
    return langid.keep_identified(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays, that with the smallest id, nulls last.

    A group is linked by fingerprints of three-word shingles that differ in three bits or fewer.
    """
    ship_package(spark)
    return simhash.keep_one_row_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of ``benchmark`` go."""
    ship_package(spark)
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; their secrets are replaced and ``n_chars`` follows."""
    ship_package(spark)
    clean = secret_scan.redact_secrets(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return clean.withColumn("n_chars", F.char_length("text").cast(kind)) if kind else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", pack),
]

# Language models, fingerprints and tokens have no SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
