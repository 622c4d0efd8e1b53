"""From documents to training pieces: five stages, each over all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet in the shared
folder and reads them again for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quantloom.llm.common import remove_dir, shared_dir, table
from quantloom.llm.decontaminate import drop_contaminated
from quantloom.llm.exact_dedup import drop_exact_duplicates
from quantloom.llm.minhash import drop_near_duplicates
from quantloom.llm.piece_sampling import encode_and_check
from quantloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go. Null and empty texts stay, as do repeated rows alike; without
    labels nothing goes."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the smallest doc_id stays; null ids come last, null text counts as empty, and
    of repeated rows one stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more the smallest doc_id stays; texts without words all stay, and
    of repeated rows one."""
    return drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands, with a few edits at most, go; null and empty texts stay, repeated
    rows go or stay together, and null items are no items."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, the sampled piece ids, and whether they decode to the text: a row per row, null text as empty,
    and equal rows alike."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = rows.withColumn("x", encode_and_check(F.col("text"), F.col("doc_id"), path))
    return coded.select("doc_id", F.size("x.ids").cast("long").alias("n_pieces"), F.col("x.ids").alias("piece_ids"), "x.lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("piece_sampling", pieces),
]

#: Models, similarity and sampling can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:  # what the stage before has written isn't read again
            remove_dir(spark, before)
        before = path
    return docs
