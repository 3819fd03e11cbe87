"""The corpus pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import contamination, jaccard, language, lines, pieces
from earshot.session import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; missing labels are filled in.

    Where nothing was learned, every document with a letter stays, with the label it has.
    """
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = F.col("lang_pred") != language.UNDECIDED
    kept = language.predict(docs, model).where(found | F.col("score").isNull())
    return kept.withColumn("lang", F.coalesce("lang", F.when(found, F.col("lang_pred")))).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line passages go; every document stays."""
    return lines.drop_repeated_windows(docs).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of alike documents the one with the smallest id stays.

    Of rows that share that id the one with the least text stays (nulls first, then by the
    other columns). Documents without an id can't be told apart and stay.
    """
    first = jaccard.join(docs).where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row"))
    return kept.select("doc_id", "row.*").select(docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.contamination(docs, items).where(~contamination.is_contaminated()).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, beside its columns, and whether they decode to its text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.encode(docs, model, decoded="decoded")
    return found.select(
        *docs.columns, "ids", F.size("ids").cast("long").alias("n_ids"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: Hypervectors and piece lattices are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them are in the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
