"""The named queries ``opN_...`` on the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import (
    contamination, fingerprints, jaccard, language, lexical, lines, neighbours, oracles, pieces, pii, sharding, tokenfiles, variants, warc,
)
from earshot.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op1_count_vector_tree": oracles.OP1,
    "op5_line_windows": oracles.OP5,
    "op6_aho_corasick": oracles.OP6,
    "op11_shared_terms": oracles.OP11,
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows."""
    return lines.drop_repeated_windows(_table(spark, sf_dir, "documents"))


@query
def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and shard after growth of every document."""
    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited form."""
    return fingerprints.edit_report(_table(spark, sf_dir, "documents"))


@query
def op6_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark contamination of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        contamination.is_contaminated().alias("contaminated"),
    )


@query
def op8_hypervectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    aside = language.held_out(F.col("doc_id"))
    model = language.learn(docs.where(~aside))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", aside.alias("held_out"), "lang_pred", "score"
    )


@query
def op3_disguised_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: plain spans, and all spans with disguised ones."""
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: str):
        parts = F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.array_join(parts, ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_disguised"),
    )


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to compressed files and read back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/token-files-{uuid.uuid4().hex}"
    written = tokenfiles.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.read(folder, written, with_ids=False)


@query
def op7_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode(docs, model, decoded="decoded")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query
def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and text records of every page."""
    pages = _table(spark, sf_dir, "pages")
    return warc.derivatives(warc.responses(pages), "page_id")


@query
def op1_count_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of shingles, and its component."""
    return jaccard.join(_table(spark, sf_dir, "documents"))


@query
def op13_frequency_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, its form and its root."""
    return variants.group(_table(spark, sf_dir, "documents"))


@query
def op11_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op12_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
