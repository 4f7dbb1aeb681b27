"""One query for each operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, jaccard_join, manifest, packing, periodic, quality, secret_scan, sentence_pieces, sharding, token_count, toxicity, url_filter
from .common import table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files are; the only place that knows."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=16)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), threshold=80, width=5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=toxicity.fold() != 0)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(toxicity.fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), buckets=16, budget=1 << 18)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents"), fanout=3)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.audit(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_embedding_dedup, op3_sentence_pieces, op4_exact_dedup, op5_quality, op6_sharding, op7_url_filter, op8_jaccard_join, op9_toxicity, op10_packing, op11_merkle_manifest, op12_periodic_runs, op13_secret_scan)
}
ORACLE: dict[str, str] = {"op2_embedding_dedup": embedding_dedup.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op7_url_filter": url_filter.ORACLE, "op8_jaccard_join": jaccard_join.ORACLE, "op11_merkle_manifest": manifest.ORACLE, "op12_periodic_runs": periodic.ORACLE, "op13_secret_scan": secret_scan.ORACLE}
