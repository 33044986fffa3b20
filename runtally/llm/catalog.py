"""Queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runtally.llm import (
    bpe, centroids, conversations, forest, graph, jaccard, katz, language, licenses, mixing, pieces, secrets, toxicity,
)
from runtally.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def held_out(folds: int, rest: int) -> Column:
    return F.coalesce(fold(folds) == rest, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.classify(docs.select("doc_id", "text"), labels, learn_from=fold(3) != 1)
    return scored.select("doc_id", held_out(3, 1), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold(3) != 1))
    found = language.label(docs.select("doc_id", "text"), model, spans=False)
    return found.select("doc_id", held_out(3, 1), "lang_pred", "score")


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = katz.lm_scores(docs, "crc32(cast(cast(doc_id AS string) AS binary)) % 7 <> 2")
    columns = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return scored.select("doc_id", held_out(7, 2), *columns)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def _count(kind: str) -> Column:
    return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, scratch_path(spark, "ledger"))
    base = [r.kind for r in secrets.RULES if r.base]
    of_base = F.filter("findings", lambda s: s["kind"].isin(base))
    counts = [_count(kind).alias(f"n_{kind}") for kind in base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.joined_spans(of_base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("findings")).alias("spans"),
    )


def op6_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.similar_documents(docs, width=4, percent=85)


def op8_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: The wanted shares of tokens of the mix.
TARGETS = {"good": 0.85, "poor": 0.12, "toxic": 0.03}


def domains(labels: DataFrame) -> DataFrame:
    """The label table as (doc_id, domain)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mixed = mixing.mix(docs, domains(labels), TARGETS, keep=["doc_id"])
    shares = [F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(TARGETS)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(texts, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.numbered(table(spark, sf_dir, "conversations"))
    return conversations.trie(conversations.rebuilt(turns))


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(found)), ",")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.col("phrases.first_word")
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(F.col("phrases.label")).alias("base_labels"),
        _labels(F.concat("phrases.label", "blocks.label")).alias("labels"),
        F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_katz": op3_katz,
    "op4_token_counts": op4_token_counts,
    "op5_secrets": op5_secrets,
    "op6_graph": op6_graph,
    "op7_jaccard": op7_jaccard,
    "op8_forest": op8_forest,
    "op9_mixing": op9_mixing,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_trie": op11_trie,
    "op12_licenses": op12_licenses,
    "op13_centroids": op13_centroids,
}
