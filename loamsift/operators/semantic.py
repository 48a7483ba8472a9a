"""Semantic and hybrid keep-first deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.functions.vectors import mock_embedding
from loamsift.operators.greedy import greedy_keep
from loamsift.operators.minhash import candidate_pairs, signatures, similarity
from loamsift.operators.similarity import all_pairs, knn_pairs
from loamsift.plans.config import DedupConfig, HybridConfig, SemanticConfig
from loamsift.session import materialize

Embed = Callable[[Column], Column]


def embedded(docs: DataFrame, embed: Embed = mock_embedding, text_col: str = "text", to: str = "embedding") -> DataFrame:
    """Documents with a vector; ``embed`` is any Column function, an Arrow UDF over a model among them."""
    return docs.withColumn(to, embed(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def semantic_keep(df: DataFrame, config: SemanticConfig = SemanticConfig(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The rows without an earlier kept one whose cosine reaches the threshold. Rows without id or vector stay."""
    pairs = all_pairs(df, config.threshold, id_col, vector_col)
    return greedy_keep(df, pairs.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b")), id_col)


def similar_pairs(df: DataFrame, config: SemanticConfig = SemanticConfig(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return knn_pairs(df, config.threshold, config.neighbours, id_col, vector_col)


def estimated_pairs(sigs: DataFrame, permutations: int, threshold: float) -> DataFrame:
    """(doc_a, doc_b, similarity) of every pair of signatures that agrees at ``threshold`` of the places.

    Such a pair differs at most at m = n - ceil(t n) places, so of m + 1 or more
    bands at least one is equal: joining on bands of n // (m + 1) rows misses none.
    """
    import math

    apart = permutations - math.ceil(permutations * threshold - 1e-9)
    rows = max(1, permutations // (apart + 1))
    bands = permutations // rows
    if bands <= apart:
        raise ValueError("the threshold has to be above 0")
    keys = F.array(*(F.struct(F.lit(k).alias("band_id"), F.xxhash64(F.slice("signature", k * rows + 1, rows)).alias("band_hash")) for k in range(bands)))
    each = sigs.select("doc_id", F.explode(keys).alias("k")).select("doc_id", "k.band_id", "k.band_hash")
    met = candidate_pairs(each)
    a, b = (sigs.select(F.col("doc_id").alias(f"doc_{s}"), F.col("signature").alias(f"sig_{s}")) for s in "ab")
    both = met.join(a, "doc_a").join(b, "doc_b")
    return both.select("doc_a", "doc_b", similarity(F.col("sig_a"), F.col("sig_b")).alias("similarity")).where(F.col("similarity") >= threshold)


def hybrid_keep(docs: DataFrame, config: HybridConfig = HybridConfig(), id_col: str = "doc_id", text_col: str = "text", vector_col: str = "embedding") -> DataFrame:
    """The rows that stay.

    With semantic verification a document goes exactly if its cosine with an
    earlier kept one reaches the threshold, whatever MinHash says of it; without,
    the estimated Jaccard similarity with every earlier kept one decides.
    Equal signatures are folded before pairs are sought.
    """
    if config.verify_with_semantic:
        return semantic_keep(docs, SemanticConfig(config.semantic_threshold), id_col, vector_col)
    sigs = materialize(signatures(docs.where(F.col(f"`{id_col}`").isNotNull()), DedupConfig(config.minhash_threshold, config.permutations, config.ngram), id_col, text_col), "signatures")
    folded = materialize(sigs.groupBy("signature").agg(F.min("doc_id").alias("doc_id")), "folded")
    same = sigs.join(folded.withColumnRenamed("doc_id", "head"), "signature").where("doc_id <> head").select("doc_id")
    pairs = estimated_pairs(folded, config.permutations, config.minhash_threshold)
    heads = folded.select("doc_id")
    stay = greedy_keep(heads, pairs)
    gone = heads.join(stay, "doc_id", "left_anti").union(same).withColumnRenamed("doc_id", "__loamsift_gone")
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__loamsift_gone"), "left_anti")
