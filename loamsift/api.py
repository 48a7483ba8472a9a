"""Classes in the shape that users of in-memory deduplicators know, over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.operators.dedup import Deduplicated, deduplicate
from loamsift.operators.minhash import signature_of
from loamsift.operators.semantic import embedded, hybrid_keep, semantic_keep, similar_pairs
from loamsift.plans.config import DedupConfig, HybridConfig, SemanticConfig


def texts_frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A list as documents, whose ids are its places."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


class Deduplicator:
    def __init__(self, config: DedupConfig = DedupConfig()):
        self.config = config

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Deduplicated:
        return deduplicate(docs, self.config, id_col, text_col)

    def deduplicate_texts(self, spark: SparkSession, texts: list[str]) -> Deduplicated:
        return self.deduplicate(texts_frame(spark, texts))

    def signature(self, text: str) -> list[int]:
        return signature_of([text], self.config)[0]

    def similarity(self, a: str, b: str) -> float:
        """The estimated Jaccard similarity of two texts; that of two empty ones is 1."""
        x, y = self.signature(a), self.signature(b)
        return sum(p == q for p, q in zip(x, y)) / len(x)


class SemanticDeduplicator:
    """``embed`` makes a vector column of a text column; without it vectors have to be there."""

    def __init__(self, config: SemanticConfig = SemanticConfig(), embed=None):
        self.config, self.embed = config, embed

    def _with(self, docs: DataFrame, text_col: str, vector_col: str) -> DataFrame:
        return embedded(docs, self.embed, text_col, vector_col) if self.embed else docs

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vector_col: str = "embedding") -> DataFrame:
        return semantic_keep(self._with(docs, text_col, vector_col), self.config, id_col, vector_col)

    def similar_pairs(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vector_col: str = "embedding") -> DataFrame:
        return similar_pairs(self._with(docs, text_col, vector_col), self.config, id_col, vector_col)


class HybridDeduplicator:
    def __init__(self, config: HybridConfig = HybridConfig(), embed=None):
        self.config, self.embed = config, embed

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vector_col: str = "embedding") -> DataFrame:
        if self.config.verify_with_semantic and self.embed:
            docs = embedded(docs, self.embed, text_col, vector_col)
        return hybrid_keep(docs, self.config, id_col, text_col, vector_col)


def index_line_numbers(docs: DataFrame) -> DataFrame:
    """Documents under their line numbers, for inputs whose own ids repeat."""
    return docs.withColumn("doc_id", F.col("line_number"))
