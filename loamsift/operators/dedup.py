"""Batch MinHash deduplication: signature, bands, candidates, verification, components, decisions.

Order is the id: of each cluster the least id stays. Documents with equal
signatures are folded into one before anything is joined, so a text that
occurs a million times, or a million empty texts, adds one row to each bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.operators.components import connected_components
from loamsift.operators.minhash import band_keys, candidate_pairs, signatures, with_similarity
from loamsift.plans.config import DedupConfig
from loamsift.session import materialize


@dataclass
class Deduplicated:
    """What a run gives: ``members`` (doc_id, rep) of every document, ``pairs`` between folded documents with their weights."""

    members: DataFrame
    folded: DataFrame
    pairs: DataFrame

    def decisions(self) -> DataFrame:
        """(doc_id, representative_id, is_duplicate) of every document."""
        return self.members.select("doc_id", F.col("rep").alias("representative_id"), (F.col("doc_id") != F.col("rep")).alias("is_duplicate"))

    def keep(self) -> DataFrame:
        return self.members.where("doc_id = rep").select("doc_id")

    def remove(self) -> DataFrame:
        return self.members.where("doc_id <> rep").select("doc_id", F.col("rep").alias("representative_id"))

    def clusters(self) -> DataFrame:
        """(representative_id, duplicates): clusters of at least two, the duplicates ascending."""
        return self.remove().groupBy("representative_id").agg(F.sort_array(F.collect_list("doc_id")).alias("duplicates"))

    def sizes(self) -> DataFrame:
        """(representative_id, size) of every cluster of at least two."""
        return self.members.groupBy(F.col("rep").alias("representative_id")).agg(F.count("*").alias("size")).where("size > 1")

    def stats(self) -> DataFrame:
        """One row; the ratio of an empty input is 0. Counts of pairs are those between all documents, folded or not."""
        docs = self.members.agg(F.count("*").alias("total"), F.coalesce(F.sum((F.col("doc_id") == F.col("rep")).cast("long")), F.lit(0)).cast("long").alias("unique_docs"))
        inner = self.folded.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("inner"))
        met = self.pairs.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("met"), F.coalesce(F.sum(F.when(F.col("verified"), F.col("weight"))), F.lit(0)).cast("long").alias("good"))
        sets = self.sizes().agg(F.count("*").alias("cluster_count"))
        one = docs.crossJoin(inner).crossJoin(met).crossJoin(sets)  # four rows in all
        gone = F.col("total") - F.col("unique_docs")
        return one.select("total", "unique_docs", gone.alias("duplicate_count"), F.when(F.col("total") == 0, F.lit(0.0)).otherwise(gone / F.col("total")).alias("duplicate_ratio"), "cluster_count", (F.col("met") + F.col("inner")).alias("candidate_pairs"), (F.col("good") + F.col("inner")).alias("verified_pairs"))


def deduplicate(docs: DataFrame, config: DedupConfig = DedupConfig(), id_col: str = "doc_id", text_col: str = "text") -> Deduplicated:
    """Documents whose chain of verified pairs connects them form a cluster; null ids are left out.

    Signatures are computed once and written; what follows moves digests and
    folded signatures, never texts.
    """
    kept = docs.where(F.col(f"`{id_col}`").isNotNull())
    sigs = materialize(signatures(kept, config, id_col, text_col).withColumn("digest", F.md5(F.array_join("signature", ","))), "signatures")
    counted = sigs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    firsts = sigs.select(F.col("digest"), "doc_id", "signature").join(counted, ["digest", "doc_id"]).dropDuplicates(["digest"])  # signatures of the first of each alone
    folded = materialize(firsts.select("digest", "doc_id", "n", "signature"), "folded")
    pairs = with_similarity(candidate_pairs(band_keys(folded.select("doc_id", "signature"), config)), folded)
    sizes = folded.select("doc_id", "n")
    weighed = pairs.join(sizes.select(F.col("doc_id").alias("doc_a"), F.col("n").alias("n_a")), "doc_a").join(sizes.select(F.col("doc_id").alias("doc_b"), F.col("n").alias("n_b")), "doc_b")
    good = F.col("similarity") >= config.threshold if config.verify else F.lit(True)
    pairs = materialize(weighed.select("doc_a", "doc_b", "similarity", (F.col("n_a") * F.col("n_b")).alias("weight"), good.alias("verified")), "pairs")
    parts = connected_components(pairs.where("verified"), "doc_a", "doc_b")
    heads = folded.join(parts, F.col("doc_id") == F.col("id"), "left").select("digest", F.coalesce("component", "doc_id").alias("rep"))
    members = sigs.select("doc_id", "digest").join(heads, "digest").select("doc_id", "rep")
    return Deduplicated(materialize(members, "members"), folded, pairs)


def drop_duplicates(docs: DataFrame, config: DedupConfig = DedupConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all columns as they are; rows with null ids stay. An id that two rows have, of which one would go, is an error."""
    run = deduplicate(docs, config, id_col, text_col)
    mixed = run.members.groupBy("doc_id").agg(F.count_distinct(F.col("doc_id") == F.col("rep")).alias("n")).where("n > 1").first()
    if mixed:
        raise ValueError(f"the id {mixed.doc_id} belongs to a document that stays and to one that goes: give each row an id of its own")
    gone = run.remove().select(F.col("doc_id").alias("__loamsift_gone"))
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__loamsift_gone"), "left_anti")
