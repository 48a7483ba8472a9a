"""python -m loamsift: deduplicate a file or folder of documents."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from loamsift.functions.vectors import mock_embedding
from loamsift.operators.dedup import deduplicate
from loamsift.operators.first_seen import stream_stats
from loamsift.operators.semantic import embedded, hybrid_keep, semantic_keep
from loamsift.plans.config import DedupConfig, HybridConfig, SemanticConfig, StreamConfig
from loamsift.session import get_spark
from loamsift.sources import documents as D
from loamsift.streaming.dedup import BandIndex


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamsift", description=__doc__)
    p.add_argument("input")
    p.add_argument("-o", "--output")
    p.add_argument("-f", "--field", default="text")
    p.add_argument("--format", default="auto")
    p.add_argument("-t", "--threshold", type=float, default=0.85)
    p.add_argument("-p", "--permutations", type=int, default=128)
    p.add_argument("-n", "--ngram", type=int, default=5)
    p.add_argument("--no-verify", action="store_true")
    p.add_argument("--stats-only", action="store_true")
    p.add_argument("--streaming", action="store_true", help="flag what shares a band with anything earlier")
    p.add_argument("--incremental", action="store_true", help="go on from the index in --index-path and add to it")
    p.add_argument("--index-path")
    p.add_argument("--expected-docs", type=int, default=1_000_000)
    p.add_argument("--semantic", action="store_true")
    p.add_argument("--hybrid", action="store_true")
    p.add_argument("--semantic-threshold", type=float, default=0.9)
    p.add_argument("--json", action="store_true", help="statistics as JSON")
    return p


def main(args: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    if not a.stats_only and not a.output:
        p.error("--output is needed unless --stats-only")
    if a.incremental and not a.index_path:
        p.error("--incremental needs --index-path")
    config = DedupConfig(a.threshold, a.permutations, a.ngram, not a.no_verify)
    spark = get_spark("loamsift")
    kind = D.format_of(a.input, a.format)
    docs = D.read_documents(spark, a.input, a.field, kind)
    text = a.field if a.field in docs.columns else "text"
    if "line_number" in docs.columns:
        docs = docs.withColumn("__loamsift_seq", F.col("line_number"))
    else:
        docs = docs.withColumn("__loamsift_seq", F.monotonically_increasing_id())
    seq = "__loamsift_seq"
    if a.streaming or a.incremental:
        if a.index_path:
            index = BandIndex(spark, a.index_path, StreamConfig(a.permutations, a.threshold, a.expected_docs))
            flagged = index.check_and_insert(docs, None, seq, text)
        else:
            from loamsift.operators.first_seen import first_seen

            flagged = first_seen(docs, StreamConfig(a.permutations, a.threshold, a.expected_docs), seq, text)
        stats, gone = stream_stats(flagged), flagged.where("is_duplicate").select(F.col("doc_id").alias("__loamsift_gone"))
        kept = docs.join(gone, F.col(seq) == F.col("__loamsift_gone"), "left_anti")
    elif a.semantic or a.hybrid:
        vectors = embedded(docs, mock_embedding, text, "__loamsift_vector")
        if a.semantic:
            kept = semantic_keep(vectors, SemanticConfig(a.semantic_threshold), seq, "__loamsift_vector")
        else:
            kept = hybrid_keep(vectors, HybridConfig(a.threshold, a.semantic_threshold, a.permutations, a.ngram), seq, text, "__loamsift_vector")
        kept = kept.drop("__loamsift_vector")
        stats = docs.agg(F.count("*").alias("total")).crossJoin(kept.agg(F.count("*").alias("unique_docs"))).withColumn("duplicates", F.col("total") - F.col("unique_docs"))
    else:
        d = deduplicate(docs, config, seq, text)
        gone = d.remove().select(F.col("doc_id").alias("__loamsift_gone"))
        stats, kept = d.stats(), docs.join(gone, F.col(seq) == F.col("__loamsift_gone"), "left_anti")
    row = stats.first().asDict()
    if not a.stats_only:
        if "line" in kept.columns:
            D.write_lines(kept, a.output)
        else:
            D.write_parquet_full(kept.drop(seq), a.output)
    print(json.dumps(row) if a.json else "\n".join(f"{k}: {v}" for k, v in row.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
